"""The pipeline's stages against brute force on whole small tables and on awkward rows."""

import public_tokenizers
import pytest
import tiktoken
from fixtures import documents
from test_decontamination import brute as contaminated_rows
from test_jaccard_join import brute as groups

import corpus_pipeline
from merchantry.llm import byte_bpe, pii, queries, toxicity

FOLDER = "/root/testdata/sf0.001"
TRUTH = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
    mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
)


def expected(spark, docs, folder):
    """Rows by doc_id through all stages, each in plain Python but for the model and the pseudonyms of single texts."""
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [i for i in sorted(rows) if model.scores([rows[i]["text"] or ""])[0] < toxicity.THRESHOLD]
    label = groups([(i, rows[i]["text"]) for i in kept])
    kept = [i for i in kept if label[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = contaminated_rows([rows[i]["text"] for i in kept], items)
    kept = [i for i, row in zip(kept, bad) if not row[3]]
    alone = pii.pseudonymised(docs.where(docs.doc_id.isin(kept)).select("doc_id", "text"), queries.PII_KEY)
    texts = {r["doc_id"]: r["text"] for r in alone.collect()}
    return {i: (texts[i], rows[i]["lang"], rows[i]["source"], TRUTH.encode_ordinary(texts[i] or "")) for i in kept}


def got(df):
    return {r["doc_id"]: (r["text"], r["lang"], r["source"], list(r["token_ids"])) for r in df.collect()}


def test_whole_small_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == [*docs.columns, "token_ids"]
    rows = got(out)
    assert rows == expected(spark, docs, FOLDER)
    assert 0 < len(rows) < docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_order_and_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "pii", "byte_bpe"]
    docs = documents(spark, ["some text 1.2.3.4", "", None, "some text 1.2.3.4"]).selectExpr("*", "1 AS score", "'x' AS pii", "2 AS root", "3 AS block")
    docs = docs.union(docs.where("doc_id = 0")).union(docs.where("doc_id = 0").selectExpr("null", *[f"`{c}`" for c in docs.columns[1:]]))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["score"], r["pii"]) for r in docs.collect())
    assert rows == [(0, 1, "x"), (1, 1, "x"), (2, 1, "x")]


def test_rows_are_judged_by_their_texts(spark):
    """Null and repeated doc_ids: unlike texts stay, copies go, benchmark passages go."""
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    words = [" ".join(f"w{i * j}" for i in range(40)) for j in (1, 3, 7)]
    rows = [(5, words[0]), (5, words[1]), (None, words[0]), (None, words[2]), (4, words[2]), (None, item), (5, item), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    unlike = corpus_pipeline.without_near_copies(spark, docs, FOLDER)
    assert sorted((r.doc_id, r.text) for r in unlike.collect() if r.text) == sorted([(5, words[0]), (5, words[1]), (4, words[2]), (5, item)])
    assert unlike.where("text is null").count() == 2
    clean = corpus_pipeline.without_benchmark(spark, docs, FOLDER)
    assert item not in [r.text for r in clean.collect()] and clean.count() == len(rows) - 2


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_no_documents(spark, name, stage):
    assert stage(spark, documents(spark, []), FOLDER).count() == 0


def test_decisions_go_to_the_texts_as_bits(spark):
    """A list of rows to keep is a bit for each, so texts aren't shuffled to meet numbers as many as they are."""
    rows = spark.range(0, 100_000, 1, 3).selectExpr("monotonically_increasing_id() AS __row", "CAST(id AS STRING) AS text").cache()
    chosen = rows.where("crc32(cast(text as binary)) % 3 = 0").select("__row")
    bits = corpus_pipeline._row_bits(chosen)
    assert bits.count() <= 100_000 // 64 + 6
    wanted = {row["__row"] for row in chosen.collect()}
    every = {row["__row"] for row in rows.collect()}
    kept = corpus_pipeline._only(rows, chosen)
    assert kept.columns == rows.columns and {row["__row"] for row in kept.collect()} == wanted
    others = [row["__row"] for row in corpus_pipeline._only(rows, chosen, chosen_go=True).collect()]
    assert len(others) == len(set(others)) and set(others) == every - wanted
    assert corpus_pipeline._only(rows, chosen.limit(0)).count() == 0
    assert corpus_pipeline._only(rows, chosen.limit(0), chosen_go=True).count() == 100_000
