import glob
import re

import pyarrow.parquet as pq
from fixtures import awkward_texts, documents
from pyspark.sql import functions as F

from merchantry.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, width=13):
    windows = set()
    for item_id, text in items:
        own = words(text)
        if item_id is not None and own:
            windows |= {(item_id, tuple(own[i:i + width])) for i in range(max(len(own) - width, 0) + 1)}
    out = []
    for text in texts:
        own, hit, found = words(text), set(), set()
        for item_id, window in windows:
            for i in range(len(own) - len(window) + 1):
                if tuple(own[i:i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(str(item_id))
        out.append((len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)))
    return out


def build(spark, docs, folder, **kwargs):
    decontamination.build_index(docs, folder, **kwargs)
    return spark.read.schema(decontamination.INDEX_SCHEMA).parquet(folder)


def test_against_brute_force(spark, tmp_path):
    texts = awkward_texts() + ["x Alpha-beta y", "alpha beta " * 15, "the the the the the", "w " * 270 + "alpha beta " + "w " * 8 + "q " * 200]
    long_text = texts[14]
    items = [
        (3, " ".join(words(texts[12])[5:30])), (10, "alpha BETA"), (2, ""), (4, None), (None, "alpha beta"), (5, "the the the"),
        (6, " ".join(words(long_text)[4000:4013])), (7, "nowhere to be found"), (3, "alpha beta"),
        (8, " ".join(words(texts[6])[:14])),
    ]
    index = build(spark, documents(spark, texts).selectExpr("*", "1 AS n_words", "2 AS shard"), f"{tmp_path}/i", shard_chars=2_000)
    assert index.count() > 5
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (20_000_000, 60):  # one block, and many
        found = {r["doc_id"]: r for r in decontamination.contamination(index, benchmark, block_chars=block_chars).collect()}
        for i, (n, hit, ids, bad) in enumerate(brute(texts, items)):
            row = found[i]
            assert (row["n_words"], row["n_hit"], sorted(row["item_ids"]), row["contaminated"]) == (n, hit, ids, bad), i
            covered = {at for s in row["spans"] or [] for at in range(s["start"], s["end"])}
            assert len(covered) == hit
    assert any(r["contaminated"] for r in found.values()) and not all(r["contaminated"] for r in found.values())


def test_items_are_sorted_as_text(spark, tmp_path):
    index = build(spark, documents(spark, ["one two"]), f"{tmp_path}/i")
    benchmark = spark.createDataFrame([(i, "one two") for i in (10, 9, 100, 9)], "item_id long, text string")
    assert decontamination.contamination(index, benchmark).first()["item_ids"] == ["10", "100", "9"]


def test_repeated_rows_null_ids_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    index = build(spark, rows, f"{tmp_path}/i")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_hit"]) for r in decontamination.contamination(index, items).collect())
    assert found == [(0, 2), (1, 2), (1, 2), (2, 0)]
    assert {r["n_hit"] for r in decontamination.contamination(index, items.limit(0)).collect()} == {0}
    none = build(spark, rows.limit(0), f"{tmp_path}/none")
    assert decontamination.contamination(none, items).count() == 0


def test_proximity(spark, tmp_path):
    texts = ["red x x blue", "blue red", "red x x x x blue", "red red blue x red", "blue", None, "green red", "blue"]
    index = build(spark, documents(spark, texts), f"{tmp_path}/i")
    found = sorted((r["doc_id"], r["start"], r["end"]) for r in decontamination.proximity_matches(index, ["Red", "blue"], 4).collect())
    wanted = []
    for i, text in enumerate(texts):
        own = words(text)
        runs = [(a, b) for a in range(len(own)) for b in range(a + 2, min(a + 4, len(own)) + 1) if {"red", "blue"} <= set(own[a:b])]
        wanted += [(i, a, b) for a, b in runs if not any((c, d) != (a, b) and a <= c and d <= b for c, d in runs)]
    assert found == sorted(wanted) and wanted


def test_row_groups_of_the_index_are_bounded(spark, tmp_path):
    rows = spark.range(0, 24, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 100000), i -> hex(id * 100000 + i))) AS text")
    index = build(spark, rows, f"{tmp_path}/i", shard_chars=100_000)
    assert index.agg(F.sum(F.size("n_words"))).first()[0] == 24
    groups = [m.row_group(i) for f in glob.glob(f"{tmp_path}/i/*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(g.total_byte_size for g in groups) > 40 << 20
    assert max(g.total_byte_size for g in groups) < 24 << 20
