"""The registered queries of this subpackage, each over its whole tables, and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm import byte_bpe, decontamination, embedding_dedup, jaccard_join, pii, piece_bpe, quality, ranked_search, spelling, substring_dedup, token_index, toxicity, url_filter
from merchantry.llm.labelled import held_out_column
from merchantry.session import new_table_path, store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""


def with_token_ids(docs: DataFrame, decoded: str | None = None) -> DataFrame:
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=decoded)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(with_token_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), "decoded"))


#: For the registered queries alone; a user passes a secret of their own.
PII_KEY = "public-test-key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    kinds = F.array_sort(F.array_distinct(F.transform("pii", lambda e: e.kind)))
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), kinds.alias("kinds"), "pii")


def op4_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_table_path(spark, "token-index")
    token_index.write_index(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    index = token_index.read_index(spark, folder)
    rows = token_index.read_documents(index).join(token_index.shard_starts(index), "shard")
    return rows.select("doc_id", (F.col("shard_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def indexed_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = new_table_path(spark, "word-index")
    decontamination.build_index(docs, folder)
    index = spark.read.schema(decontamination.INDEX_SCHEMA).parquet(folder)
    return decontamination.contamination(index, table(spark, sf_dir, "benchmark"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexed_contamination(spark, table(spark, sf_dir, "documents"), sf_dir)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


OP5_SQL = r"""
WITH tokens AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tokens, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN windows USING (phrase)
), words_hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT t.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM tokens t LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out_column(toxicity.HELD_OUT).alias("held_out"), "score", "predicted")


def fetched_pages(pages: DataFrame) -> DataFrame:
    """The pages as captures of 2024: the second is made from the id."""
    second = F.pmod(F.col("page_id") * 7919, F.lit(366 * 86400))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + second).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made from the pages' own hosts: what they say comes from digits of the md5 of the pattern.

    Every host, every domain above one and every first folder is listed by one list; it is
    unlisted after 60 days and, for some, listed again after 120.
    """
    urls = pages.select(url_filter.url_host(F.col("url")).alias("host"), url_filter.url_path(F.col("url")).alias("path"))
    listed = urls.where("host is not null").select(F.explode(url_filter.patterns(F.col("host"), F.col("path"))).alias("p")).select("p.*").distinct()

    def digit(first: int, size: int):
        return F.conv(F.substring(F.md5(F.concat_ws("|", "kind", "pattern")), first, size), 16, 10).cast("long")

    start = F.lit(1704067200) + digit(1, 3) % 200 * 86400
    named = listed.withColumn("list", F.concat(F.lit("list"), (digit(4, 2) % 4).cast("string")))
    named = named.withColumn("action", F.when(digit(6, 2) % 4 == 0, "allow").otherwise("block")).withColumn("start", start)
    steps = F.array(
        F.struct(F.lit(0).alias("days"), F.lit(True).alias("listed")), F.struct(F.lit(60).alias("days"), F.lit(False).alias("listed")),
        F.struct(F.lit(120).alias("days"), (digit(8, 2) % 2 == 0).alias("listed")),
    )
    return named.withColumn("step", F.explode(steps)).select(
        "list", "action", "kind", "pattern", "step.listed", F.timestamp_seconds(F.col("start") + F.col("step.days") * 86400).alias("at"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # A stored list: Spark can then split the partition of a hot host in the join with it.
    intervals = store(url_filter.validity(list_entries(pages)), "list-intervals")
    return url_filter.judged(fetched_pages(pages), intervals).select(
        "page_id", "host", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "n_active", F.array_join("lists", ",").alias("lists"), "allowed", "blocked")


OP7_SQL = r"""
WITH urls AS (
    SELECT page_id, TIMESTAMP '2024-01-01' + to_seconds(page_id * 7919 % 31622400) AS fetched_at,
        nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS raw_path
    FROM pages
), parts AS (
    SELECT page_id, fetched_at, host, string_split(host, '.') AS labels,
        string_split(regexp_replace(CASE WHEN raw_path = '' THEN '/' ELSE raw_path END, '[^/]*$', ''), '/') AS folders
    FROM urls WHERE host IS NOT NULL
), asked AS (
    SELECT page_id, fetched_at, 'host' AS kind, host AS pattern FROM parts
    UNION ALL
    SELECT page_id, fetched_at, 'domain', array_to_string(labels[i:], '.')
    FROM (SELECT *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM parts)
    UNION ALL
    SELECT page_id, fetched_at, 'prefix', host || array_to_string(folders[1:i], '/') || '/'
    FROM (SELECT *, unnest(range(1, len(folders))) AS i FROM parts)
), listed AS (
    SELECT kind, pattern, md5(kind || '|' || pattern) AS h FROM (SELECT DISTINCT kind, pattern FROM asked)
), named AS (
    SELECT kind, pattern, 'list' || (CAST('0x' || h[4:5] AS BIGINT) % 4) AS list,
        CASE WHEN CAST('0x' || h[6:7] AS BIGINT) % 4 = 0 THEN 'allow' ELSE 'block' END AS action,
        CAST('0x' || h[8:9] AS BIGINT) % 2 = 0 AS again,
        TIMESTAMP '2024-01-01' + to_days(CAST(CAST('0x' || h[1:3] AS BIGINT) % 200 AS INTEGER)) AS start
    FROM listed
), intervals AS (
    SELECT kind, pattern, list, action, start AS valid_from, start + to_days(60) AS valid_to FROM named
    UNION ALL
    SELECT kind, pattern, list, action, start + to_days(120), NULL FROM named WHERE again
), active AS (
    SELECT DISTINCT a.page_id, i.*, CASE i.kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END AS rank
    FROM asked a JOIN intervals i ON a.kind = i.kind AND a.pattern = i.pattern
    WHERE a.fetched_at >= i.valid_from AND (i.valid_to IS NULL OR a.fetched_at < i.valid_to)
), verdicts AS (
    SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
        max(rank) FILTER (action = 'block') AS block, max(rank) FILTER (action = 'allow') AS allow
    FROM active GROUP BY page_id
)
SELECT page_id, host, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, allow IS NOT NULL AS allowed,
    coalesce(block >= coalesce(allow, 0), FALSE) AS blocked
FROM urls LEFT JOIN verdicts USING (page_id)
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s
    FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
), repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
removed AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS place FROM repeated),
kept AS (
    SELECT rid, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
    FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM docs) ANTI JOIN removed USING (rid, place)
    GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
links AS (
    SELECT x.rid AS a, y.rid AS b
    FROM (SELECT p.rid, q.rid AS other, count(*) AS shared FROM shingles p JOIN shingles q ON p.s = q.s AND p.rid <> q.rid GROUP BY ALL) z
    JOIN sizes x ON x.rid = z.rid JOIN sizes y ON y.rid = z.other
    WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reach AS (
    SELECT rid AS a, rid AS b FROM docs
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs d LEFT JOIN sizes USING (rid)
JOIN (SELECT a AS rid, min(e.doc_id) AS component_id FROM reach JOIN docs e ON e.rid = b GROUP BY a) USING (rid)
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out_column(quality.HELD_OUT).alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE bits AS (
    SELECT b::UBIGINT AS b, b::UBIGINT AS c, 0 AS k FROM range(256) t(b)
    UNION ALL
    SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS step FROM bits WHERE k = 8),
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(4294967295::UBIGINT, list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(flatten(list_transform(string_split(id || ':' || run, ''),
            lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)), lambda v: v::UBIGINT)),
        lambda c, v: xor(c >> 8, step[((xor(c, v) & 255) + 1)::BIGINT]))) AS h
    FROM runs, crc
), damaged AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.v = b.word
    UNION
    SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.v = b.word
), best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN top END AS form_n,
        CASE WHEN top >= 10 * w.n THEN (SELECT min(near) FROM near x WHERE x.word = w.word AND x.n = top) END AS form
    FROM words w LEFT JOIN best USING (word)
), walk AS (
    SELECT word, form AS root, 1 AS steps FROM forms WHERE form IS NOT NULL
    UNION ALL
    SELECT k.word, f.form, steps + 1 FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL
)
SELECT word, form, coalesce((SELECT arg_max(root, steps) FROM walk k WHERE k.word = f.word), word) AS root, n, n_near, form_n FROM forms f
"""


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = piece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=None, packed="packed", decoded="decoded")
    return done.select(
        "doc_id", (F.length("packed") / 4).cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_table_path(spark, "search-index")
    ranked_search.write_index(table(spark, sf_dir, "documents"), folder)
    return ranked_search.search(ranked_search.read_index(spark, folder), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), filled AS (SELECT rid, doc_id, w, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM filled),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM filled) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
), items AS (
    SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), asked AS (SELECT iid, term, count(*)::BIGINT AS times FROM (SELECT iid, unnest(w) AS term FROM items) GROUP BY ALL),
scores AS (
    SELECT iid, rid, sum(times * weight * (1000000000 * tf // (1000 * tf + 12 * (75 + 25 * n * n_docs // n_terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN filled USING (rid), totals GROUP BY iid, rid
), ranked AS (
    SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
    FROM scores JOIN filled USING (rid) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (iid) WHERE rank <= 20
"""


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_pii": op3_pii,
    "op4_token_index": op4_token_index,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality": op10_quality,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_ranked_search": op13_ranked_search,
}

SQL: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_url_filter": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}
