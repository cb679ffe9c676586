"""A corpus pipeline: each stage reads the documents that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm import jaccard_join, pii, queries, toxicity
from merchantry.session import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Names of the stages' own columns, away from those that documents may bring.
_SCORE, _REJECTED, _FOUND, _ROW, _DECODED = "__toxicity", "__toxic", "__pii", "__row", "__decoded"
_WORD, _BITS = "__word", "__bits"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, rejects go; null texts are scored as empty, an empty table
    stays empty."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, (_SCORE, _REJECTED)).where(F.col(_REJECTED) == 0).drop(_SCORE, _REJECTED)


def _numbered(docs: DataFrame) -> DataFrame:
    """Stored rows with a number each, so that rows of null or repeated doc_ids are judged by their own texts."""
    return store(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")


def _row_bits(chosen: DataFrame) -> DataFrame:
    """Stored numbers of rows as bits, 64 rows to a long."""
    word, bit = F.shiftright(_ROW, 6).alias(_WORD), F.expr(f"shiftleft(1L, cast({_ROW} & 63 as int))")
    return store(chosen.groupBy(word).agg(F.bit_or(bit).alias(_BITS)), "row-bits")


def _only(rows: DataFrame, chosen: DataFrame, chosen_go: bool = False) -> DataFrame:
    """The rows whose numbers are chosen, or all others.

    A bit a row goes to the texts, so that these needn't be shuffled to meet a list of numbers as long as their own.
    """
    bits = _row_bits(chosen)
    marked = rows.join(bits, F.shiftright(_ROW, 6) == F.col(_WORD), "left" if chosen_go else "inner")
    is_chosen = F.coalesce(F.getbit(_BITS, F.col(_ROW).bitwiseAND(63)), F.lit(0)) == 1
    return marked.where(~is_chosen if chosen_go else is_chosen).select(rows.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies stays; in doubt rows with a doc_id, and the first.

    Rows are grouped by their texts alone: rows of one doc_id with unlike texts stay, copies without a doc_id go.
    """
    rows = _numbered(docs)
    groups = jaccard_join.similarity_groups(rows.select(F.col(_ROW).alias("doc_id"), "text"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", _ROW)
    first = rows.select(_ROW, "doc_id").join(groups.select(F.col("doc_id").alias(_ROW), "component_id"), _ROW).groupBy("component_id").agg(
        F.min(order).alias("first"))
    return _only(rows, first.select(F.col(f"first.{_ROW}").alias(_ROW))).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which benchmark passages are a twentieth or more go, whatever their doc_id."""
    rows = _numbered(docs)
    found = queries.indexed_contamination(spark, rows.select(F.col(_ROW).alias("doc_id"), "text"), sf_dir)
    return _only(rows, found.where("contaminated").select(F.col("doc_id").alias(_ROW)), chosen_go=True).select(docs.columns)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; n_chars follows the text. Null texts stay null."""
    done = pii.pseudonymised(docs, queries.PII_KEY, found=_FOUND).drop(_FOUND)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def with_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their token ids; the ids are decoded again, and a text that they don't give back stops the run.
    Null texts have no ids."""
    done = queries.with_token_ids(docs, _DECODED)
    same = F.col(_DECODED) == F.coalesce("text", F.lit("")).cast("binary")
    ids = F.when(same, F.col("token_ids")).otherwise(F.raise_error(F.lit("token ids don't decode to their text")))
    return done.withColumn("token_ids", ids).drop(_DECODED)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", with_pseudonyms),
    ("byte_bpe", with_tokens),
]

# The classifier, the pseudonyms and the token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is stored and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
