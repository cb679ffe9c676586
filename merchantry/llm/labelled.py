"""Training rows for classifiers, and scores of whole tables by a fitted model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantry.llm.piece_table import small_batches, small_groups
from merchantry.llm.worker_memory import lean


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], max_rows: int = 8_000, max_chars: int = 20_000_000,
    max_text_chars: int = 200_000,
) -> tuple[list[str], list[int]]:
    """(texts, labels) of a bounded sample of labelled documents.

    `held_out` is (divisor, remainder) of crc32(doc_id as text): those rows are never used. The
    sample has the labelled rows with the smallest hashes of doc_id: at most `max_rows`, and
    only as many as have `max_chars` characters together. A text of more than `max_text_chars`
    is left out and takes no other's place. A document with several labels counts with its highest, one with several
    texts with one of them; null labels and ids are left out, null texts are empty.
    """
    divisor, remainder = held_out
    spread = F.xxhash64(F.col("doc_id").cast("string"))
    known = labels.where(
        F.col(label).isNotNull() & F.col("doc_id").isNotNull()
        & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor != remainder)
    )
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(spread, "doc_id").limit(max_rows)
    # The sample of ids has at most max_rows rows; of texts only lengths are ordered.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    fitting = rows.withColumn("size", F.length("text")).where(F.col("size") <= max_text_chars)
    one = fitting.groupBy("doc_id", "label").agg(F.min(F.struct("size", F.xxhash64("text").alias("draw"))).alias("one")).select("doc_id", "one.*")
    before = F.sum("size").over(Window.orderBy(spread, "doc_id")) - F.col("size")
    taken = one.select("doc_id", "draw", "size", before.alias("before")).where(F.col("before") + F.col("size") <= max_chars).drop("before")
    texts = fitting.withColumn("draw", F.xxhash64("text")).join(F.broadcast(taken.select("doc_id", "draw")), ["doc_id", "draw"])
    found = texts.dropDuplicates(["doc_id"]).orderBy(spread, "doc_id").select("text", "label").collect()
    return [row[0] for row in found], [row[1] for row in found]


def with_scores(
    docs: DataFrame, score: Callable[[list[str]], np.ndarray], threshold: float, text: str = "text",
    names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """`docs` with two columns more: the score, and 1 from the threshold up; null texts count as empty.

    Columns of these names are replaced; repeated rows and an empty table pass as they are.
    """
    docs = small_batches(docs).drop(*[name for name in names if name in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [value or "" for value in batch.column(text).to_pylist()]
            scores = np.concatenate([np.zeros(0), *[score(group) for group in small_groups(texts, 200_000)]])
            out = [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *names])

    fields = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *fields]))


def held_out_column(held_out: tuple[int, int]) -> Column:
    divisor, remainder = held_out
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder
