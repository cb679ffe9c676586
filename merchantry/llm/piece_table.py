"""Groups of consecutive texts of bounded size, and Arrow batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Texts are long: rows and bytes that a task holds at once in the JVM and in Python, beside one longer row.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, after the session's Arrow batches are made small where they have Spark's own sizes; others are left."""
    conf = df.sparkSession.conf
    for key, (usual, small) in _BATCH.items():
        if conf.get(key, usual) == usual:
            conf.set(key, small)
    return df


def small_groups(texts: list[str], most_chars: int = 500_000) -> Iterator[list[str]]:
    """Consecutive texts in groups of at most `most_chars` characters; a longer text is alone."""
    group: list[str] = []
    chars = 0
    for text in texts:
        if group and chars + len(text) > most_chars:
            yield group
            group, chars = [], 0
        group.append(text)
        chars += len(text)
    if group:
        yield group


def text_groups(batches: Iterator[pa.RecordBatch], most_chars: int) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of consecutive rows of all batches, at most `most_chars` characters or one longer text at a time.

    Batches have a key and a text; null texts count as empty.
    """
    keys: list = []
    texts: list[str] = []
    chars = 0
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = value or ""
            if texts and chars + len(text) > most_chars:
                yield keys, texts
                keys, texts, chars = [], [], 0
            keys.append(key)
            texts.append(text)
            chars += len(text)
    if texts:
        yield keys, texts
