"""Documents packed into blocks of bounded size, and counts of 64-bit hashes over all blocks.

Counting what billions of windows have in common needs each distinct hash of a block to meet its
equals from other blocks. Blocks send their sorted hashes as packed gaps, one row for each block
and range of hashes; the counts come back in the same order, one byte a hash before compression.
A hash that fills a third of the corpus is sent once by each block, so no range is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.piece_table import small_batches, text_groups
from merchantry.llm.worker_memory import lean
from merchantry.session import store

KEY_BITS = 46  # of a hash; the rest of its identity, where it counts, is a second hash
_HASHES_PER_RANGE = 500_000


def packed_rows(keys: list, texts: list[str]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.large_string())], names=["doc_id", "text"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def unpacked_rows(payload: bytes) -> tuple[list, list[bytes]]:
    """(doc_ids, UTF-8 texts) of a block."""
    table = pa.ipc.open_stream(zstandard.decompress(payload)).read_all()
    return table.column(0).to_pylist(), table.column(1).combine_chunks().cast(pa.large_binary()).to_pylist()


def store_blocks(
    docs: DataFrame, name: str, extra: Callable[[list[bytes]], list] | None = None, extra_schema: str = "",
    extra_types: tuple = (), block_chars: int = 2_000_000,
) -> DataFrame:
    """Stored blocks of whole documents: block, doc_ids, n_bytes, payload, and the columns that `extra` makes of the texts.

    A block has at most `block_chars` characters, or one longer document. Null texts are empty.
    Stored, because answers return by block number: it must not change when a task is run again.
    """
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), *extra_types]
    schema = "block long, doc_ids array<long>, n_bytes long, payload binary" + (f", {extra_schema}" if extra_schema else "")
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for keys, texts in text_groups(batches, block_chars):
            parts = [text.encode() for text in texts]
            row = [block, keys, sum(map(len, parts)), packed_rows(keys, texts), *(extra(parts) if extra else [])]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names=names)
            block += 1

    return store(small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), schema), name)


def range_bits(blocks: DataFrame) -> int:
    """Bits that number the ranges of hashes, from the size of all texts."""
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(3, (n_bytes // 6 // _HASHES_PER_RANGE).bit_length())


@dataclass(frozen=True)
class Asked:
    """Distinct hashes of a block in ascending order, how often each occurs in it, and optionally second hashes."""

    keys: np.ndarray
    counts: np.ndarray
    seconds: np.ndarray | None = None

    @classmethod
    def of(cls, hashes: np.ndarray, seconds: np.ndarray | None = None) -> tuple[Asked, np.ndarray]:
        """With it, the place of each given hash among the distinct ones."""
        keys = hashes >> np.uint64(64 - KEY_BITS)
        order = np.argsort(keys, kind="stable") if seconds is None else np.lexsort((seconds, keys))
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        if seconds is not None:
            seconds = seconds[order]
            new[1:] |= seconds[1:] != seconds[:-1]
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        counts = np.diff(np.r_[firsts, len(keys)])
        return cls(keys[firsts], counts, None if seconds is None else seconds[firsts]), place


def _gaps(keys: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=np.uint64(0))
    return gaps.astype("<u4").tobytes() if not len(gaps) or gaps.max() < 1 << 32 else gaps.astype("<u8").tobytes()


def asks(rows: DataFrame, bits: int, most: int, asked: Callable[[dict], Asked]) -> DataFrame:
    """One row for each block and range with hashes: their gaps, counts up to `most`, and second hashes."""
    schema = "range int, block long, n long, keys binary, counts binary, seconds binary"
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["range", "block", "n", "keys", "counts", "seconds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                mine = asked(row)
                shift = np.uint64(KEY_BITS - bits)
                bounds = np.searchsorted(mine.keys >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
                clipped = np.minimum(mine.counts, most).astype(np.uint8)
                out = []
                for part in np.flatnonzero(np.diff(bounds)).tolist():
                    a, b = bounds[part], bounds[part + 1]
                    own = mine.keys[a:b] - (np.uint64(part) << shift)
                    counts = clipped[a:b]
                    out.append((
                        part, row["block"], int(b - a), _gaps(own),
                        b"" if (counts == 1).all() else zstandard.compress(counts.tobytes()),
                        None if mine.seconds is None else mine.seconds[a:b].astype("<u4").tobytes(),
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out), kinds)] if out else [
                    pa.array([], kind) for kind in kinds], names=names)

    return rows.mapInArrow(lean(run), schema)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    n = row["n"]
    gaps = np.frombuffer(row["keys"], "<u4" if len(row["keys"]) == 4 * n else "<u8").astype(np.uint64)
    counts = np.frombuffer(zstandard.decompress(row["counts"]), np.uint8) if row["counts"] else np.ones(n, np.uint8)
    return np.cumsum(gaps, dtype=np.uint64), counts, None if row["seconds"] is None else np.frombuffer(row["seconds"], "<u4")


def answers(asked: DataFrame, most: int) -> DataFrame:
    """(block, counts): for each block all ranges' counts over all blocks, up to `most`, in the order of its hashes.

    A range's hashes meet in one task; their number is bounded by the number of ranges.
    """

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_opened(row) for row in rows]
        keys = np.concatenate([part[0] for part in parts])
        counts = np.concatenate([part[1] for part in parts])
        if parts[0][2] is None:
            order = np.argsort(keys, kind="stable")
            new = np.r_[True, np.diff(keys[order]) != 0]
        else:
            seconds = np.concatenate([part[2] for part in parts])
            order = np.lexsort((seconds, keys))
            new = np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(seconds[order]) != 0)]
        firsts = np.flatnonzero(new)
        sums = np.add.reduceat(counts[order].astype(np.int64), firsts)
        total = np.empty(len(keys), np.uint8)
        total[order] = np.minimum(sums, most).astype(np.uint8)[np.cumsum(new) - 1]
        ends = np.cumsum([row["n"] for row in rows])
        packed = [zstandard.compress(part.tobytes()) for part in np.split(total, ends[:-1])]
        return pa.table({
            "block": pa.array([row["block"] for row in rows], pa.int64()), "range": pa.array([row["range"] for row in rows], pa.int32()),
            "counts": pa.array(packed, pa.binary()),
        })

    answered = asked.groupBy("range").applyInArrow(count, "block long, range int, counts binary")
    parts = F.array_sort(F.collect_list(F.struct("range", "counts")))
    return answered.groupBy("block").agg(F.transform(parts, lambda part: part.counts).alias("counts"))


def opened_counts(parts: list[bytes] | None) -> np.ndarray:
    """The counts of a block's distinct hashes; a block that asked nothing has none."""
    return np.frombuffer(b"".join(zstandard.decompress(part) for part in parts or []), np.uint8)
