"""Passages that occur more than once in a corpus, found by windows whose length doubles level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from merchantry.llm.byte_words import DARK, Words, find_words, window_hashes
from merchantry.llm.text_blocks import Asked, answers, asks, opened_counts, range_bits, store_blocks, unpacked_rows
from merchantry.session import store


def levels(length: int, first: int) -> list[int]:
    """Window lengths: halves of `length`, rounded up, down to `first` or more; each but the first is at most twice
    the one before."""
    out = [length]
    while -(-out[0] // 2) >= first and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def _walked(words: Words, lengths: list[int], counts: list[np.ndarray]) -> Asked | np.ndarray:
    """With counts of all levels, whether each word starts a repeated window of the last length; else what the next
    level asks.

    A window is a candidate when the windows of the length before at its two ends both occur more than once.
    """
    hashes = words.hashes()
    alive = repeated = np.ones(len(hashes) + 1, bool)
    for level, size in enumerate(lengths):
        places, window = window_hashes(hashes, words.first, size)
        kept = alive[places]
        seconds = None
        if size == lengths[-1]:  # this level decides: 32 bits more, of other hashes of the words
            seconds = (window_hashes(words.hashes(seed=1), words.first, size)[1] >> np.uint64(32))[kept]
        places = places[kept]
        asked, distinct = Asked.of(window[kept], seconds)
        if level == len(counts):
            return asked
        repeated = np.zeros(len(hashes) + 1, bool)
        repeated[places] = counts[level][distinct] > 1
        if level + 1 < len(lengths):
            shift = lengths[level + 1] - size
            alive = np.zeros(len(hashes) + 1, bool)
            alive[:len(alive) - shift] = repeated[:-shift] & repeated[shift:]
    return repeated


def _covered(starts: np.ndarray, size: int) -> np.ndarray:
    """Whether each word lies in a window that starts at a marked word."""
    change = np.zeros(len(starts) + size, np.int64)
    at = np.flatnonzero(starts)
    change[at] += 1
    change[at + size] -= 1
    return np.cumsum(change)[:len(starts) - 1] > 0


def _kept_texts(words: Words, removed: np.ndarray) -> pa.Array:
    """Each text's words that aren't removed, joined by single spaces."""
    kept = ~removed
    starts, sizes = words.starts[kept], (words.ends - words.starts)[kept] + 1
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    data = words.data[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
    data[ends - 1] = 32
    bounds = np.r_[0, ends][np.r_[0, np.cumsum(kept)][words.first]]
    raw = data.tobytes()
    return pa.array([raw[a:max(b - 1, a)].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string())


def _spans(words: Words, removed: np.ndarray) -> pa.Array:
    """Each text's runs of removed words as (start, end) word numbers."""
    inside = np.r_[removed, False]
    starts = inside[:-1].copy()
    firsts = words.first[:-1][words.first[:-1] < words.first[1:]]
    starts[1:] &= ~inside[:-2]
    starts[firsts] |= inside[firsts]
    begins = np.flatnonzero(starts)
    stops = np.r_[np.flatnonzero(np.diff(inside.astype(np.int8)) == -1) + 1, len(removed)]
    limit = np.r_[begins[1:], len(removed)]
    finish = np.minimum(stops[np.searchsorted(stops, begins, side="right")], limit)
    owner = np.searchsorted(words.first, begins, side="right") - 1
    rows: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    for i, a, b in zip(owner.tolist(), begins.tolist(), finish.tolist()):
        base = int(words.first[i])
        rows[i].append({"start": a - base, "end": b - base})
    return pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def without_repeats(docs: DataFrame, length: int = 35, first: int = 16) -> DataFrame:
    """doc_id, n_words, n_removed, removed (word spans) and kept_text of each document.

    A word, `[^\\x20\\x09-\\x0D]+`, is removed when it lies in a window of `length` consecutive
    words whose sequence also starts anywhere else, the same document included; windows are
    judged on the input. Windows of the first level (`length` halved down to no fewer than
    `first` words) are counted over the corpus; those that repeat at one length are extended
    to twice that length, `length` at most, and counted again, until no candidates survive
    or `length` is reached. Null texts count as empty, a document with fewer words keeps
    them all, repeated rows are documents of their own and so repeat each other, an empty table
    gives an empty result; other columns are ignored.
    """
    blocks = store_blocks(docs, "text-blocks")
    bits = range_bits(blocks)
    lengths = levels(length, first)
    work = blocks.select("block", "payload")
    for level in range(len(lengths)):
        done = [f"counts{i}" for i in range(level)]

        def asked(row: dict, done: list[str] = done) -> Asked:
            words = find_words(unpacked_rows(row["payload"])[1], DARK, lower=False)
            return _walked(words, lengths, [opened_counts(row[name]) for name in done])

        found = store(answers(asks(work, bits, 2, asked), 2), "window-counts").withColumnRenamed("counts", f"counts{level}")
        work = work.join(found, "block", "left")
    names = [f"counts{i}" for i in range(len(lengths))]
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, texts = unpacked_rows(row["payload"])
                words = find_words(texts, DARK, lower=False)
                removed = _covered(_walked(words, lengths, [opened_counts(row[name]) for name in names]), length)
                sums = np.r_[0, np.cumsum(removed)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(np.diff(words.first)), pa.array(np.diff(sums[words.first])),
                    _spans(words, removed), _kept_texts(words, removed),
                ], names=["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    return work.mapInArrow(run, schema)
