"""Ranked lexical search: best-first document intervals under range-maximum bounds.

The index has a row for each shard of whole documents: its terms with their posting lists. A search
takes a shard and a block of queries to a task. There every posting list of a query term gets its
impacts and one sparse table that gives the largest impact between any two places. An interval of
documents is bounded by the sum of its terms' largest impacts; the interval with the highest bound
is opened first, split at the document of its largest impact, and intervals that can't reach the
best results so far are never opened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchantry.llm.byte_words import ALPHANUMERIC, find_words
from merchantry.llm.piece_table import small_batches, small_groups, text_groups
from merchantry.llm.spans import distinct_spans, span_hashes
from merchantry.session import store

INDEX_SCHEMA = """shard long, n_docs long, n_filled long, n_terms long, doc_ids array<long>, sizes binary, terms binary, term_sizes binary,
    list_sizes binary, documents binary, counts binary"""
_LEAF = 64  # documents; smaller intervals are scored whole
_OPENED = 16  # intervals of a query that are opened together
_MAX_POSTINGS = 1_000_000  # of the queries that share a sparse table


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype("<u4").tobytes(), 3)


def _opened(payload: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(payload), "<u4").astype(np.int64)


def _shard(keys: list[int | None], texts: list[str]) -> dict:
    """Documents in ascending order of their ids, terms with their lists of (document, count)."""
    by_id = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0))
    words = find_words([texts[i].encode() for i in by_id], ALPHANUMERIC, True)
    sizes = np.diff(words.first)
    first, kind = distinct_spans(words.data, words.starts, words.ends)
    postings, counts = np.unique(kind * len(keys) + words.owner, return_counts=True)
    raw = words.data.tobytes()
    terms = [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())]
    return {
        "n_docs": len(keys), "n_filled": int((sizes > 0).sum()), "n_terms": int(sizes.sum()), "doc_ids": [keys[i] for i in by_id],
        "sizes": _packed(sizes), "terms": zstandard.compress(b"".join(terms), 3), "term_sizes": _packed(np.array([len(t) for t in terms])),
        "list_sizes": _packed(np.bincount(postings // len(keys), minlength=len(terms))),
        "documents": _packed(postings % len(keys)), "counts": _packed(counts),
    }


_KINDS = {
    "shard": pa.int64(), "n_docs": pa.int64(), "n_filled": pa.int64(), "n_terms": pa.int64(), "doc_ids": pa.list_(pa.int64()),
    **dict.fromkeys(("sizes", "terms", "term_sizes", "list_sizes", "documents", "counts"), pa.binary()),
}


def write_index(docs: DataFrame, folder: str, shard_chars: int = 4_000_000) -> None:
    """Writes the posting lists of every whole text: one row for each shard of at most `shard_chars` characters.

    A longer document is a shard of its own. A null or empty text has no terms; a document without
    id is indexed with a null id; repeated rows are documents of their own; other columns are
    ignored; an empty table writes no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for keys, texts in text_groups(batches, shard_chars):
            row = {"shard": number, **_shard(keys, texts)}
            yield pa.RecordBatch.from_arrays([pa.array([row[name]], kind) for name, kind in _KINDS.items()], names=list(_KINDS))
            number += 1

    small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX_SCHEMA).write.mode("overwrite").parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of an index."""
    return spark.read.schema(INDEX_SCHEMA).parquet(folder)


@dataclass
class Terms:
    """Distinct terms of a shard or of queries, found by hash and confirmed by bytes."""

    raw: bytes
    ends: np.ndarray

    def __post_init__(self) -> None:
        self.starts = self.ends - np.diff(self.ends, prepend=0)
        self._hashes = span_hashes(np.frombuffer(self.raw, np.uint8), self.starts, self.ends) if len(self.ends) else np.zeros(0, np.uint64)
        self._order = np.argsort(self._hashes, kind="stable")
        self._hashes = self._hashes[self._order]

    def term(self, i: int) -> bytes:
        return self.raw[self.starts[i]:self.ends[i]]

    def find(self, other: Terms) -> np.ndarray:
        """For each of other's terms its number here, or -1."""
        out = np.full(len(other.ends), -1)
        at = np.searchsorted(self._hashes, other._hashes)
        near = np.flatnonzero(at < len(self._hashes))
        for i in near[self._hashes[at[near]] == other._hashes[near]].tolist():
            own, place = int(other._order[i]), int(at[i])
            while place < len(self._hashes) and self._hashes[place] == other._hashes[i]:
                if self.term(int(self._order[place])) == other.term(own):
                    out[own] = self._order[place]
                place += 1
        return out


@dataclass
class Queries:
    """A block of queries: query i holds the distinct terms term_of[first[i]:first[i + 1]], each `repeats` times."""

    terms: Terms
    term_of: np.ndarray
    repeats: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Queries:
        words = find_words([text.encode() for text in texts], ALPHANUMERIC, True)
        first, kind = distinct_spans(words.data, words.starts, words.ends)
        raw = words.data.tobytes()
        own = [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())]
        keys, repeats = np.unique(words.owner * max(len(own), 1) + kind, return_counts=True)
        owner, term_of = np.divmod(keys, max(len(own), 1))
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        return cls(Terms(b"".join(own), np.cumsum([len(t) for t in own], dtype=np.int64)), term_of, repeats, bounds)


def _query_blocks(items: DataFrame, block_chars: int) -> DataFrame:
    """Stored items with a block and a place in it; a block has at most `block_chars` characters, or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [text or "" for text in batch.column("__text").to_pylist()]
            at = 0
            for group in small_groups(texts, block_chars):
                part = batch.slice(at, len(group))
                places = [pa.array([block] * len(group), pa.int64()), pa.array(range(len(group)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*places, *part.columns], names=["block", "place", *part.schema.names])
                block, at = block + 1, at + len(group)

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.col("text").cast("string").alias("__text"))
    return store(rows.mapInArrow(run, f"block long, place long, item_id {kind}, __text string"), "search-items")


class _Lists:
    """The posting lists of a block's terms in one shard: one flat array of impacts under one sparse table of largest places."""

    def __init__(self, documents: np.ndarray, impacts: np.ndarray, bounds: np.ndarray, n_docs: int):
        self.bounds, self.impacts, self.step = bounds, impacts, n_docs + 1
        self.keys = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * self.step + documents
        self.documents = documents
        levels = [np.arange(len(impacts), dtype=np.int32)]
        widest = int(np.diff(bounds).max(initial=1))
        while 2 << len(levels) - 1 <= widest:
            half = 1 << len(levels) - 1
            below = levels[-1]
            left, right = below[:-half], below[half:]
            levels.append(np.where(impacts[left] >= impacts[right], left, right))
        self._levels = levels

    def places(self, lists: np.ndarray, document: np.ndarray) -> np.ndarray:
        """First place in each list at or after a document."""
        return np.searchsorted(self.keys, lists * self.step + document)

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the largest impact in a:b of one list; b > a."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for j in np.unique(level).tolist():
            at = level == j
            left, right = self._levels[j][a[at]], self._levels[j][b[at] - (1 << j)]
            out[at] = np.where(self.impacts[left] >= self.impacts[right], left, right)
        return out


class _Best:
    """The best results of each query so far, over all shards that a task has seen."""

    def __init__(self, n_queries: int, top: int):
        self.top = top
        self.query, self.score, self.doc, self.has_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.floor = np.zeros(n_queries, np.int64)  # a result needs a higher score, or this one and a smaller id
        self.floor_doc = np.full(n_queries, np.iinfo(np.int64).min)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, has_id: np.ndarray) -> None:
        columns = [np.concatenate(pair) for pair in zip((self.query, self.score, self.doc, self.has_id), (query, score, doc, has_id))]
        order = np.lexsort((columns[2], columns[3], -columns[1], columns[0]))
        query = columns[0][order]
        starts = np.searchsorted(query, np.arange(len(self.floor)))
        rank = np.arange(len(query)) - starts[query]
        self.query, self.score, self.doc, self.has_id = (column[order][rank < self.top] for column in columns)
        last = np.flatnonzero(rank[rank < self.top] == self.top - 1)
        self.floor[self.query[last]] = self.score[last]
        self.floor_doc[self.query[last]] = np.where(self.has_id[last], self.doc[last], np.iinfo(np.int64).min)

    def within(self, query: np.ndarray, bound: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a score up to `bound` for ids from `doc` on could still enter."""
        return (bound > self.floor[query]) | (bound == self.floor[query]) & (bound > 0) & (doc <= self.floor_doc[query])


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within the owner) of as many entries as each owner counts."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _search(
    lists: _Lists, list_of: np.ndarray, repeats: np.ndarray, first: np.ndarray, queries: np.ndarray, ids: np.ndarray, has_id: np.ndarray, best: _Best
) -> None:
    """Best-first search of one shard for `queries`; query i has the lists list_of[first[i]:first[i + 1]]."""
    sizes = np.diff(first)

    def terms_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, place = _ragged(sizes[which])
        at = first[which][owner] + place
        return owner, list_of[at], repeats[at]

    def bounded(which: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of each interval of documents, and the document where it is split."""
        owner, own_lists, times = terms_of(which)
        a, b = lists.places(own_lists, low[owner]), lists.places(own_lists, high[owner])
        some = b > a
        owner, times, place = owner[some], times[some], lists.largest(a[some], b[some])
        value = lists.impacts[place] * times
        bound, split = np.zeros(len(which), np.int64), low.copy()
        np.add.at(bound, owner, value)
        order = np.lexsort((value, owner))
        last = np.flatnonzero(np.diff(owner[order], append=-1))
        split[owner[order][last]] = lists.documents[place[order][last]]
        return bound, split

    def offer(which: np.ndarray, score: np.ndarray, document: np.ndarray) -> None:
        good = (score > 0) & best.within(queries[which], score, ids[document])
        best.add(queries[which[good]], score[good], ids[document[good]], has_id[document[good]])

    which = np.flatnonzero(sizes)
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(ids))
    bound, split = bounded(which, low, high)
    while len(which):
        alive = best.within(queries[which], bound, ids[low])
        which, low, high, bound, split = (column[alive] for column in (which, low, high, bound, split))
        order = np.lexsort((low, -bound, which))
        which, low, high, bound, split = (column[order] for column in (which, low, high, bound, split))
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        opened, leaf = rank < _OPENED, high - low <= _LEAF
        small = opened & leaf
        if small.any():
            owner, own_lists, times = terms_of(which[small])
            a, b = lists.places(own_lists, low[small][owner]), lists.places(own_lists, high[small][owner])
            entry, place = _ragged(b - a)
            at = a[entry] + place
            scores = np.zeros(int(small.sum()) * _LEAF, np.int64)
            np.add.at(scores, owner[entry] * _LEAF + lists.documents[at] - low[small][owner[entry]], lists.impacts[at] * times[entry])
            hit = np.flatnonzero(scores)
            offer(which[small][hit // _LEAF], scores[hit], low[small][hit // _LEAF] + hit % _LEAF)
        wide = opened & ~leaf
        if wide.any():
            owner, own_lists, times = terms_of(which[wide])
            at = lists.places(own_lists, split[wide][owner])
            there = np.flatnonzero(lists.keys[np.minimum(at, len(lists.keys) - 1)] == own_lists * lists.step + split[wide][owner])
            scores = np.zeros(int(wide.sum()), np.int64)
            np.add.at(scores, owner[there], lists.impacts[at[there]] * times[there])
            offer(which[wide], scores, split[wide])
        children = [(which[wide], low[wide], split[wide]), (which[wide], split[wide] + 1, high[wide])]
        new = [np.concatenate(column) for column in zip(*children)]
        filled = new[2] > new[1]
        new = [column[filled] for column in new]
        old = [column[~opened] for column in (which, low, high, bound, split)]
        which, low, high, bound, split = (np.concatenate(pair) for pair in zip(old, (*new, *bounded(*new))))


def _search_shard(row: dict, queries: Queries, weights: np.ndarray, filled: int, length: int, best: _Best) -> None:
    known = Terms(zstandard.decompress(row["terms"]), np.cumsum(_opened(row["term_sizes"]), dtype=np.int64)).find(queries.terms)
    sizes, list_sizes = _opened(row["sizes"]), _opened(row["list_sizes"])
    list_starts = np.cumsum(list_sizes) - list_sizes
    documents, counts = _opened(row["documents"]), _opened(row["counts"])
    ids = np.array([np.iinfo(np.int64).min if key is None else key for key in row["doc_ids"]], np.int64)
    has_id = np.array([key is not None for key in row["doc_ids"]], bool)
    # Entries of queries whose term is in the shard, with the postings that they need.
    present = known[queries.term_of] >= 0
    owner = np.repeat(np.arange(len(queries.first) - 1), np.diff(queries.first))[present]
    terms, repeats = queries.term_of[present], queries.repeats[present]
    needed = np.concatenate([[0], np.cumsum(list_sizes[known[terms]])])
    at = 0
    while at < len(owner):  # as many queries at a time as their posting lists allow
        first_query = owner[at]
        last_query = owner[np.searchsorted(needed, needed[at] + _MAX_POSTINGS, side="right") - 2] if needed[-1] - needed[at] > _MAX_POSTINGS else owner[-1] + 1
        end = int(np.searchsorted(owner, max(last_query, first_query + 1)))
        group, list_of = np.unique(terms[at:end], return_inverse=True)
        own = known[group]
        bounds = np.concatenate([[0], np.cumsum(list_sizes[own])])
        entry, place = _ragged(list_sizes[own])
        posting = list_starts[own][entry] + place
        docs, tf = documents[posting], counts[posting]
        norm = 100 - 25 + 25 * sizes[docs] * filled // length
        impacts = weights[group][entry] * (1_000_000_000 * tf // (1000 * tf + 12 * norm))
        which, starts = np.unique(owner[at:end], return_index=True)
        _search(
            _Lists(docs, impacts, bounds, len(ids)), list_of, repeats[at:end], np.append(starts, end - at), which, ids, has_id, best
        )
        at = end


def term_frequencies(index: DataFrame, block: DataFrame) -> DataFrame:
    """(term, df) of the block's terms that occur: counted in each shard, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[bytes, Queries] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["queries"] not in queries:
                    queries = {row["queries"]: Queries.of(_texts(row["queries"]))}
                mine = queries[row["queries"]].terms
                known = Terms(zstandard.decompress(row["terms"]), np.cumsum(_opened(row["term_sizes"]), dtype=np.int64)).find(mine)
                found = np.flatnonzero(known >= 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([mine.term(i) for i in found.tolist()], pa.binary()), pa.array(_opened(row["list_sizes"])[known[found]], pa.int64()),
                ], names=["term", "df"])

    rows = index.select("terms", "term_sizes", "list_sizes").crossJoin(F.broadcast(block))
    return rows.mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _texts(payload: bytes) -> list[str]:
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_all().column(0).to_pylist()


def _payload(rows: DataFrame) -> DataFrame:
    """One row that holds a block's texts in order."""

    def pack(table: pa.Table) -> pa.Table:
        texts = table.sort_by("place").column("__text")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("text", pa.large_string())])) as writer:
            writer.write_table(pa.table({"text": pa.array([text or "" for text in texts.to_pylist()], pa.large_string())}))
        return pa.table({"queries": pa.array([zstandard.compress(sink.getvalue().to_pybytes(), 3)], pa.binary())})

    return rows.groupBy("block").applyInArrow(pack, "queries binary")


def search(index: DataFrame, items: DataFrame, top: int = 20, block_chars: int = 1_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents for each item, equal scores by ascending doc_id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case.
    With N documents that have terms, L terms in all of them, and df documents with a term, its weight is
    floor(1000 ln((2N + 2) / (2df + 1))), and a document's score the sum, over the item's terms with
    repeats, of weight * (10^9 tf div (1000 tf + 12 m)), m being 75 + 25 n N div L.

    Items are searched in blocks of at most `block_chars` characters (or one longer text): a block
    is what is sent to all tasks at once. Only scores above 0 are returned, so a null or
    empty item, an empty index or a term that no document has gives no row. Every row of `items` is
    an item of its own, with null or repeated ids too; every row of the index is a document;
    one without id ranks before others of its score.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("n_filled").alias("n"), F.sum("n_terms").alias("l")).first()
    filled, length = total.n or 0, total.l or 0
    stored = _query_blocks(items, block_chars)
    blocks = [row.block for row in stored.select("block").distinct().orderBy("block").toLocalIterator()] if length else []
    results = []
    for number in blocks:
        block = store(_payload(stored.where(F.col("block") == number)), "search-block")
        frequencies = store(term_frequencies(index, block), "search-frequencies")
        known = frequencies.agg(F.collect_list(F.struct("term", "df")).alias("known"))  # of one block's terms
        block_rows = block.crossJoin(known)
        results.append(store(_block_results(index, block_rows, filled, length, top).withColumn("block", F.lit(number)), "search-results"))
    kind = items.schema["item_id"].dataType.simpleString()
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return stored.select("block", "place", "item_id").join(found, ["block", "place"]).select("item_id", "rank", "doc_id", "score")


def _block_results(index: DataFrame, block: DataFrame, filled: int, length: int, top: int) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = best = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if queries is None:
                    queries = Queries.of(_texts(row["queries"]))
                    best = _Best(len(queries.first) - 1, top)
                    df = {entry["term"]: entry["df"] for entry in row["known"]}
                    weights = np.array([
                        math.floor(1000 * math.log((2 * filled + 2) / (2 * df.get(queries.terms.term(t), 0) + 1))) for t in range(len(queries.terms.ends))
                    ], np.int64)
                _search_shard(row, queries, weights, filled, length, best)
        if best is not None:
            yield pa.RecordBatch.from_arrays([
                pa.array(best.query, pa.int64()), pa.array(best.doc, pa.int64(), mask=~best.has_id), pa.array(best.score, pa.int64()),
            ], names=["place", "doc_id", "score"])

    best = index.crossJoin(F.broadcast(block)).mapInArrow(run, "place long, doc_id long, score long")
    by_score = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
