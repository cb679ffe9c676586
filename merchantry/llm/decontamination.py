"""A positional inverted index of a corpus, and the documents that hold passages of a benchmark.

The index is split by documents: a shard holds whole documents and the positions of all their
words, so every shard answers a query alone and no postings move between machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.byte_words import ALPHANUMERIC, find_words
from merchantry.llm.piece_table import small_batches, text_groups
from merchantry.llm.spans import distinct_spans, span_hashes
from merchantry.llm.worker_memory import lean

INDEX_SCHEMA = """shard long, doc_ids array<long>, n_words array<long>, term_hashes binary, term_ends binary, terms binary,
    counts binary, positions binary"""

# Of the index's files. A row takes megabytes: row groups and pages end by their bytes, looked at row by row (Spark's own first look comes
# after 100 rows), as a task holds a whole row group, and several times its longest column, when it writes or reads it.
_FILES = {
    "compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}
_DOC = 1  # free positions between documents, so that no run of positions goes from one into the next


def _split_bytes(values: np.ndarray) -> bytes:
    """32-bit values as four runs of bytes; the high ones are mostly zero and compress to little."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _joined_bytes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _shard_row(shard: int, doc_ids: list, texts: list[str]) -> list:
    words = find_words([text.encode() for text in texts], ALPHANUMERIC, lower=True)
    first, kind = distinct_spans(words.data, words.starts, words.ends)  # told apart by their bytes
    hashes = span_hashes(words.data, words.starts[first], words.ends[first])
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(hashes, kind="stable")] = np.arange(len(first))
    position = np.arange(len(kind)) + words.owner * _DOC
    order = np.argsort(rank[kind], kind="stable")
    firsts = np.flatnonzero(np.diff(rank[kind][order], prepend=-1))
    counts = np.diff(np.r_[firsts, len(order)])
    position = position[order]
    gaps = np.diff(position, prepend=0)
    gaps[firsts] = position[firsts]
    example = order[firsts]
    sizes = words.ends[example] - words.starts[example]
    ends = np.cumsum(sizes)
    spelled = words.data[np.repeat(words.starts[example] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
    return [
        shard, doc_ids, np.diff(words.first).tolist(), np.sort(hashes).astype("<u8").tobytes(), ends.astype("<u4").tobytes(),
        spelled.tobytes(), counts.astype("<u4").tobytes(), _split_bytes(gaps),
    ]


def build_index(docs: DataFrame, folder: str, shard_chars: int = 2_000_000) -> None:
    """Writes the index of the words of all whole texts (`doc_id`, `text`) as Parquet, one row per shard.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are put into lower case. A shard has
    documents of at most `shard_chars` characters together, or one longer document. A null text
    has no words but is listed, null and repeated doc_ids are kept as they are, other columns
    are ignored, and an empty table gives an empty index.
    """
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 5]
    names = ["shard", "doc_ids", "n_words", "term_hashes", "term_ends", "terms", "counts", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for keys, texts in text_groups(batches, shard_chars):
            row = _shard_row(shard, keys, texts)
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names=names)
            shard += 1

    small_batches(docs).select("doc_id", "text").mapInArrow(lean(run), INDEX_SCHEMA).write.mode("overwrite").options(**_FILES).parquet(folder)


class Shard:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.number, self.doc_ids = row["shard"], row["doc_ids"]
        self.n_words = np.array(row["n_words"], np.int64)
        #: The first position of each document.
        self.firsts = np.cumsum(self.n_words + _DOC) - (self.n_words + _DOC)
        self._hashes = np.frombuffer(row["term_hashes"], "<u8")
        self._ends = np.frombuffer(row["term_ends"], "<u4").astype(np.int64)
        self._terms = row["terms"]
        self._counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self._starts = np.cumsum(self._counts) - self._counts
        self._gaps = _joined_bytes(row["positions"])

    def find(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Number of each term in this shard, or -1; hashes find it, its bytes confirm it."""
        out = np.full(len(hashes), -1)
        at = np.searchsorted(self._hashes, hashes)
        near = np.flatnonzero(at < len(self._hashes))
        for i in near[self._hashes[at[near]] == hashes[near]].tolist():
            place = int(at[i])
            while place < len(self._hashes) and self._hashes[place] == hashes[i]:
                if self._terms[self._ends[place - 1] if place else 0:self._ends[place]] == terms[i]:
                    out[i] = place
                place += 1
        return out

    def count(self, found: np.ndarray) -> np.ndarray:
        return np.where(found >= 0, self._counts[found], 0) if len(self._counts) else np.zeros(len(found), np.int64)

    def postings(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `found`, position) of all occurrences of those terms, each term's in ascending order."""
        counts = self.count(found)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(np.where(found >= 0, self._starts[found] if len(self._starts) else 0, 0) - (ends - counts), counts)
        gaps = self._gaps[at + np.arange(total)]
        sums = np.cumsum(gaps)
        before = np.r_[0, sums][ends - counts]
        return np.repeat(np.arange(len(found)), counts), sums - np.repeat(before, counts)

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, positions, side="right") - 1


class Phrases:
    """Phrases of at most `width` words, given as rows of term numbers padded with -1."""

    def __init__(self, terms: list[bytes], hashes: np.ndarray, rows: np.ndarray, item_ids: list):
        self.terms, self.hashes, self.rows, self.item_ids = terms, hashes, rows, item_ids
        self.sizes = (rows >= 0).sum(axis=1)

    @classmethod
    def windows(cls, items: list[tuple], width: int) -> Phrases:
        """All windows of `width` consecutive words of (item_id, text) rows; a shorter text is one window."""
        words = find_words([(text or "").encode() for _, text in items], ALPHANUMERIC, lower=True)
        spelled = words.texts()
        terms = sorted(set(spelled))
        number = {term: i for i, term in enumerate(terms)}
        flat = [number[term] for term in spelled]
        rows: dict = {}
        for i, (item_id, _) in enumerate(items):
            own = flat[words.first[i]:words.first[i + 1]]
            for start in range(max(len(own) - width, 0) + 1 if own else 0):
                window = tuple(own[start:start + width])
                rows.setdefault((window, item_id), None)
        owners = [item_id for _, item_id in rows]
        table = np.full((len(rows), width), -1, np.int64)
        for i, (window, _) in enumerate(rows):
            table[i, :len(window)] = window
        return cls(terms, _term_hashes(terms), table, owners)


def _term_hashes(terms: list[bytes]) -> np.ndarray:
    words = find_words(terms, ALPHANUMERIC, lower=False)
    if len(words.starts) != len(terms):
        raise ValueError("each term must be one word")
    return words.hashes()


def phrase_starts(shard: Shard, phrases: Phrases, most_candidates: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position) of every occurrence in a shard.

    The rarest term's positions, less its offset in the phrase, are the candidates; the lists of the
    other terms, from the rarer to the commoner, are intersected with them one by one.
    """
    found = shard.find(phrases.terms, phrases.hashes)
    counts = shard.count(found)
    inside = phrases.rows >= 0
    here = np.flatnonzero(((counts[phrases.rows] > 0) | ~inside).all(axis=1) & inside.any(axis=1))
    none = np.zeros(0, np.int64)
    if not len(here):
        return none, none
    needed = np.unique(phrases.rows[here])
    needed = needed[needed >= 0]
    index, positions = shard.postings(found[needed])
    span = int(positions.max()) + 1 + 2 * phrases.rows.shape[1]
    keys = index * span + positions  # ascending: all lists one after the other
    slot = np.full(len(phrases.terms), -1)
    slot[needed] = np.arange(len(needed))
    list_start = np.searchsorted(index, np.arange(len(needed)))
    weight = np.where(inside[here], counts[phrases.rows[here]], np.iinfo(np.int64).max)
    order = np.argsort(weight, axis=1, kind="stable")
    rare = phrases.rows[here, order[:, 0]]
    per_phrase = counts[rare]
    out_phrase, out_start = [], []
    block = np.cumsum(per_phrase) // most_candidates
    for number in np.unique(block).tolist():
        part = np.flatnonzero(block == number)
        phrase = np.repeat(part, per_phrase[part])
        ends = np.cumsum(per_phrase[part])
        at = np.repeat(list_start[slot[rare[part]]] - (ends - per_phrase[part]), per_phrase[part]) + np.arange(int(ends[-1]))
        start = positions[at] - order[phrase, 0]
        phrase, start = phrase[start >= 0], start[start >= 0]
        for rank in range(1, phrases.rows.shape[1]):
            offset = order[phrase, rank]
            term = phrases.rows[here[phrase], offset]
            wanted = slot[term] * span + start + offset
            place = np.searchsorted(keys, wanted)
            place[place == len(keys)] = 0
            keep = (term < 0) | (keys[place] == wanted)
            phrase, start = phrase[keep], start[keep]
            if not len(phrase):
                break
        out_phrase.append(here[phrase])
        out_start.append(start)
    return np.concatenate(out_phrase), np.concatenate(out_start)


def _merged_spans(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of one group joined; groups are numbers."""
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    wide = int(end.max()) + 2 if len(end) else 1
    reach = np.maximum.accumulate(end + group * wide)
    new = np.ones(len(group), bool)
    new[1:] = start[1:] + group[1:] * wide > reach[:-1]
    firsts = np.flatnonzero(new)
    lasts = np.r_[firsts[1:], len(group)] - 1 if len(group) else firsts
    return group[firsts], start[firsts], reach[lasts] - group[firsts] * wide


def phrase_matches(index: DataFrame, phrases: Phrases) -> DataFrame:
    """(shard, doc_no, doc_id, item_id, start, end) of the words that phrases of an item cover in a document.

    `start` and `end` count words of the document; overlapping occurrences of one item are one
    span. The phrases go to every task: the caller bounds them.
    """
    numbers: dict = {}
    item = np.array([numbers.setdefault(i, len(numbers)) for i in phrases.item_ids], np.int64)
    ids = np.array(list(numbers), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                phrase, at = phrase_starts(shard, phrases)
                if not len(phrase):
                    continue
                doc = shard.document(at)
                group, start, end = _merged_spans(doc * len(ids) + item[phrase], at, at + phrases.sizes[phrase])
                doc = group // len(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard.number] * len(doc), pa.int64()), pa.array(doc),
                    pa.array([shard.doc_ids[i] for i in doc.tolist()], pa.int64()), pa.array(ids[group % len(ids)]),
                    pa.array(start - shard.firsts[doc]), pa.array(end - shard.firsts[doc]),
                ], names=["shard", "doc_no", "doc_id", "item_id", "start", "end"])

    return index.mapInArrow(lean(run), "shard long, doc_no long, doc_id long, item_id long, start long, end long")


def proximity_matches(index: DataFrame, words: list[str], within: int) -> DataFrame:
    """(shard, doc_no, doc_id, start, end) of each shortest run of at most `within` words that has all `words`.

    Words are single words of the index, in any case; a word that a document lacks, or an empty index, gives no rows,
    null and repeated doc_ids are told apart by shard and doc_no.
    """
    terms = [word.encode().lower() for word in dict.fromkeys(words)]
    hashes = _term_hashes(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                found = shard.find(terms, hashes)
                if not (shard.count(found) > 0).all():
                    continue
                index_of, positions = shard.postings(found)
                lists = [positions[index_of == i] for i in range(len(terms))]
                starts = np.sort(positions)
                ends = starts
                for own in lists:
                    place = np.searchsorted(own, starts)
                    ends = np.maximum(ends, np.r_[own, np.iinfo(np.int64).max - 1][place])
                doc = shard.document(starts)
                fits = (ends < starts + within) & (ends < shard.firsts[doc] + shard.n_words[doc])
                # A run is shortest when the next one ends later.
                fits &= np.r_[ends[1:], np.iinfo(np.int64).max] > ends
                doc, starts, ends = doc[fits], starts[fits], ends[fits]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard.number] * len(doc), pa.int64()), pa.array(doc),
                    pa.array([shard.doc_ids[i] for i in doc.tolist()], pa.int64()),
                    pa.array(starts - shard.firsts[doc]), pa.array(ends + 1 - shard.firsts[doc]),
                ], names=["shard", "doc_no", "doc_id", "start", "end"])

    return index.mapInArrow(lean(run), "shard long, doc_no long, doc_id long, start long, end long")


def benchmark_blocks(benchmark: DataFrame, width: int, block_chars: int) -> Iterator[Phrases]:
    """The windows of the benchmark, in blocks of items of at most `block_chars` characters (or one item)."""
    held: list[tuple] = []
    chars = 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null").toLocalIterator():
        if held and chars + len(text or "") > block_chars:
            yield Phrases.windows(held, width)
            held, chars = [], 0
        held.append((item_id, text))
        chars += len(text or "")
    if held:
        yield Phrases.windows(held, width)


def contamination(
    index: DataFrame, benchmark: DataFrame, width: int = 13, words_per_hit: int = 20, block_chars: int = 20_000_000
) -> DataFrame:
    """One row per indexed document: doc_id, n_words, n_hit, item_ids (sorted as text), spans, contaminated.

    An item's windows are each `width` consecutive words, or the whole item if it has fewer. A
    document word inside an occurrence of a window is hit; a document is contaminated when a
    word is hit and it has at most `words_per_hit` words for each hit. The benchmark is a query set
    read in bounded blocks, each searched in all shards. Documents without words, null texts and
    items without words hit nothing; benchmark rows with a null item_id are left out, those with
    one item_id count as one item; repeated documents have a row each.
    """
    docs = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc_no", "doc")).select(
        "shard", F.col("doc_no").cast("long").alias("doc_no"), F.col("doc.doc_ids").alias("doc_id"), "doc.n_words"
    )
    spans = None
    for phrases in benchmark_blocks(benchmark, width, block_chars):
        found = phrase_matches(index, phrases)
        spans = found if spans is None else spans.unionByName(found)
    if spans is None:
        spans = phrase_matches(index, Phrases.windows([], width))
    span = F.struct("start", "end", "item_id")
    hits = spans.groupBy("shard", "doc_no").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    # Words under spans in order of their starts: what each adds beyond the furthest end so far.
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda held, s: F.struct(
            (held.n + F.greatest(F.lit(0).cast("long"), s.end - F.greatest(s.start, held.reach))).alias("n"),
            F.greatest(held.reach, s.end).alias("reach"),
        ),
        lambda held: held.n,
    )
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s.item_id.cast("string"))))
    hits = hits.select("shard", "doc_no", "spans", covered.alias("n_hit"), items.alias("item_ids"))
    none = F.array().cast("array<string>")
    return docs.join(hits, ["shard", "doc_no"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"), "spans",
        F.coalesce((F.col("n_hit") > 0) & (words_per_hit * F.col("n_hit") >= F.col("n_words")), F.lit(False)).alias("contaminated"),
    )
