"""Token ids of a corpus in compressed shards: one wavelet matrix each, readable without the texts."""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from merchantry.llm.piece_table import small_batches, small_groups
from merchantry.llm.spans import SpanTable, before_stops, joined_texts, per_text
from merchantry.llm.wavelet import WaveletMatrix
from merchantry.llm.worker_memory import worker_table

_MARK = "\x01"
# Words in lower case that normalization leaves as they are: of a-z alone, and with the small letters of U+00DF to U+00FF.
_PLAIN, _WIDE = re.compile(b"[a-z]+"), re.compile(b"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_AZ, _SMALL = np.zeros(256, bool), np.zeros(256, bool)
_AZ[0x61:0x7B] = _SMALL[0x9F:0xC0] = True
_SMALL[0xB7] = False
# Signs of ASCII that end a run of letters or digits; special strings have | after a letter.
_SIGNS = np.zeros(256, bool)
_SIGNS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), 0x7B, 0x7D, 0x7E]] = True
# The character that stands for each byte in vocabularies of bytes; spaces stay, as they part words.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = "".join(map(chr, (b if b in _SHOWN or b == 0x20 else 0x100 + i - sum(s < b for s in _SHOWN) for i, b in enumerate(range(256)))))
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def chunk_spans(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts and ends of chunks, the place where each text begins and the end).

    Chunks lie between spaces and line breaks, cut between a Latin letter or digit and a sign of ASCII but |. A-Z are put
    into lower case, as the tokenizer would, unless marks could combine with them or special strings occur.
    """
    data, bounds = joined_texts([text.encode() for text in texts])
    raw = data.tobytes()
    if lower and b"\xcc" not in raw and b"\xcd" not in raw and b"<|" not in raw:  # the first two begin U+0300 to U+037F
        data = _LOWER[data]
    cut = np.ones(len(data) + 1, bool)
    if len(data):
        blank = _BLANK[data]
        cut[1:-1] = blank[1:] != blank[:-1]
        cut[:-1] |= before_stops(data, _SIGNS)
    cut[bounds] = True
    places = np.flatnonzero(cut)
    starts, ends = places[:-1], places[1:]
    dark = ~_BLANK[data[starts]]
    return data, starts[dark], ends[dark], bounds


SHARD_SCHEMA = """shard long, n_tokens long, doc_ids array<long>, lengths array<long>,
    planes array<binary>, ones array<binary>, zeros array<long>"""


def _is_plain(spans: list[bytes], wide: bool) -> np.ndarray:
    """Whether each span is a word of a-z, or with `wide` also of small letters of U+00DF to U+00FF."""
    data = np.frombuffer(b" ".join(spans) + b" ", np.uint8)
    good = _AZ[data]
    if wide:
        pair = (data[:-1] == 0xC3) & _SMALL[data[1:]]
        good[:-1] |= pair
        good[1:] |= pair
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    starts = np.cumsum(sizes + 1) - sizes - 1
    return np.add.reduceat(good, starts, dtype=np.int64) == sizes


class _PlainWords:
    """The tokenizer's merges alone, for words of small letters, which its other steps leave as they are."""

    def __init__(self, tokenizer: Tokenizer):
        parts = json.loads(tokenizer.to_str())
        suffix = parts["model"].get("end_of_word_suffix")
        plain = {**parts, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self._merges = Tokenizer.from_str(json.dumps(plain))
        vocabulary = parts["model"]["vocab"]
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        self._last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        # Used where it gives what the whole tokenizer gives, as held here on the vocabulary's own words.
        tokens = [token.removesuffix(suffix or "") for token in vocabulary]
        words = [word.encode() for word in tokens[::20] if _PLAIN.fullmatch(word.encode())]
        self.usable = bool(suffix) and self._same(tokenizer, words)
        known = {char: byte for byte, char in enumerate(_BYTE_CHARS)}
        bytes_of = [bytes(known[char] for char in token) for token in tokens if known.keys() >= set(token)]
        letters = [chr(c).encode() for c in range(0xDF, 0x100) if c != 0xF7]
        accented = [word for word in bytes_of if _WIDE.fullmatch(word) and not _PLAIN.fullmatch(word)]
        self.wide = self.usable and self._same(tokenizer, letters + accented + [a + b"e" + b for a in letters for b in letters])

    def _same(self, tokenizer: Tokenizer, words: list[bytes]) -> bool:
        whole = [encoding.ids for encoding in tokenizer.encode_batch_fast([word.decode() for word in words], add_special_tokens=False)]
        lengths, ids = self.encode(words)
        return [len(ids) for ids in whole] == lengths.tolist() and sum(whole, []) == ids.tolist()

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = codecs.charmap_decode(b" ".join(words), "strict", _BYTE_CHARS)[0]
        ids = np.array(self._merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self._last[ids]) + 1
        return np.diff(ends, prepend=0), ids


def chunk_table(tokenizer: Tokenizer) -> SpanTable:
    """Ids of chunks, each encoded by the tokenizer once.

    Right for tokenizers that drop white space, never join text across it or across the change from
    letters and digits to signs, and put text into lower case. New chunks are encoded together,
    with a mark between them that no other chunk holds; words of small letters by the merges alone.
    """
    mark = tokenizer.encode(_MARK, add_special_tokens=False).ids
    plain = _PlainWords(tokenizer)

    def encode_mixed(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        chunks = [span.decode() for span in spans]
        alone = [_MARK in chunk or len(mark) != 1 for chunk in chunks]
        joined = f" {_MARK} ".join("" if single else chunk for chunk, single in zip(chunks, alone))
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        if not any(alone):
            marks = ids == mark[0]
            owner = np.cumsum(marks)[~marks]
            return np.bincount(owner, minlength=len(chunks)), ids[~marks]
        parts = np.split(ids, np.flatnonzero(ids == mark[0])) if len(mark) == 1 else [ids] * len(chunks)
        rows = [
            np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, np.int32) if single else part[part != mark[0]]
            for chunk, single, part in zip(chunks, alone, parts)
        ]
        return np.array([len(row) for row in rows], np.int64), np.concatenate(rows)

    def encode_new(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        simple = _is_plain(spans, plain.wide) if plain.usable else np.zeros(len(spans), bool)
        lengths = np.zeros(len(spans), np.int64)
        parts = []
        for which, run in ((simple, plain.encode), (~simple, encode_mixed)):
            at = np.flatnonzero(which)
            if len(at):
                lengths[at], ids = run([spans[i] for i in at.tolist()])
                parts.append((np.repeat(at, lengths[at]), ids))
        order = np.argsort(np.concatenate([owner for owner, _ in parts]), kind="stable")
        return lengths, np.concatenate([ids for _, ids in parts])[order]

    return SpanTable(encode_new)


@worker_table
def _chunk_table(path: str) -> SpanTable:
    return chunk_table(Tokenizer.from_file(path))


def encode_rows(table: SpanTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each text, all ids)."""
    data, starts, ends, bounds = chunk_spans(texts)
    lengths, ids = table.encode(data, starts, ends)
    return per_text(lengths, starts, bounds), ids


def write_index(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, bits: int = 16, shard_tokens: int = 4_000_000
) -> None:
    """Writes the ids of every whole text, each followed by `end_id`, in ascending order of doc_id.

    Texts are encoded as the tokenizers library does with add_special_tokens=False: strings of
    special tokens in a text give their ids.

    The folder gets Parquet files (zstd) whose rows are shards: whole documents up to
    `shard_tokens` ids (one longer document is a shard of its own), with the ids as a wavelet
    matrix of `bits` planes. Shard numbers ascend with doc_id. A null text counts as empty and
    has the end id alone; null doc_ids come first; rows with one doc_id are in order of
    their text; an empty table writes no shard. Other columns are ignored.
    """
    rows = small_batches(docs).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, shards = _chunk_table(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            if flat.max() >> bits:
                raise ValueError(f"an id needs more than {bits} bits")
            matrix = WaveletMatrix.build(flat, bits)
            row = [part << 32 | shards, matrix.n, doc_ids, lengths, matrix.planes, matrix.ones, matrix.zeros]
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.binary())] * 2, pa.list_(pa.int64())]
            names = ["shard", "n_tokens", "doc_ids", "lengths", "planes", "ones", "zeros"]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names=names)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [text or "" for text in batch.column(1).to_pylist()]
            at = 0
            for group in small_groups(texts):
                counts, flat = encode_rows(table, group)
                flat = np.insert(flat, np.cumsum(counts), end_id)
                ends = np.cumsum(counts + 1)
                first = 0
                for i, end in enumerate(ends.tolist()):
                    size = end - first
                    if lengths and held + size > shard_tokens:
                        yield shard()
                        shards, held, doc_ids, lengths, ids = shards + 1, 0, [], [], []
                    doc_ids.append(keys[at + i])
                    lengths.append(size)
                    ids.append(flat[first:end])
                    held, first = held + size, end
                at += len(group)
        if lengths:
            yield shard()

    rows.mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of an index."""
    return spark.read.schema(SHARD_SCHEMA).parquet(folder)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["planes"], row["ones"], row["zeros"])


def shard_starts(index: DataFrame) -> DataFrame:
    """Ids before each shard: sums over the parts of the write first, then within each part. An empty index has none."""
    sizes = index.select("shard", "n_tokens", F.shiftright("shard", 32).alias("part"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = parts.select(
        "part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("before_part")
    )
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return sizes.withColumn("within", within).join(before, "part").select(
        "shard", (F.col("before_part") + F.col("within")).alias("shard_start")
    )


def read_documents(index: DataFrame) -> DataFrame:
    """(shard, doc_id, start, n_tokens, token_ids, ids_crc32) of each document, decoded from the shards.

    `start` counts from the beginning of the shard; ids_crc32 is over little-endian unsigned 32-bit ids.
    Null and repeated doc_ids come back as they were written, an empty index gives no rows.
    """
    schema = "shard long, doc_id long, start long, n_tokens long, token_ids array<int>, ids_crc32 long"
    names = ["shard", "doc_id", "start", "n_tokens", "token_ids", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _matrix(row).values().astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(ends), pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts),
                    pa.array(row["lengths"], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32))), pa.array(sums, pa.int64()),
                ], names=names)

    return index.mapInArrow(run, schema)


def occurrences(index: DataFrame, token_id: int) -> DataFrame:
    """(shard, doc_id, position in the document) of every occurrence of an id, found by rank and select alone.

    An id that no document has, or an empty index, gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(_matrix(row).occurrences(token_id), np.int64)
                ends = np.cumsum(row["lengths"])
                owner = np.searchsorted(ends, at, side="right")
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(at), pa.int64()),
                    pa.array([row["doc_ids"][i] for i in owner.tolist()], pa.int64()), pa.array(at - starts[owner]),
                ], names=["shard", "doc_id", "position"])

    return index.mapInArrow(run, "shard long, doc_id long, position long")


def token_counts(index: DataFrame, token_ids: list[int]) -> DataFrame:
    """(token_id, n) over the whole index, counted by rank in each shard and summed; ids that don't occur have n 0, an
    empty index gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = _matrix(row)
                counts = [matrix.count(token) for token in token_ids]
                yield pa.RecordBatch.from_arrays([pa.array(token_ids, pa.int64()), pa.array(counts, pa.int64())], names=["token_id", "n"])

    return index.mapInArrow(run, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
