"""Byte-level BPE encoding and decoding by longest matches, compatibility of neighbours and backtracking."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantry.llm.piece_table import small_batches, small_groups
from merchantry.llm.spans import SpanTable, cut_at_spaces, joined_texts, per_text
from merchantry.llm.worker_memory import worker_table

_BREAK = chr(256)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 tokens."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class BytePairCodec:
    """Encodes pieces of bytes exactly as repeated merging of the lowest-ranked pair does.

    A split of a piece is the merge result when each two neighbouring tokens merge back to
    themselves. So tokens are taken longest first, a token must be compatible with the one
    before it, and a position from which no token leads on is left by backtracking; each
    position is given up at most once, which keeps the work linear. Compatibility is worked
    out by merging the two tokens' bytes once and is then remembered.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        # One Latin-1 character for each byte: the automaton then matches bytes.
        self._matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self._matcher.add_word(token.decode("latin-1"), rank)
        self._matcher.make_automaton()
        self._bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._size_of = np.array([len(token) for token in self.tokens], np.int64)
        self._byte_start = np.cumsum(self._size_of) - self._size_of
        self._sizes = [len(token) for token in self.tokens]
        # The longest token that begins each token and is shorter, or -1.
        self._shorter = [self._prefix(token) for token in self.tokens]
        self._compatible: dict[int, bool] = {}

    def _prefix(self, token: bytes) -> int:
        starts = (self.ranks.get(token[:end]) for end in range(len(token) - 1, 0, -1))
        return next((rank for rank in starts if rank is not None), -1)

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging; used on the bytes of two tokens, whose length is bounded."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            at, best = -1, None
            for i, (left, right) in enumerate(pairwise(parts)):
                rank = self.ranks.get(left + right)
                if rank is not None and (best is None or rank < best):
                    at, best = i, rank
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= 200_000:
                self._compatible.clear()
            known = self._compatible[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def backtracked(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 text."""
        sizes, shorter, memo = self._sizes, self._shorter, self._compatible
        longest = [-1] * len(piece)
        for end, token in self._matcher.iter(piece):
            longest[end + 1 - sizes[token]] = token  # those that end later are longer
        chosen: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, last, token = 0, -1, longest[0]
        while at < len(piece):
            while token >= 0:
                after = at + sizes[token]
                if not dead[after]:
                    if last < 0:
                        break
                    fits = memo.get(last << 32 | token)
                    if self.compatible(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                chosen.append(token)
                at, last = after, token
                token = longest[at] if at < len(piece) else -1
            else:
                dead[at] = 1
                token = chosen.pop()
                at -= sizes[token]
                last = chosen[-1] if chosen else -1
                token = shorter[token]
        return chosen

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids): longest matches first, backtracking where neighbours clash."""
        texts = [piece.decode("latin-1") for piece in pieces]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        matches = np.fromiter(chain.from_iterable(self._matcher.iter_long(_BREAK.join(texts))), np.int64).reshape(-1, 2)
        owner = np.searchsorted(np.cumsum(sizes + 1), matches[:, 0], side="right")
        ids = matches[:, 1]
        same = owner[1:] == owner[:-1]
        keys, which = np.unique(ids[:-1][same] << 32 | ids[1:][same], return_inverse=True)
        fits = np.fromiter((self.compatible(key >> 32, key & 0xFFFFFFFF) for key in keys.tolist()), bool, len(keys))
        clashes = np.zeros(len(texts), bool)
        clashes[owner[1:][same][~fits[which]]] = True
        lengths = np.bincount(owner, minlength=len(texts))
        kept = ids[np.repeat(~clashes, lengths)]
        redone = [self.backtracked(texts[i]) for i in np.flatnonzero(clashes).tolist()]
        lengths[clashes] = np.fromiter(map(len, redone), np.int64, len(redone))
        out = np.empty(int(lengths.sum()), np.int32)
        again = np.repeat(clashes, lengths)
        out[~again] = kept
        out[again] = np.fromiter(chain.from_iterable(redone), np.int32)
        return lengths, out

    def decode_rows(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The bytes of rows of ids; row i has ids[offsets[i]:offsets[i + 1]]."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("an id is not in the vocabulary")
        sizes = self._size_of[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self._bytes[np.repeat(self._byte_start[ids] - ends[:-1], sizes) + np.arange(ends[-1])]
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].astype(np.int64)), pa.py_buffer(data)]
        ).cast(pa.binary())


@worker_table
def _codec(path: str) -> BytePairCodec:
    return BytePairCodec(read_ranks(path))


_CLEAN = re.compile(r" ?\S+")


class TextEncoder:
    """Ids of whole texts: stretches between spaces are encoded once a worker, in a table of bounded size."""

    def __init__(self, codec: BytePairCodec, pattern: str):
        self.codec, self._split = codec, regex.compile(pattern)
        self._table = SpanTable(self._encode_new)

    def _encode_new(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # One search over all stretches: a line break between two is a match of its own, unless white
        # space lies inside or at the ends of one; those few are searched alone.
        texts = [span.decode() for span in spans]
        clean = np.fromiter((_CLEAN.fullmatch(text) is not None for text in texts), bool, len(texts))
        parts = self._split.findall("\n".join(texts[i] for i in np.flatnonzero(clean).tolist()))
        rest = [self._split.findall(texts[i]) for i in np.flatnonzero(~clean).tolist()]
        distinct = list({*parts, *chain.from_iterable(rest)})
        lengths, ids = self.codec.encode_pieces([part.encode() for part in distinct])
        starts = np.cumsum(lengths) - lengths
        index = dict(zip(distinct, range(len(distinct))))
        at = np.fromiter(map(index.__getitem__, chain(parts, *rest)), np.int64)
        breaks = at[:len(parts)] == index.get("\n", -1)
        groups = int(breaks.sum()) + 1 if parts else 0
        owner = np.concatenate([np.cumsum(breaks), np.repeat(groups + np.arange(len(rest)), [len(part) for part in rest])])
        keep = np.concatenate([~breaks, np.ones(len(at) - len(breaks), bool)])
        at, owner = at[keep], owner[keep]
        place = np.argsort(~clean, kind="stable")  # back to the order of the stretches: the clean ones came first
        order = np.argsort(place[owner], kind="stable")
        at, owner = at[order], place[owner[order]]
        sizes = lengths[at]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(starts[at] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        return np.bincount(owner, weights=sizes, minlength=len(spans)).astype(np.int64), flat

    def encode_rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        data, bounds = joined_texts([text.encode() for text in texts])
        starts, ends = cut_at_spaces(data, bounds)
        lengths, ids = self._table.encode(data, starts, ends)
        return per_text(lengths, starts, bounds), ids


@worker_table
def _encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(_codec(path), pattern)


def _without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[name for name in names if name in df.columns])


def encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None
) -> DataFrame:
    """Adds the token ids of every whole text as an array of ints; with `decoded`, also the bytes they stand for.

    `path` is a file of base64 tokens and ranks that every executor can read, `pattern` the rule
    that splits texts before merging; it must end a match before white space that follows
    other text, as the public patterns do. A null text counts as empty and gets no ids; texts
    of any length are encoded whole; columns already named `ids` or `decoded` are replaced;
    repeated rows and an empty table pass as they are. `text` is passed on like any column.
    """
    df = _without(small_batches(df), ids, *[decoded] * bool(decoded))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(decoded, T.BinaryType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            texts = [value or "" for value in batch.column(text).to_pylist()]
            at = 0
            for group in small_groups(texts):
                lengths, flat = encoder.encode_rows(group)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                out = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))]
                if decoded:
                    out.append(encoder.codec.decode_rows(offsets, flat))
                part = batch.slice(at, len(group))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *[f.name for f in fields]])
                at += len(group)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def decode(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that an array of token ids stands for; null ids give empty bytes, unknown ids raise."""
    df = _without(df, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            rows = [row or [] for row in batch.column(ids).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64)
            out = codec.decode_rows(offsets, np.fromiter(chain.from_iterable(rows), np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())]))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, number of ids, and checksums of the ids and of the decoded bytes."""
    return df.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
