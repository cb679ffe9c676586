"""SentencePiece encoding and decoding with merge-type vocabularies: a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from merchantry.llm.piece_table import small_batches, small_groups
from merchantry.llm.spans import SpanTable, joined_texts, per_text
from merchantry.llm.worker_memory import worker_table

_MARK = "▁"  # stands for a space in pieces; here a space stands for both
_SHORT = 40  # characters; longer stretches have an agenda of their own
_NEVER = np.iinfo(np.int32).max


class PieceCodec:
    """Encodes as the library does with a merge-type model: identity normalisation, a space before each text, bytes for
    characters outside the vocabulary.

    All neighbouring symbols that join to a piece lie on an agenda ordered by the piece's score, leftmost first; the
    best is merged and its new neighbours are added, until none is left. Texts are cut where no
    piece holds the two neighbouring bytes together: no merge crosses such a place.
    """

    def __init__(self, path: str, confirmed: bool = True):
        self.confirmed = confirmed
        self.library = SentencePieceProcessor(model_file=path)
        self._check_kind()
        sp = self.library
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i).replace(_MARK, " ") for i in usual]
        scores = np.array([sp.get_score(i) for i in usual])
        order = np.unique(-scores, return_inverse=True)[1].tolist()  # 0 is merged first, equal scores are equal
        self._order = {piece: rank for piece, rank in zip(pieces, order)}
        self._ids = dict(zip(pieces, usual))
        self._bytes = [sp.piece_to_id(f"<0x{value:02X}>") for value in range(256)]
        self._together = np.zeros((256, 256), bool)
        for piece in pieces:
            data = np.frombuffer(piece.encode(), np.uint8)
            self._together[data[:-1], data[1:]] = True
        self._build_pairs(pieces, order)
        self._new_line = np.array(self.agenda("\n"), np.int32)
        self._table = SpanTable(self._encode_new)

    def _build_pairs(self, pieces: list[str], order: list[int]) -> None:
        """All pairs of symbols that join to a piece, sorted, with its order and symbol; a symbol is a piece or a character of one."""
        symbols = {piece: i for i, piece in enumerate(pieces)}
        for char in {char for piece in pieces for char in piece}:
            symbols.setdefault(char, len(symbols))
        self._symbols = len(symbols)
        self._of_char = np.full(0x110000, -1, np.int32)
        for symbol, i in symbols.items():
            if len(symbol) == 1 and symbol in self._ids:
                self._of_char[ord(symbol)] = i
        pairs = sorted(
            (symbols[piece[:k]] * self._symbols + symbols[piece[k:]], order[i], i)
            for i, piece in enumerate(pieces) for k in range(1, len(piece)) if piece[:k] in symbols and piece[k:] in symbols
        )
        self._pair_keys, self._pair_order, self._pair_symbol = (np.array(column, np.int64) for column in zip(*pairs, strict=True))
        self._id_of = np.array([self._ids.get(symbol, -1) for symbol in symbols], np.int32)

    def _check_kind(self) -> None:
        sp = self.library
        marked = f"{_MARK * 3}A{_MARK}é{_MARK}ｱ\n{_MARK}"
        if sp.normalize("  A é ｱ\n ") != marked or any(sp.is_unused(i) for i in range(sp.get_piece_size())) or not sp.is_byte(sp.piece_to_id("<0x00>")):
            raise ValueError("only models without normalisation, with a space before the text and with byte pieces")

    def agenda(self, text: str) -> list[int]:
        """Ids of one stretch of text."""
        order, n = self._order, len(text)
        ends = list(range(1, n + 1))  # of the symbol that starts at each place; 0 where none starts
        begin = list(range(-1, n))  # of the symbol that ends at each place
        agenda = [(order[text[i:i + 2]], i, i + 2) for i in range(n - 1) if text[i:i + 2] in order]
        heapify(agenda)
        while agenda:
            _, i, end = heappop(agenda)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue  # one of the two is part of another symbol by now
            ends[i], ends[middle], begin[end] = end, 0, i
            if i:
                left = begin[i]
                rank = order.get(text[left:end])
                if rank is not None:
                    heappush(agenda, (rank, left, end))
            if end < n:
                right = ends[end]
                rank = order.get(text[i:right])
                if rank is not None:
                    heappush(agenda, (rank, i, right))
        ids: list[int] = []
        at = 0
        while at < n:
            known = self._ids.get(text[at:ends[at]])
            if known is None:
                ids.extend(self._bytes[value] for value in text[at:ends[at]].replace(" ", _MARK).encode())
            else:
                ids.append(known)
            at = ends[at]
        return ids

    def _orders(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and symbol of the piece that each pair of symbols joins to; the order of a pair that doesn't is _NEVER."""
        keys = left.astype(np.int64) * self._symbols + right
        at = np.minimum(np.searchsorted(self._pair_keys, keys), len(self._pair_keys) - 1)
        known = (self._pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(known, self._pair_order[at], _NEVER).astype(np.int32), self._pair_symbol[at].astype(np.int32)

    def agendas(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of many short stretches at once, one a row; `symbols` and the result are filled up with -2.

        A row's agenda is the orders of its neighbouring pairs; each round merges the best pair, leftmost first, of every row.
        """
        out = np.full(symbols.shape, -2, np.int32)
        rows = np.arange(len(symbols))
        order, joined = self._orders(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(symbols.shape[1])
        while len(rows):
            best = order.argmin(1)
            ready = order[np.arange(len(rows)), best] == _NEVER
            if ready.any():
                done = symbols[ready]
                out[rows[ready]] = np.where(done >= 0, self._id_of[done], -2)
                rows, symbols, order, joined, best = (part[~ready] for part in (rows, symbols, order, joined, best))
            if not len(rows):
                break
            each = np.arange(len(rows))
            merged = joined[each, best]
            after = np.minimum(columns + (columns > best[:, None]), len(columns) - 1)
            symbols = np.take_along_axis(symbols, after, 1)
            symbols[each, best] = merged
            symbols[:, -1] = -2
            order, joined = np.take_along_axis(order, np.minimum(after[:, :-1], len(columns) - 2), 1), np.take_along_axis(joined, np.minimum(after[:, :-1], len(columns) - 2), 1)
            order[:, -1] = _NEVER
            for shift in (-1, 0):  # the pairs before and after the merged symbol
                has = each[(best + shift >= 0) & (best + shift < len(columns) - 1)]
                at = best[has] + shift
                order[has, at], joined[has, at] = self._orders(symbols[has, at], symbols[has, at + 1])
        return out

    def _encode_new(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [span.decode() for span in spans]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = self._of_char[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
        firsts = np.cumsum(sizes) - sizes
        short = (sizes <= _SHORT) & (sizes > 1) & (np.minimum.reduceat(symbols, firsts) >= 0)
        alone = np.flatnonzero(~short)
        rows = [self.agenda(texts[i]) for i in alone.tolist()]
        owners = [np.repeat(alone, np.fromiter(map(len, rows), np.int64, len(rows)))]
        ids = [np.fromiter(chain.from_iterable(rows), np.int32)]
        by_size = np.flatnonzero(short)[np.argsort(sizes[short], kind="stable")]
        for part in np.split(by_size, range(4096, len(by_size), 4096)):
            if len(part):
                width = np.arange(int(sizes[part].max()))
                inside = width < sizes[part][:, None]
                found = self.agendas(np.where(inside, symbols[np.minimum(firsts[part][:, None] + width, len(symbols) - 1)], -2))
                owners.append(np.repeat(part, (found != -2).sum(1)))
                ids.append(found[found != -2])
        owner = np.concatenate(owners)
        flat = np.concatenate(ids)[np.argsort(owner, kind="stable")]
        lengths = np.bincount(owner, minlength=len(texts))
        if self.confirmed:
            self._confirm_spans(texts, lengths, flat)
        return lengths, flat

    def _confirm_spans(self, texts: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        """Holds new stretches against the library: one text of them all, kept apart by line breaks that no piece holds."""
        apart = np.repeat([text != "\n" for text in texts], lengths)
        want = flat[apart]
        got = np.array(self.library.encode("\n" + "\n".join(text for text in texts if text != "\n")), np.int32)
        if not np.array_equal(got[1:][got[1:] != self._new_line[0]], want):
            raise ValueError("ids differ from the library's")

    def encode_rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids), with begin and end ids."""
        data, bounds = joined_texts([f" {text.replace(_MARK, ' ')}".encode() if text else b"" for text in texts])
        cut = np.ones(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = ~self._together[data[:-1], data[1:]] & (data[1:] & 0xC0 != 0x80)
        cut[bounds] = True
        places = np.flatnonzero(cut)
        starts = places[:-1]
        lengths, ids = self._table.encode(data, starts, places[1:])
        counts = per_text(lengths, starts, bounds)
        ends = np.cumsum(counts)
        firsts = np.insert(ids, ends - counts, self.library.bos_id())
        return counts + 2, np.insert(firsts, ends + np.arange(1, len(ends) + 1), self.library.eos_id())

    def confirm(self, texts: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        """Raises where the library encodes otherwise."""
        rows = self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        if not np.array_equal(sizes, counts) or not np.array_equal(np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum())), ids):
            raise ValueError("ids differ from the library's")


@worker_table
def _codec(path: str, confirmed: bool = True) -> PieceCodec:
    return PieceCodec(path, confirmed)


def _rows_of(flat: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    values, ends = flat.tolist(), offsets.tolist()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def encode(
    df: DataFrame, path: str, text: str = "text", ids: str | None = "token_ids", packed: str | None = None,
    decoded: str | None = None, confirmed: bool = True,
) -> DataFrame:
    """Adds the ids of every whole text, with begin and end ids, as the columns that are named.

    `ids` is an array of ints, `packed` the same as little-endian unsigned 32-bit integers in one
    binary, `decoded` what the library decodes from them. With `confirmed` the sentencepiece library also
    encodes, batch by batch, every stretch that the worker meets anew; a difference stops the job. `path` is a
    merge-type model that every executor can read. A null text counts as empty and gets the begin
    and end ids alone; texts of any length are encoded whole; columns of these names are
    replaced; repeated rows, other columns and an empty table pass as they are.
    """
    kinds = {ids: T.ArrayType(T.IntegerType()), packed: T.BinaryType(), decoded: T.StringType()}
    fields = [T.StructField(name, kind) for name, kind in kinds.items() if name]
    df = small_batches(df).drop(*[field.name for field in fields if field.name in df.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, confirmed)
        for batch in batches:
            at = 0
            for group in small_groups([value or "" for value in batch.column(text).to_pylist()], 400_000):
                counts, flat = codec.encode_rows(group)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                out = []
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32())))
                if packed:
                    out.append(pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(group), [None, pa.py_buffer(offsets.astype(np.int64) * 4), pa.py_buffer(flat.astype("<u4"))]
                    ).cast(pa.binary()))
                if decoded:
                    out.append(pa.array(codec.library.decode(_rows_of(flat, offsets), num_threads=1), pa.string()))
                part = batch.slice(at, len(group))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *[field.name for field in fields]])
                at += len(group)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def decode(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text that the library decodes from an array of ids; null ids give empty text, unknown ids raise."""
    df = df.drop(*[decoded] * (decoded in df.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _codec(path).library
        for batch in batches:
            rows = [row or [] for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(library.decode(rows, num_threads=1) if rows else [], pa.string())], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())]))
