"""Spans of joined bytes: hashes, exact comparison, and a bounded table from spans to token ids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress, repeat

import numpy as np

_LONG = 512  # bytes; longer spans are hashed one by one
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one to one."""
    values = values ^ values >> np.uint64(33)
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ values >> np.uint64(33)
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ values >> np.uint64(33)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length, eight bytes at a time.

    Every step mixes all bits, so sums of bytes and powers can't cancel out; two seeds give
    two independent hashes. Spans of over 512 bytes get a keyed BLAKE2 digest.
    """
    words = eights(data)
    left = (ends - starts).astype(np.int64)
    out = mixed(left.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))
    out = mixed(out ^ words[starts] & _MASKS[np.minimum(left, 8)])
    at = np.flatnonzero((left > 8) & (left <= _LONG))
    place, rest = starts[at] + 8, left[at] - 8
    while len(at):
        out[at] = mixed((out[at] << np.uint64(1)) + (words[place] & _MASKS[np.minimum(rest, 8)]))
        more = rest > 8
        at, place, rest = at[more], place[more] + 8, rest[more] - 8
    key = seed.to_bytes(16, "little")
    for i in np.flatnonzero(left > _LONG).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, key=key).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def all_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each span has the same bytes as the span whose number `like` gives."""
    left = ends - starts
    if not np.array_equal(left, left[like]):
        return False
    words = eights(data)
    at, other = starts, starts[like]
    while len(at):
        if ((words[at] ^ words[other]) & _MASKS[np.minimum(left, 8)]).any():
            return False
        more = left > 8
        at, other, left = at[more] + 8, other[more] + 8, left[more] - 8
        if len(at) and len(at) * 64 < int(left.sum()):  # few, long spans: whole comparisons
            return all(
                np.array_equal(data[a:a + n], data[b:b + n]) for a, b, n in zip(at.tolist(), other.tolist(), left.tolist())
            )
    return True


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first span of each kind, kind of every span); spans of one kind have equal bytes.

    Found by hash and confirmed by bytes; should two kinds share a hash, all are told apart by a dictionary.
    """
    _, first, kind = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if all_equal(data, starts, ends, first[kind]):
        return first, kind
    raw, index = data.tobytes(), {}
    kind = np.fromiter((index.setdefault(raw[a:b], len(index)) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
    return np.unique(kind, return_index=True)[1], kind


class _Ids:
    """Ids of the spans of one generation of a table, in flat arrays."""

    _ENTRY = 180  # bytes of an entry beside its text: dictionary, string header, number, place and length

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.int32)
        self.used = self.held = 0

    @staticmethod
    def _grown(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, len(array) * 3 // 2) - len(array), array.dtype)])

    def add(self, spans: list[bytes], lengths: np.ndarray, flat: np.ndarray) -> None:
        first, used = len(self.index), self.used
        last, end = first + len(spans), used + len(flat)
        self.starts, self.lengths, self.flat = self._grown(self.starts, last), self._grown(self.lengths, last), self._grown(self.flat, end)
        self.lengths[first:last] = lengths
        self.starts[first:last] = used + np.cumsum(lengths) - lengths
        self.flat[used:end] = flat
        self.used = end
        self.held += sum(map(len, spans)) + 4 * len(flat) + self._ENTRY * len(spans)
        self.index.update(zip(spans, range(first, last)))

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[at].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return lengths, self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)]


class SpanTable:
    """Ids of spans; `encode_new` gets distinct new byte strings and returns (lengths, flat ids) for them, in order.

    Beyond about half of `max_bytes` a new generation begins, to which spans of the one before move as they are
    met again, so memory stays bounded and frequent spans stay known; results don't depend on it.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], max_bytes: int = 64 << 20):
        self._encode_new = encode_new
        self._max_bytes = max_bytes
        self._now, self._before = _Ids(), _Ids()

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each span, all ids) of the spans of one group of texts, in order."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        first, kind = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        kinds = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if self._now.held > self._max_bytes // 2:
            self._now, self._before = _Ids(), self._now
        known, older = self._now.index, self._before.index
        at = np.fromiter(map(known.get, kinds, repeat(-1)), np.int64, len(kinds))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [kinds[i] for i in missing.tolist()]
            before = np.fromiter(map(older.get, new, repeat(-1)), np.int64, len(new))
            for which, ids_of in ((before >= 0, lambda spans: self._before.of(before[before >= 0])), (before < 0, self._encode_new)):
                spans = list(compress(new, which.tolist()))
                if spans:
                    first = len(known)
                    self._now.add(spans, *ids_of(spans))
                    at[missing[which]] = np.arange(first, len(known))
        return self._now.of(at[kind])


def per_text(lengths: np.ndarray, starts: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Sums of the spans' lengths over each text; text i begins at text_starts[i], the last entry is the end."""
    before = np.concatenate([[0], np.cumsum(lengths)])
    return np.diff(before[np.searchsorted(starts, text_starts)])


# Bytes by their part in the cuts below.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,!?;:")] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: First bytes of white space beyond the above, and controls that some rules count as such.
_MAYBE_WHITE = np.zeros(256, bool)
_MAYBE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3, *range(0x1C, 0x20)]] = True


def joined_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, the place where each text begins and the end)."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(text) for text in texts])]).astype(np.int64)


def before_stops(data: np.ndarray, stops: np.ndarray = _STOP) -> np.ndarray:
    """Whether a stop at each place follows a letter or digit of ASCII or a letter of U+00C0 to U+00FF."""
    out = np.zeros(len(data), bool)
    at = np.flatnonzero(stops[data[1:]]) + 1
    last, lead = data[at - 1], data[np.maximum(at - 2, 0)]
    out[at] = _WORD[last] | (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    return out


def cut_at_spaces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches between places where a rule that ends every match before white space after other
    text, leaves one space to the text that follows, and parts letters and digits from stops, ends a match for sure.

    Beside white space beyond ASCII nothing is cut.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        white = _WHITE[data]
        after, before = data[1:], data[:-1]
        to_white = white[1:] & ~white[:-1]
        sure = (before < 0x80) & ~_MAYBE_WHITE[before]
        at = np.flatnonzero(to_white & (before >= 0x80))
        one, two, three = data[at], data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
        wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three >= 0xE1) & (three <= 0xE3) & (two >= 0x80) & (two <= 0x9A)
        sure[at] = ~wide
        cut[1:-1] = to_white & sure
        # White space before other text: its last character, and the text too unless that is a space.
        # At the end of a text no other text follows, whatever the next text begins with.
        ends_text = np.zeros(len(data) + 1, bool)
        ends_text[bounds] = True
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~_MAYBE_WHITE[after] & ~ends_text[1:-1])
        longer = last[white[np.maximum(last - 1, 0)] & (last > 0)]
        cut[longer] = True
        cut[last[data[last] != 0x20] + 1] = True
        cut[:-1] |= before_stops(data)
    cut[bounds] = True
    places = np.flatnonzero(cut)
    return places[:-1], places[1:]
