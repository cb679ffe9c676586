"""Words of many texts at once, as spans and 64-bit hashes over their joined UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from merchantry.llm.spans import mixed, span_hashes

# Fixed values of the two word rules: bytes of words.
#: `[^\x20\x09-\x0D]+`: everything but blank ASCII characters.
DARK = np.ones(256, bool)
DARK[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: ASCII digits, lower-case letters and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    bits = max(16, int(n).bit_length())
    table = _powers(base, bits) if bits <= 22 else np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
    return table[:n]


@dataclass(frozen=True)
class Words:
    """Words of texts: `data` joined bytes, `starts` and `ends` in it, `first` the number of words before each text
    (with the total at the end), so that text i has words first[i]:first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes and length; another seed gives an independent one."""
        return span_hashes(self.data, self.starts, self.ends, seed)

    def texts(self) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def find_words(texts: list[bytes], is_word: np.ndarray, lower: bool) -> Words:
    """All words of whole texts; `lower` puts A-Z into lower case first."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = _LOWER[data] if lower else data
    inside = is_word[data]
    change = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    bounds = np.concatenate([[0], np.cumsum([len(text) + 1 for text in texts])])
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every run of `size` consecutive words within one text; place counts words of all texts."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_BASE, n), out=sums[1:])
    counts = np.maximum(np.diff(first) - size + 1, 0)
    ends = np.cumsum(counts)
    at = np.repeat(first[:-1] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
    inverse = powers(pow(_BASE, -1, 1 << 64), n + 1)
    return at, mixed((sums[at + size] - sums[at]) * inverse[at])
