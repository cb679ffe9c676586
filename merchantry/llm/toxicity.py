"""A linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from merchantry.llm.labelled import training_rows, with_scores
from merchantry.llm.piece_table import small_groups

#: Rows whose crc32(doc_id) has this remainder are never learnt from.
HELD_OUT = (4, 2)
THRESHOLD = 0.3

_ORDERS = (3, 4, 5, 6)  # n-gram sizes in characters
_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = 32

# ASCII letters and digits and all characters beyond ASCII stand for themselves, all else for one space.
_FOLD = np.full(128, _SPACE, np.uint32)
for _code in [*range(48, 58), *range(97, 123)]:
    _FOLD[_code] = _code


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed n-gram) of every n-gram of characters within a word, word ends included, of lower-cased texts."""
    parts = [text.lower() for text in texts]
    codes = np.frombuffer(f" {' '.join(parts)}{' ' * max(_ORDERS)}".encode("utf-32-le", "surrogatepass"), "<u4")
    data = np.where(codes < 128, _FOLD[np.minimum(codes, 127)], codes).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(part) + 1 for part in parts])])
    n = int(starts[-1])
    spaces = np.concatenate([[0], np.cumsum(data == _SPACE)])
    places, hashes = [], []
    rolled = np.zeros(n, np.uint64)
    for size in range(1, max(_ORDERS) + 1):
        rolled = rolled * _STEP + data[size - 1:size - 1 + n]
        if size in _ORDERS:
            at = np.flatnonzero(spaces[size - 1:size - 1 + n] == spaces[1:n + 1])
            places.append(at)
            hashes.append(((rolled[at] ^ np.uint64(size)) * _MIX >> np.uint64(64 - _BITS)).astype(np.int64))
    owner = np.searchsorted(starts, np.concatenate(places), side="right") - 1
    return owner, np.concatenate(hashes)


def _distinct(owner: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(owner << _BITS | gram)
    return keys >> _BITS, keys & ((1 << _BITS) - 1)


@dataclass(frozen=True)
class NgramModel:
    """Weights of the n-gram hashes in `features` (all others weigh 0) and `bias`; texts are scored by the sigmoid
    of bias plus the sum over their distinct n-grams."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """One score for each whole text; an empty text has that of the bias."""
        table = np.zeros(1 << _BITS, np.float32)
        table[self.features] = self.weights
        owner, gram = grams(texts)
        kept = table[gram] != 0
        owner, gram = _distinct(owner[kept], gram[kept])
        sums = np.bincount(owner, table[gram], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -30, 30)))


def fit_rows(
    texts: list[str], labels: list[int], alpha: float = 1.0, least_texts: int = 4, least_ratio: float = 1.5,
    penalty: float = 1e-2, steps: int = 300,
) -> NgramModel:
    """Fits the model; n-grams of fewer texts, or with a smaller log-count ratio, get weight 0.

    Rows of one class only, or none, give a model without weights whose bias is that class's.
    """
    y = np.array(labels, np.float64)
    size = 1 << _BITS
    share = float(y.mean()) if len(y) else 0.0
    base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if share in (0.0, 1.0):
        return NgramModel(np.zeros(0, np.int64), np.zeros(0), base)
    # Two passes over the texts: the counts first, then only the n-grams that are kept.
    inside, outside, at = np.zeros(size), np.zeros(size), 0
    for group in small_groups(texts):
        owner, gram = _distinct(*grams(group))
        inside += np.bincount(gram, y[at + owner], minlength=size)
        outside += np.bincount(gram, 1 - y[at + owner], minlength=size)
        at += len(group)
    ratio = np.log((inside + alpha) / (y.sum() + alpha)) - np.log((outside + alpha) / ((1 - y).sum() + alpha))
    ratio[(inside + outside < least_texts) | (np.abs(ratio) < least_ratio)] = 0
    feature = np.flatnonzero(ratio)
    number = np.zeros(size, np.int32)
    number[feature] = np.arange(len(feature))
    rows, cols, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    for group in small_groups(texts):
        owner, gram = grams(group)
        kept = ratio[gram] != 0
        owner, gram = _distinct(owner[kept], gram[kept])
        rows.append((owner + at).astype(np.int32))
        cols.append(number[gram])
        at += len(group)
    row, column = np.concatenate(rows), np.concatenate(cols)
    value = ratio[feature][column]
    # Logistic regression on the scaled features by Nesterov's gradient steps.
    weight, bias = np.zeros(len(feature)), base
    look, look_bias, momentum = weight, bias, 1.0
    norms = np.bincount(row, value ** 2, minlength=len(y))
    rate = 4.0 / (norms.mean() * 4 + 1)
    for _ in range(steps):
        margin = np.bincount(row, value * look[column], minlength=len(y)) + look_bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        gradient = np.bincount(column, value * error[row], minlength=len(feature)) + penalty * look
        following, following_bias = look - rate * gradient, look_bias - rate * error.sum()
        momentum, last = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2, momentum
        look = following + (last - 1) / momentum * (following - weight)
        look_bias = following_bias + (last - 1) / momentum * (following_bias - bias)
        weight, bias = following, following_bias
    return NgramModel(feature, weight * ratio[feature], float(bias))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, max_chars: int = 20_000_000) -> NgramModel:
    """The model of a bounded sample of labelled documents, see `training_rows`."""
    return fit_rows(*training_rows(docs, labels, "toxic", HELD_OUT, max_rows, max_chars))


def score(docs: DataFrame, model: NgramModel, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """`docs` with score and predicted from their whole texts alone."""
    return with_scores(docs, model.scores, THRESHOLD, names=names)
