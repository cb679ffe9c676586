"""Histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from merchantry.llm.byte_words import DARK, find_words, window_hashes
from merchantry.llm.labelled import training_rows, with_scores
from merchantry.llm.piece_table import small_groups

#: Rows whose crc32(doc_id) has this remainder are never learnt from.
HELD_OUT = (3, 1)
THRESHOLD = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!#$%&*+<=>@^_{|}~\\/\"'()[]`-"]] = True
_PIPE = np.zeros(256, bool)
_PIPE[ord("|")] = True
_BEYOND = np.arange(256) >= 0x80

STATISTICS = [
    "log_bytes", "log_words", "mean_word", "word_spread", "longest_word", "short_words", "long_words", "distinct_words",
    "top_word", "repeats_last_word", "distinct_runs", "upper", "digits", "stops", "marks", "pipes", "beyond_ascii", "lines",
    "distinct_lines", "mean_line", "words_end_in_mark", "words_end_in_stop", "words_all_upper", "lone_marks",
]


def statistics(texts: list[str]) -> np.ndarray:
    """One row of numbers per whole text, none of them null; an empty text has zeros."""
    parts = [text.encode() for text in texts]
    n = len(parts)
    words = find_words(parts, DARK, lower=False)
    sizes = np.array([len(part) for part in parts], np.float64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    counts = np.diff(words.first).astype(np.float64)
    per_byte, per_word = np.maximum(sizes, 1), np.maximum(counts, 1)
    owner, lengths, hashes = words.owner, words.ends - words.starts, words.hashes()

    def byte_share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[words.data])])
        return (total[bounds[1:] - 1] - total[bounds[:-1]]) / per_byte

    def word_share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n) / per_word

    def shares(keys: np.ndarray, of: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and the commonest key, as shares of each text's keys."""
        order = np.lexsort((keys, of))
        keys, of = keys[order], of[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])] if len(keys) else np.zeros(0, bool)
        runs = np.diff(np.r_[np.flatnonzero(new), len(keys)])
        most = np.zeros(n)
        np.maximum.at(most, of[new], runs)
        return np.bincount(of[new], minlength=n) / np.maximum(totals, 1), most / np.maximum(totals, 1)

    distinct, top = shares(hashes, owner, counts)
    places, runs = window_hashes(hashes, words.first, 3)
    run_owner = owner[places]
    distinct_runs, _ = shares(runs, run_owner, np.bincount(run_owner, minlength=n))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    lines = [part.split(b"\n") for part in parts]
    n_lines = np.array([len(line) for line in lines], np.float64)
    distinct_lines = np.array([len(set(line)) for line in lines]) / n_lines
    sums = np.bincount(owner, lengths, minlength=n)
    mean = sums / per_word
    spread = np.sqrt(np.maximum(np.bincount(owner, lengths ** 2.0, minlength=n) / per_word - mean ** 2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, lengths)
    last = words.data[words.ends - 1] if len(owner) else np.zeros(0, np.uint8)
    uppers = np.concatenate([[0], np.cumsum(_UPPER[words.data])])
    columns = [
        np.log1p(sizes), np.log1p(counts), mean, spread, longest, word_share(lengths <= 3), word_share(lengths >= 14),
        distinct, top, word_share(same), distinct_runs, byte_share(_UPPER), byte_share(_DIGIT), byte_share(_STOP),
        byte_share(_MARK), byte_share(_PIPE), byte_share(_BEYOND), n_lines / per_word, distinct_lines, counts / n_lines,
        word_share(_MARK[last]), word_share(_STOP[last]), word_share((uppers[words.ends] - uppers[words.starts] >= 2)),
        word_share((lengths == 1) & _MARK[last]),
    ]
    return np.where(counts[:, None] > 0, np.column_stack(columns), 0.0)


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth as arrays: node k of a tree goes on to 2k + 1, or 2k + 2 where its value is above
    the threshold; nodes that don't split have an infinite threshold."""

    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    bias: float

    def margins(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        place = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[place, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def fit_trees(
    rows: np.ndarray, labels: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1,
    least_weight: float = 5.0, penalty: float = 1.0,
) -> Trees:
    """Newton boosting of the logistic loss on histograms of at most `bins` quantile bins.

    Rows of one class only, or none, give no trees and that class's share as the score.
    """
    y = np.asarray(labels, np.float64)
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = float(y.mean()) if len(y) else 0.5
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if share in (0.0, 1.0) or not len(y):
        return Trees(depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), bias)
    n_features = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.column_stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(n_features)])
    margin = np.full(len(y), bias)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.zeros(width)
            cut = np.full(width, -1)
            for f in range(n_features):
                key = local * bins + binned[:, f]
                g = np.cumsum(np.bincount(key, gradient, minlength=width * bins).reshape(width, bins), axis=1)
                h = np.cumsum(np.bincount(key, weight, minlength=width * bins).reshape(width, bins), axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g ** 2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g ** 2 / (all_h + penalty)
                gain[(h < least_weight) | (all_h - h < least_weight)] = 0
                at = gain.argmax(axis=1)
                most = gain[np.arange(width), at]
                better = (most > best + 1e-9) & (at < len(edges[f]))
                best[better], cut[better], feature[first:first + width][better] = most[better], at[better], f
            for k in np.flatnonzero(cut >= 0):
                threshold[first + k] = edges[feature[first + k]][cut[k]]
            node = 2 * node + 1 + (rows[np.arange(len(y)), feature[node]] > threshold[node])
        place = node - inner
        g, h = np.bincount(place, gradient, minlength=leaves), np.bincount(place, weight, minlength=leaves)
        leaf = -rate * g / (h + penalty)
        margin += leaf[place]
        kept.append((feature, threshold, leaf))
    return Trees(depth, *(np.array(part) for part in zip(*kept)), bias)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, max_chars: int = 20_000_000) -> Trees:
    """The trees of a bounded sample of labelled documents, see `training_rows`."""
    texts, known = training_rows(docs, labels, "quality", HELD_OUT, max_rows, max_chars)
    rows = [statistics(group) for group in small_groups(texts)]
    return fit_trees(np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS))), np.array(known))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """`docs` with score and predicted from statistics of their whole texts."""
    return with_scores(docs, lambda texts: model.scores(statistics(texts)), THRESHOLD)
