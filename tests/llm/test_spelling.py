"""Spelling variants against plain Python over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from fixtures import awkward_texts, documents

from merchantry.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 7 and n >= 2}


def brute(words):
    by_length = {}
    for word in words:
        by_length.setdefault(len(word), []).append(word)
    form, out = {}, {}
    for word, n in words.items():
        found = [other for d in (-1, 0, 1) for other in by_length.get(len(word) + d, []) if near(word, other)]
        best = min(found, key=lambda w: (-words[w], w), default=None)
        form[word] = best if best and words[best] >= 10 * n else None
        out[word] = len(found)
    rows = []
    for word, n in words.items():
        root = word
        while form[root]:
            root = form[root]
        rows.append((word, form[word], root, n, out[word], words[form[word]] if form[word] else None))
    return sorted(rows)


def _rows(df):
    return sorted(tuple(row[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for row in df.collect())


def test_documents(spark):
    rnd = random.Random(3)
    stems = ["nationalité", "thinking", "handels", "überall", "rethinking", "tionation", "ÀÉÎÿ×÷Ø", "aaaaaaa", "abababab"]
    texts = awkward_texts() + [" ".join(rnd.choice(stems) + rnd.choice(["", "s", "en", "X"]) for _ in range(300)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, "Thinking thinking"), (None, "rethinking RETHINKING")]
    df = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, word string").repartition(3)
    assert _rows(spelling.spelling_variants(df, min_words=2)) == brute(brute_words(rows))


@pytest.mark.parametrize(("alphabet", "least"), [("ab", 1), ("abcd", 3), ("abcdeé", 40)])
def test_words_with_hot_grams(spark, alphabet, least, monkeypatch):
    """Few letters: most grams are frequent, short first grams are cut, lists are salted; also one very long word."""
    rnd = random.Random(least)
    words = {"".join(rnd.choices(alphabet, k=rnd.choice([7, 7, 8, 8, 9, 10, 12, 16]))): int(rnd.paretovariate(0.3)) + 1 for _ in range(1500)}
    long = "".join(rnd.choices(alphabet, k=3000))
    words |= {long: 50, long[:1500] + long[1501:]: 2, long[1:]: 3, long + "a": 500}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling, "_SALTED_FROM", 100)
    assert _rows(spelling.variants(df, min_words=least)) == brute(words)


def test_dictionary_is_bounded(spark):
    rnd = random.Random(1)
    words = spark.createDataFrame([("".join(rnd.choices("abc", k=9)), 2) for _ in range(4000)], "word string, n long")
    grams, counts = spelling.frequent_grams(words, 500, 1)
    assert 0 < len(grams) <= 500 and (counts > 200).all()


def test_no_words(spark):
    assert spelling.spelling_variants(documents(spark, [])).count() == 0
    assert spelling.spelling_variants(documents(spark, [None, "", "short words"])).count() == 0
