"""Ranked search against plain Python over all documents."""

import math
import random
import re
from collections import Counter

import pytest
from fixtures import awkward_texts, documents

from merchantry.llm import ranked_search


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, top):
    docs = [(key, Counter(_terms(text))) for key, text in rows]
    docs = [(key, terms) for key, terms in docs if terms]
    n, length = len(docs), sum(terms.total() for _, terms in docs)
    df = Counter(term for _, terms in docs for term in terms)
    out = []
    for item, text in items:
        scored = []
        for key, terms in docs:
            m = 75 + 25 * terms.total() * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * (10**9 * terms[term] // (1000 * terms[term] + 12 * m)) * times
                for term, times in Counter(_terms(text)).items() if term in terms
            )
            if score > 0:
                scored.append((-score, key is not None, key or 0))
        out += [(item, rank + 1, key if known else None, -score) for rank, (score, known, key) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def _found(spark, rows, items, tmp_path, top=20, **limits):
    folder = f"{tmp_path}/index"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ranked_search.write_index(df, folder, limits.pop("shard_chars", 4_000_000))
    index = ranked_search.read_index(spark, folder)
    queries = spark.createDataFrame(items, "item_id string, text string")
    return sorted((tuple(row) for row in ranked_search.search(index, queries, top, **limits).collect()), key=repr)


def test_awkward_texts(spark, tmp_path):
    rows = list(enumerate(awkward_texts()))
    rows += [(3, "one ONE two"), (None, "one two"), (None, "shared1 alpha")]
    items = [("a", "one two three"), ("a", "Alpha beta, gamma shared3 shared4"), (None, "été 中文 naïve same same"), ("n", None), ("e", ""), ("x", "nowhere")]
    assert _found(spark, rows, items, tmp_path, shard_chars=20_000, block_chars=30) == brute(rows, items, 20)


@pytest.mark.parametrize("top", [1, 5])
def test_many_documents_and_copies(spark, tmp_path, top, monkeypatch):
    """Long lists, equal scores, intervals that are split many times, few postings at a time."""
    rnd = random.Random(top)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 40)))) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(500)]
    rnd.shuffle(rows)
    items = [(str(i), " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 12)))) for i in range(30)] + [("copy", rows[7][1])]
    monkeypatch.setattr(ranked_search, "_MAX_POSTINGS", 5000)
    assert _found(spark, rows, items, tmp_path, top, shard_chars=100_000) == brute(rows, items, top)


def test_splits_reach_the_best_without_scoring_all(monkeypatch):
    """With one clear best document the search opens few of the intervals."""
    import numpy as np

    texts = ["common word"] * 5000
    texts[3217] = "rare common"
    row = ranked_search._shard(list(range(5000)), texts)
    queries = ranked_search.Queries.of(["rare common"])
    best = ranked_search._Best(1, 1)
    opened = []
    largest = ranked_search._Lists.largest
    monkeypatch.setattr(ranked_search._Lists, "largest", lambda self, a, b: opened.append(len(a)) or largest(self, a, b))
    weights = np.array([7000 if queries.terms.term(t) == b"rare" else 1 for t in range(2)])
    ranked_search._search_shard(row, queries, weights, 5000, 10000, best)
    assert best.doc.tolist() == [3217] and sum(opened) < 100


def test_empty_tables(spark, tmp_path):
    assert _found(spark, [], [("a", "one")], tmp_path) == []
    ranked_search.write_index(documents(spark), f"{tmp_path}/some")
    assert ranked_search.search(ranked_search.read_index(spark, f"{tmp_path}/some"), spark.createDataFrame([], "item_id long, text string")).count() == 0
