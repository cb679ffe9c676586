import re
from collections import Counter

import pytest
from fixtures import awkward_texts, by_id, documents

from merchantry.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, length):
    seen = Counter()
    for text in texts:
        own = WORD.findall(text or "")
        seen.update(tuple(own[i:i + length]) for i in range(len(own) - length + 1))
    out = []
    for text in texts:
        own = WORD.findall(text or "")
        gone = set()
        for i in range(len(own) - length + 1):
            if seen[tuple(own[i:i + length])] > 1:
                gone |= set(range(i, i + length))
        out.append((len(own), sorted(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return out


def check(spark, texts, **kwargs):
    found = by_id(substring_dedup.without_repeats(documents(spark, texts).selectExpr("*", "1 AS block", "2 AS payload").repartition(4), **kwargs))
    for i, (n, gone, kept) in enumerate(brute(texts, kwargs.get("length", 35))):
        row = found[i]
        assert (row["n_words"], row["n_removed"], row["kept_text"]) == (n, len(gone), kept), i
        assert [at for s in row["removed"] for at in range(s["start"], s["end"])] == gone


@pytest.mark.parametrize("kwargs", [{}, {"length": 12, "first": 2}, {"length": 7, "first": 7}])
def test_against_brute_force(spark, kwargs):
    texts = awkward_texts()
    shared = " ".join(f"p{i}" for i in range(34))
    # 34 shared words are too few, 35 are enough; copies of a copy end at the text's ends.
    texts += ["left " + shared + " right", shared + " other", "q " + shared + " r q", " ".join(f"t{i}" for i in range(35)), " ".join(
        f"t{i}" for i in range(35))]
    check(spark, texts, **kwargs)


def test_empty_table(spark):
    assert substring_dedup.without_repeats(documents(spark, [])).count() == 0


def test_repeated_rows_repeat_each_other(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(1, text), (1, text), (None, "only this")], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.without_repeats(rows).collect())
    assert found == [(0, 0), (1, 50), (1, 50)]


def test_levels():
    assert substring_dedup.levels(35, 16) == [18, 35]
    assert substring_dedup.levels(35, 4) == [5, 9, 18, 35]
    assert substring_dedup.levels(7, 7) == [7]
    assert substring_dedup.levels(1, 1) == [1]
