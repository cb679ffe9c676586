import math
import random
import zlib

import numpy as np
import pytest
from fixtures import awkward_texts, by_id, documents

from merchantry.llm import labelled, quality, toxicity
from merchantry.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def test_grams_stay_within_words():
    owner, gram = toxicity.grams(["ab cd", "", "AB"])
    wanted = {}
    for i, text in enumerate(["ab cd", "", "ab"]):
        own = set()
        for word in text.split():
            padded = f" {word} "
            own |= {padded[a:a + n] for n in (3, 4, 5, 6) for a in range(len(padded) - n + 1)}
        wanted[i] = len(own)
    assert [len(set(gram[owner == i].tolist())) for i in range(3)] == [wanted[0], 0, wanted[2]]
    assert set(gram[owner == 2].tolist()) <= set(gram[owner == 0].tolist())


def _plain_score(model, text):
    """A text's score in plain Python: the sigmoid of bias plus the weights of its distinct n-grams of characters."""
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    found = set()
    folded = "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in text.lower())
    for word in folded.split(" "):
        padded = f" {word} "
        for size in (3, 4, 5, 6):
            for a in range(len(padded) - size + 1) if word else ():
                h = 0
                for c in padded[a:a + size]:
                    h = (h * 0xD6E8FEB86659FD93 + ord(c)) % 2**64
                found.add(((h ^ size) * 0x9E3779B97F4A7C15 % 2**64) >> 44)
    return 1 / (1 + math.exp(-(model.bias + sum(weights.get(gram, 0.0) for gram in found))))


def test_scores_against_plain_python():
    rnd = random.Random(4)
    words = ["good", "bad", "été", "中文字", "naïve", "x", "don't", "😀😀😀"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(80)] + ["", "中文中文中文中文", "a  b\n\nbad."]
    model = toxicity.fit_rows(texts, [int("bad" in t or "中文字" in t) for t in texts], least_ratio=0.1)
    assert np.allclose(model.scores(texts), [_plain_score(model, text) for text in texts], atol=1e-5)


def test_scores_don_t_depend_on_the_group():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["good", "bad", "word", "other"]) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    model = toxicity.fit_rows(texts, [int("bad" in t) for t in texts], least_ratio=0.1)
    together = model.scores(texts)
    assert np.array_equal(together, np.concatenate([model.scores([t]) for t in texts]))
    assert all((s > 0.5) == ("bad" in t) for s, t in zip(together, texts))


def test_one_class_or_no_rows():
    assert toxicity.fit_rows(["a b", "c"], [0, 0]).scores(["a b", ""]).max() < 0.01
    assert toxicity.fit_rows([], []).scores(["x"]).max() < 0.01
    trees = quality.fit_trees(np.zeros((0, 3)), np.zeros(0))
    assert trees.scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.fit_trees(np.ones((4, 2)), np.ones(4)).scores(np.ones((1, 2)))[0] > 0.99


def test_flat_trees_against_walks():
    rnd = np.random.default_rng(2)
    rows = rnd.normal(size=(800, 5)).round(1)
    labels = ((rows[:, 0] > 0) ^ (rows[:, 3] > 0.5)).astype(int)
    trees = quality.fit_trees(rows, labels, trees=30, depth=3)
    assert ((trees.scores(rows) >= 0.5) == labels).mean() > 0.97

    def walk(row):
        total = trees.bias
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return total

    assert np.allclose(trees.margins(rows), [walk(row) for row in rows])


def test_statistics():
    names = quality.STATISTICS
    texts = ["The cat sat. The cat!! sat| 12\nThe cat sat. The cat!! sat| 12", "", "   ", "a a a a", "word"]
    rows = quality.statistics(texts)
    assert rows.shape == (5, len(names)) and np.isfinite(rows).all()
    assert not rows[1].any() and not rows[2].any()
    one = dict(zip(names, rows[0]))
    assert one["distinct_lines"] == 0.5 and one["pipes"] == 2 / len(texts[0]) and one["digits"] == 4 / len(texts[0])
    assert one["distinct_words"] == 6 / 14 and one["top_word"] == 4 / 14
    assert dict(zip(names, rows[3]))["repeats_last_word"] == 0.75
    assert np.array_equal(rows, np.concatenate([quality.statistics([t]) for t in texts]))


def test_training_rows_are_bounded_and_never_held_out(spark):
    docs = documents(spark, [f"text {i}" for i in range(60)] + [None]).union(documents(spark, ["text 0"]))
    rows = [(i, i % 2, None if i == 7 else 1) for i in range(61)] + [(3, 0, 0), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    texts, known = labelled.training_rows(docs, labels, "toxic", (4, 2))
    learnt = {int(t.split()[1]) for t in texts if t}
    assert learnt == {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2 and i != 7}
    assert len(texts) == len(learnt) + (zlib.crc32(b"60") % 4 != 2) and set(known) == {1}
    assert len(labelled.training_rows(docs, labels, "toxic", (4, 2), max_rows=5)[0]) == 5
    few = labelled.training_rows(docs, labels, "toxic", (4, 2), max_chars=20)[0]
    assert 1 <= len(few) <= 3
    assert labelled.training_rows(docs.limit(0), labels, "toxic", (4, 2)) == ([], [])


def test_one_long_text_changes_the_sample_by_itself(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    plain = [f"text {i}" for i in range(40)]
    usual = set(labelled.training_rows(documents(spark, plain), labels, "quality", (3, 1), max_text_chars=1000)[0])
    for i in range(0, 40, 13):
        texts = [*plain[:i], "long " * 300, *plain[i + 1:]]
        found = labelled.training_rows(documents(spark, texts), labels, "quality", (3, 1), max_chars=1000, max_text_chars=1000)[0]
        assert set(found) == usual - {plain[i]}


def test_awkward_tables(spark):
    texts = awkward_texts()
    docs = documents(spark, texts).selectExpr("*", "'old' AS score")
    model = toxicity.fit_rows(["bad word", "good word"] * 10, [1, 0] * 10, least_ratio=0.1)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted"]
    rows = by_id(out)
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert rows[0]["score"] == rows[1]["score"] and rows[6]["score"] == rows[7]["score"]
    trees = quality.fit_trees(quality.statistics(["a b c", "x x x x"] * 20), np.array([1, 0] * 20))
    assert quality.score(docs, trees).count() == len(texts)
    assert quality.score(documents(spark, []), trees).count() == 0


@pytest.mark.parametrize("name, label, divisor, least_accuracy, least_recall", [
    ("op6_toxicity", "toxic", (4, 2), 0.93, 0.6), ("op10_quality", "quality", (3, 1), 0.97, 0.9)])
def test_held_out_rows(spark, name, label, divisor, least_accuracy, least_recall):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = QUERIES[name](spark, FOLDER).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor[0] == divisor[1]) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r[label] for r in held]) >= least_accuracy
    rare = 1 if label == "toxic" else 0
    assert np.mean([r["predicted"] == rare for r in held if r[label] == rare]) >= least_recall
