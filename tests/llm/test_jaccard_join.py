import random
import re

import pytest
from fixtures import awkward_texts, documents

from merchantry.llm import components, jaccard_join
from merchantry.session import store

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i:i + 5]) for i in range(max(len(own) - 4, 1))} if own else set()


def brute(rows, percent=80):
    sets = [shingles(text) for _, text in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[top(i)]) for i, (doc_id, _) in enumerate(rows)}


def found(docs, **kwargs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_groups(docs, **kwargs).collect()}


def tiles_of(spark, texts):
    """The tiles of unlike texts, as the join makes them."""
    kept = []
    with pytest.MonkeyPatch.context() as patch:
        real = jaccard_join._tiles_and_sets
        patch.setattr(jaccard_join, "_tiles_and_sets", lambda *args: kept.append(real(*args)) or kept[-1])
        jaccard_join.similar_classes(documents(spark, texts))
    return kept[0]


def test_awkward_texts(spark):
    texts = awkward_texts()
    docs = documents(spark, texts).selectExpr("*", "1 AS block", "'x' AS root").repartition(3)
    assert found(docs) == brute(list(enumerate(texts)))


@pytest.mark.parametrize("percent", [80, 60])
def test_groups_of_near_copies(spark, percent):
    """Chains of edits, a large group of copies of copies, and texts around the threshold."""
    rnd = random.Random(percent)
    texts = []
    for group in range(25):
        own = [f"g{group}w{i}" if rnd.random() < 0.9 else "common" for i in range(rnd.choice([3, 5, 9, 30, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 8])):
            texts.append(" ".join(own))
            for _ in range(rnd.randint(0, 1 + len(own) // 40)):
                own[rnd.randrange(len(own))] = f"e{rnd.randrange(10**6)}"
            if rnd.random() < 0.5:
                own = own + [f"tail{rnd.randrange(9)}"]
    base = [f"hot{i}" for i in range(80)]
    for _ in range(150):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(80)] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    rnd.shuffle(texts)
    rows = [(1000 - i, text) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs, percent=percent) == brute(rows, percent)


def test_exact_threshold(spark):
    # 8 of 10 shingles shared is a link, 7 of 9 isn't.
    one = [f"a{i}" for i in range(13)]
    rows = [(1, " ".join(one)), (2, " ".join(one[:12] + ["x"])), (3, " ".join(["y", "z"] + one[:11]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "A b c")], "doc_id long, text string")
    out = sorted(((r["doc_id"] or 0, r["component_id"]) for r in jaccard_join.similarity_groups(rows).collect()), key=str)
    assert out == [(0, None), (4, 4), (4, 4), (9, 4)]
    assert jaccard_join.similarity_groups(rows.limit(0)).count() == 0


def test_signatures_bound_differences():
    rnd = random.Random(1)
    np = jaccard_join.np
    for _ in range(200):
        a = {rnd.randrange(2**63) for _ in range(rnd.randint(1, 300))}
        b = set(rnd.sample(sorted(a), rnd.randint(0, len(a)))) | {rnd.randrange(2**63) for _ in range(rnd.randint(1, 60))}
        owner = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
        marks = jaccard_join.signatures(owner, np.array([*a, *b], np.uint64), 2)
        assert int(np.bitwise_count((marks[0] ^ marks[1]).view("<u8")).sum()) <= len(a ^ b)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 400), (500, 600), (7, None)]
    out = {r["id"]: r["component_id"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(201)}, 400: 400, 500: 400, 600: 400}


def test_tables_of_a_small_graph_are_few_files_however_many_partitions_shuffles_have(spark):
    """Each round of labels writes its tables again, a task a partition."""
    few = spark.sparkContext.defaultParallelism
    held = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 4 * few)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = store(spark.range(1_000).selectExpr("id as a", "id - id % 10 as b"), "few-links")
        out = components.components(links)
        assert len(out.inputFiles()) <= few
        assert out.where("component_id <> id - id % 10").count() == 0 and out.count() == 1_000
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


def test_near_copies_meet_once_not_by_every_shared_key(spark, monkeypatch):
    """Two sets that share most keys make a row or two, whichever keys one of them lacks, and never none."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for i in range(40):
        own = list(base)
        own[rnd.randrange(len(own))] = f"e{i}"
        texts.append(" ".join(own))
    tiles, sets = tiles_of(spark, texts)
    keys = tiles.groupBy("root").count().agg({"count": "avg"}).first()[0]
    labels = spark.createDataFrame([(i, i) for i in range(40)], "id long, component_id long")
    monkeypatch.setattr(type(tiles), "distinct", lambda self: self)  # the rows that the join makes
    rows = [tuple(row) for row in jaccard_join._crossing_pairs(tiles, labels, 80).collect()]
    wanted = {(a, b) for a in range(40) for b in range(a)}
    assert {(max(pair), min(pair)) for pair in rows} == wanted
    assert keys > 20 and len(rows) < 2 * len(wanted)


def test_few_members_of_a_large_component_are_met(spark):
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join([*base, f"tail{i}"]) for i in range(400)]
    tiles, _ = tiles_of(spark, texts)
    labels = spark.createDataFrame([(i, 0) for i in range(399)], "id long, component_id long")
    met = {min(pair) for pair in map(tuple, jaccard_join._crossing_pairs(tiles, labels, 80, 8).collect())}
    assert 1 <= len(met) <= 30
    assert len({min(pair) for pair in map(tuple, jaccard_join._crossing_pairs(tiles, labels, 80).collect())}) == 399
