import math

import numpy as np

from merchantry.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    good = {
        i: (np.array(v, np.float64), label) for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    links = {i: set() for i, *_ in rows}
    for i, (v, a) in good.items():
        for j, (w, b) in good.items():
            if i != j and a == b and len(v) == len(w):
                if float(v @ w) / (math.sqrt(v @ v) * math.sqrt(w @ w)) >= least:
                    links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


def found(df, **kwargs):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, **kwargs).collect()}


def planted(seed, n, dims, labels):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = rnd.random()
        if rows and kind < 0.5:
            base = np.array(rows[rnd.integers(max(0, len(rows) - 40), len(rows))][1])
            vector = base * rnd.choice([1, 1, 3]) + rnd.normal(size=dims) * rnd.choice([0, 0.1, 0.16, 0.3]) * np.linalg.norm(base) / math.sqrt(dims)
        else:
            vector = rnd.normal(size=dims)
        rows.append((i, [float(np.float32(x)) for x in vector], int(rnd.integers(labels))))
    return rows


def test_against_brute_force(spark):
    rows = planted(1, 700, 64, 3)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS root", "2 AS bucket").repartition(4)
    assert found(df) == brute(rows)


def test_hot_group_in_many_units(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=20)
    rows = [(i, [float(x) for x in base + rnd.normal(size=20) * 0.02 * (i % 3)], 1) for i in range(260)]
    rows += [(1000 + i, [1.0, 2.0, 3.0], 1) for i in range(5)] + [(2000 + i, [2.0, 4.0, 6.0], 2) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    truth = brute([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert found(df, unit_rows=20) == truth


def test_unfit_rows(spark):
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
        (7, [1.0, 1.0], None), (8, [1.0, 1.0], 1), (9, [2.0, 2.0], 1), (10, [1.0, 1.0, 0.0], 1), (11, [1.0, 1.0], 2),
    ]
    out = found(spark.createDataFrame(rows, SCHEMA))
    assert out == brute(rows)
    assert out[8] == (1, 8, True) and out[9] == (1, 8, False)


def test_empty_table_and_repeated_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out) == [(0, 0, False), (1, 1, True), (1, 1, True)]


def test_recall_at_the_threshold():
    """Random pairs at exactly 0.98 meet in a bucket."""
    rnd = np.random.default_rng(4)
    a = rnd.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rnd.normal(size=(4000, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98 ** 2) * b
    meet = embedding_dedup._first_meeting(embedding_dedup.codes(a, 6, 3), embedding_dedup.codes(b, 6, 3)) >= 0
    assert meet.mean() >= 0.99
    # Unrelated vectors seldom do.
    assert (embedding_dedup._first_meeting(embedding_dedup.codes(a, 6, 3), embedding_dedup.codes(b[::-1], 6, 3)) >= 0).mean() < 0.1


def test_hadamard_is_orthogonal():
    rows = np.eye(16)
    out = embedding_dedup._hadamard(rows)
    assert np.array_equal(out @ out.T, 16 * np.eye(16))
    assert np.array_equal(np.abs(out), np.ones((16, 16)))
