"""Frequent product pairs against counting all pairs."""

import random
from collections import Counter
from itertools import combinations

import pytest

from merchantry.operators.baskets import basket_pairs


def brute(rows, min_orders, min_support):
    baskets = {}
    for tenant, order, item in rows:
        if order is not None and item is not None:
            baskets.setdefault((tenant, order), set()).add(item)
    n, single, pairs = Counter(), Counter(), Counter()
    for (tenant, _), items in baskets.items():
        n[tenant] += 1
        single.update((tenant, item) for item in items)
        pairs.update((tenant, *pair) for pair in combinations(sorted(items), 2))
    return {
        key: (count, count / n[key[0]], count / single[key[:2]], count / single[key[0], key[2]],
              count * n[key[0]] / (single[key[:2]] * single[key[0], key[2]]))
        for key, count in pairs.items() if count >= min_orders and count >= min_support * n[key[0]]
    }


def found(df):
    return {(r.tenant_id, r.item_a, r.item_b): (r.orders, r.support, r.confidence, r.confidence_back, r.lift) for r in df.collect()}


@pytest.mark.parametrize(("min_orders", "min_support", "block"), [(2, 0.0, 500), (3, 0.05, 3), (1, 0.0, 2)])
def test_all_pairs(spark, min_orders, min_support, block):
    rnd = random.Random(block)
    rows = [(rnd.choice("tu"), str(rnd.randrange(60)), f"p{int(rnd.paretovariate(0.8))}") for _ in range(700)]
    rows += [("t", None, "p1"), ("t", "1", None), ("v", "1", "alone"), ("w", "1", "é"), ("w", "1", "z"), ("w", "2", "z"), ("w", "2", "é")]
    df = spark.createDataFrame(rows, "tenant_id string, order_id string, product_name string").repartition(4)
    assert found(basket_pairs(df, min_orders, min_support, block_items=block)) == brute(rows, min_orders, min_support)


def test_order_of_5000_products(spark):
    """A wide order is spread over tiles; with a support of two its pairs with a second order alone are returned."""
    rows = [("t", "wide", f"p{i}") for i in range(5000)] + [("t", str(o), f"p{i}") for o in range(3) for i in range(o, o + 40)]
    df = spark.createDataFrame(rows, "tenant_id string, order_id string, product_name string")
    assert found(basket_pairs(df)) == brute(rows, 2, 0)
    whole = basket_pairs(df.where("order_id = 'wide'"), min_orders=1)
    assert whole.count() == 5000 * 4999 // 2


def test_no_rows(spark):
    df = spark.createDataFrame([], "tenant_id string, order_id string, product_name string")
    assert basket_pairs(df).count() == 0
