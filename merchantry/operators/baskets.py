"""Products that are bought together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.session import store

TENANT = ["tenant_id"]


def _tiled(baskets: DataFrame, order: Sequence[str], block_items: int) -> DataFrame:
    """Basket rows with the tiles they take part in: `low` and `high` number two blocks of their order's items, `own` the row's.

    An order of w items has w / block_items blocks; an item goes to one tile for each of them, so that
    no tile holds more than two blocks, however wide the order is.
    """
    width = baskets.groupBy(*order).agg(F.ceil(F.count("*") / block_items).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = baskets.join(width, list(order)).select(*order, "item", own.alias("own"), other.alias("other"))
    return placed.select(*order, "item", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def basket_pairs(
    lines: DataFrame, min_orders: int = 2, min_support: float = 0.0, item: str = "product_name", by: Sequence[str] = TENANT,
    block_items: int = 500,
) -> DataFrame:
    """item_a, item_b (item_a < item_b), orders, support, confidence, confidence_back, lift of frequent pairs.

    `lines` are order lines; a row without order or item counts nowhere, an item twice in an order counts
    once. Of a group's N orders, a pair is frequent when it is in at least `min_orders` of them and in a
    share of at least `min_support`. support = orders / N, confidence = orders / orders with
    item_a, confidence_back the same for item_b, lift = confidence / share of orders with item_b.

    Items that aren't frequent themselves can be in no frequent pair and go first, so the candidates are
    bounded by the support. Wide orders are cut into tiles of two blocks of items, which
    spread over tasks; pairs are counted on each task before they are shuffled. No order is capped.
    """
    by = list(by)
    order = [*by, "order_id"]
    baskets = store(
        lines.where(F.col("order_id").isNotNull() & F.col(item).isNotNull()).select(*order, F.col(item).alias("item")).distinct(), "baskets"
    )
    totals = baskets.groupBy(*order).agg(F.lit(1).alias("_one")).groupBy(*by).agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(min_orders).cast("bigint"), F.ceil(F.col("n") * F.lit(min_support) - 1e-9))
    items = store(
        baskets.groupBy(*by, "item").agg(F.count("*").alias("item_orders")).join(totals, by)
        .withColumn("least", least).where(F.col("item_orders") >= F.col("least")), "frequent-items",
    )
    frequent = store(baskets.join(items.select(*by, "item"), [*by, "item"], "left_semi"), "frequent-baskets")
    tiles = _tiled(frequent, order, block_items)
    tile = [*order, "low", "high"]
    left = tiles.where("own = low").select(*tile, F.col("item").alias("one"))
    right = tiles.where("own = high").select(*tile, F.col("item").alias("other"))
    # Within one block each pair would come twice; between two blocks it comes once, in either order.
    pairs = left.join(right, tile).where((F.col("low") < F.col("high")) & (F.col("one") != F.col("other")) | (F.col("one") < F.col("other")))
    counted = pairs.groupBy(*by, F.least("one", "other").alias("item_a"), F.greatest("one", "other").alias("item_b")).agg(
        F.count("*").alias("orders"))
    a = items.select(*by, F.col("item").alias("item_a"), F.col("item_orders").alias("a_orders"), "n", "least")
    b = items.select(*by, F.col("item").alias("item_b"), F.col("item_orders").alias("b_orders"))
    # Stored: only frequent pairs are left to be joined with their items.
    kept = store(counted.join(items.groupBy(*by).agg(F.first("least").alias("_least")), by).where("orders >= _least").drop("_least"), "frequent-pairs")
    return kept.join(a, [*by, "item_a"]).join(b, [*by, "item_b"]).select(
        *by, "item_a", "item_b", "orders", (F.col("orders") / F.col("n")).alias("support"),
        (F.col("orders") / F.col("a_orders")).alias("confidence"), (F.col("orders") / F.col("b_orders")).alias("confidence_back"),
        (F.col("orders") * F.col("n") / (F.col("a_orders") * F.col("b_orders"))).alias("lift"),
    )
