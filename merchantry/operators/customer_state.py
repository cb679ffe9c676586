"""The customer table kept up to date batch by batch, from state that merges."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantry.config import RULES, Rules
from merchantry.operators.customers import finished_customers, gaps_of_days, keyed_rows, preferences_of, with_ratios
from merchantry.session import store
from merchantry.sources.snapshots import UPLOAD, load_snapshot, of_exports, save_snapshot

KEYS = [*UPLOAD, "customer_key"]


def _parts(orders: DataFrame) -> dict[str, DataFrame]:
    """What a batch of orders adds to its customers: sums, the times of each day, rows and first date of each product."""
    rows = keyed_rows(orders)

    def money(column: str) -> Column:
        return F.coalesce(F.sum(column).cast("decimal(38,4)"), F.lit(0).cast("decimal(38,4)")).alias(column)

    return {
        "totals": rows.groupBy(*KEYS).agg(
            money("total"), F.countDistinct("order_id").alias("orders"), F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"), F.sum("quantity").cast("double").alias("quantity"), money("discount_amount"),
            F.count_if(F.col("discount_amount") > 0).alias("discounted"), money("refund_amount"),
        ),
        "days": rows.where(F.col("order_date").isNotNull()).groupBy(*KEYS, F.col("order_date").cast("date").alias("_day")).agg(
            F.collect_set("order_date").alias("times")),
        "products": rows.where(F.col("product_name").isNotNull()).groupBy(*KEYS, "product_name").agg(
            F.count("*").alias("_count"), F.min("order_date").alias("_first")),
    }


def _merged(totals: DataFrame, days: DataFrame, products: DataFrame) -> DataFrame:
    """The customers' base rows, as `customer_base` makes them of all their orders at once."""
    def money(column: str) -> Column:
        return F.sum(column).cast("double")

    base = totals.groupBy(*KEYS).agg(
        money("total").alias("total_revenue"), F.sum("orders").alias("order_count"), F.min("first_order_date").alias("first_order_date"),
        F.max("last_order_date").alias("last_order_date"), F.sum("quantity").alias("total_quantity_purchased"),
        money("discount_amount").alias("total_discount_amount"), F.sum("discounted").alias("_discounted_rows"), money("refund_amount").alias("refund_total"),
    )
    times = days.groupBy(*KEYS, "_day").agg(F.array_distinct(F.flatten(F.collect_list("times"))).alias("_all"))
    gaps = gaps_of_days(times.select(
        *KEYS, "_day", F.array_min("_all").alias("_open"), F.array_max("_all").alias("_close"), F.size("_all").cast("bigint").alias("_times")), KEYS)
    bought = preferences_of(products.groupBy(*KEYS, "product_name").agg(F.sum("_count").alias("_count"), F.min("_first").alias("_first")), KEYS)
    return with_ratios(base.join(gaps, KEYS, "left").join(bought, KEYS, "left"))


def update_customers(
    orders: DataFrame, path: str, part: str, as_of: Column | None = None, rules: Rules = RULES
) -> None:
    """Adds a batch of orders that are new to their exports to the customer table in `path`.

    `path`/totals, /days and /products hold what every batch added to its customers, /base a row for every customer and
    /customers the finished table. Only the batch's customers are merged again, from the state of their
    own exports; of these exports alone the base and the table are replaced. `part` names the batch: one that is run
    again replaces what it added before. Orders without a customer are left out.
    """
    spark = orders.sparkSession
    parts = {name: store(rows, f"customer-{name}") for name, rows in _parts(orders).items()}
    touched = parts["totals"].select(*KEYS)
    exports = store(touched.select(*UPLOAD).distinct(), "touched-exports")
    if exports.isEmpty():
        return
    held = {}
    for name, rows in parts.items():
        # Gathered by export, so that files are as many as their rows need, however many tasks there are.
        rows.hint("rebalance", *UPLOAD).withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *UPLOAD, "part").parquet(f"{path}/{name}")
        schema = T.StructType([*rows.schema.fields, T.StructField("part", T.StringType())])
        held[name] = of_exports(spark.read.schema(schema).parquet(f"{path}/{name}"), exports).join(touched, KEYS, "left_semi")
    base = _merged(**held)
    try:
        others = of_exports(load_snapshot(spark, f"{path}/base"), exports).join(touched, KEYS, "left_anti")
        base = base.unionByName(others)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    base = store(base, "customer-base")
    save_snapshot(base, f"{path}/base")
    save_snapshot(finished_customers(base, UPLOAD, as_of, rules), f"{path}/customers")
