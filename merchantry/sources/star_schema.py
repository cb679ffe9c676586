"""Order lines read from the star-schema tables.

A customer's market segment is its merchant (`tenant_id`); every calendar year of
a merchant's orders is one export (`upload_id`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.operators.cleaning import first_row_per_order
from merchantry.session import fit_partitions

TENANT = ["tenant_id"]
UPLOAD = ["tenant_id", "upload_id"]

# Total order of the lines of one order: line numbers are not unique.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    return fit_partitions(table(spark, folder, "lineitem"))


def order_heads(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order, with its customer."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.col("c_mktsegment").alias("tenant_id"),
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy").alias("upload_id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("n_name").alias("customer_location"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("order_date"),
        F.col("o_orderstatus").alias("financial_status"),
    )


def join_heads(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines with their order: two large tables, merged on the order key.

    A compressed line table can look small enough to broadcast when it is not.
    """
    return lines.join(heads.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))


def _promoted() -> Column:
    lane = F.col("customer_id").cast("bigint") % 4
    floor = F.when(lane == 0, 0.02).when(lane == 1, 9.0).otherwise(0.05)
    return F.col("l_discount") >= floor


def _line_columns(lines: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    total = (price * (F.lit(1).cast("decimal(1,0)") - discount)).cast("decimal(18,4)")
    nothing = F.lit(0).cast("decimal(18,4)")
    return lines.select(
        "tenant_id", "upload_id", "order_id", "customer_id", "customer_name", "customer_location", "order_date",
        "financial_status",
        F.col("l_partkey").alias("_part"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").alias("quantity"),
        price.cast("decimal(18,4)").alias("subtotal"),
        total.alias("total"),
        F.when(_promoted(), (price * discount).cast("decimal(18,4)")).otherwise(nothing).alias("discount_amount"),
        F.when(F.col("l_returnflag") == "R", total).otherwise(nothing).alias("refund_amount"),
    )


def _with_product(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("_part"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("unit_price"),
    )
    return lines.join(part, "_part").drop("_part")


def sales_lines(spark: SparkSession, folder: str, product: bool = False) -> DataFrame:
    """Line grain: one row per order line.

    Order heads are joined before the lines, so the lines are shuffled once, on
    the order key. Product columns cost one more join and are added on request.
    """
    lines = join_heads(order_lines(spark, folder), order_heads(spark, folder))
    sales = _line_columns(lines)
    return _with_product(spark, folder, sales) if product else sales.drop("_part")


def sales_orders(spark: SparkSession, folder: str, product: bool = False) -> DataFrame:
    """Order grain: the first line of each order, as cleaning leaves it.

    The lines are reduced on the order key they are then joined on, so they are
    shuffled once, after each task has dropped all but its first line per order.
    """
    first = first_row_per_order(order_lines(spark, folder), ["l_orderkey"], [F.col(c) for c in LINE_ORDER])
    sales = _line_columns(join_heads(first, order_heads(spark, folder)))
    return _with_product(spark, folder, sales) if product else sales.drop("_part")
