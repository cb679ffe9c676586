"""Raw export rows and file headers as merchants send them, made from the tables.

Every order line becomes one untidy text row; every customer becomes one file
with its own header names. Both grow with the tables they are made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.operators.order_statistics import OrderedGroups
from merchantry.sources.star_schema import LINE_ORDER, join_heads, order_heads, order_lines, table

FILE = ["tenant_id", "upload_id", "source_file"]
ROW_ORDER = [*FILE, "o_orderkey", *LINE_ORDER]


def _lane(column: str, n: int) -> Column:
    return F.col(column) % n


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One untidy text row per order line, with the columns that order the rows of a file."""
    # Parts first: were they too many to send, joining them last would scatter an order's lines. What the number and date of an order
    # tell is added after the joins.
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    lines = order_lines(spark, folder).join(part, F.col("l_partkey") == F.col("p_partkey"))
    p, day = "l_partkey", F.col("order_date").cast("date")
    rows = join_heads(lines, order_heads(spark, folder).drop("upload_id", "order_id", "customer_name")).withColumns({
        "upload_id": F.date_format(day, "yyyy"), "order_id": F.col("o_orderkey").cast("string"),
    })
    price = F.format_number(F.col("l_extendedprice").cast("decimal(12,2)"), 2)
    day_first = F.col("upload_id").cast("int") % 2 == 0
    buyer = F.concat(F.lit("user"), F.col("customer_id"))
    return rows.select(
        "tenant_id",
        "upload_id",
        F.concat_ws("/", "upload_id", "customer_location").alias("source_file"),
        "o_orderkey",
        *LINE_ORDER,
        F.when(_lane(p, 97) == 0, "")
        .when(_lane(p, 101) == 0, F.concat(F.lit(" #"), "order_id", F.lit(" ")))
        .otherwise(F.concat(F.lit("#"), "order_id"))
        .alias("order_id"),
        F.when(F.col("customer_id").cast("bigint") % 41 == 0, buyer)
        .when(_lane(p, 3) == 0, F.concat(F.lit("  "), buyer, F.lit("@shop.example ")))
        .otherwise(F.concat(buyer, F.lit("@shop.example")))
        .alias("customer_email"),
        F.when(_lane(p, 89) == 0, "not a date")
        .when(_lane(p, 83) == 0, F.date_format(day, "yyyyMMdd"))
        .when(_lane(p, 79) == 0, F.concat(F.date_format(day, "yyyy/MM/dd"), F.lit(" 3:30 PM")))
        .when(_lane(p, 73) == 0, F.date_format(day, "MMM d, yyyy"))
        .when(_lane(p, 43) == 0, F.concat(F.date_format(day, "d MMMM yyyy"), F.lit(" 12:05 am")))
        .when((_lane(p, 37) == 0) & day_first, F.date_format(day, "dd/MM/yy"))
        .when(_lane(p, 37) == 0, F.date_format(day, "MM/dd/yy"))
        .when(_lane(p, 7) == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 14:30:00 +0000")))
        .when(day_first, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "MM/dd/yyyy"))
        .alias("order_date"),
        F.when(_lane(p, 53) == 0, "").when(_lane(p, 59) == 0, "-5")
        .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity"),
        F.when(_lane(p, 61) == 0, "NaN")
        .otherwise(F.concat(F.lit("£"), F.format_number(F.col("p_retailprice").cast("decimal(12,2)"), 2)))
        .alias("unit_price"),
        F.when(_lane(p, 67) == 0, "null").when(F.col("l_returnflag") == "R", F.concat(F.lit("-£"), price))
        .otherwise(F.concat(F.lit("$"), price)).alias("total"),
        F.when(_lane(p, 5) != 0, F.round(F.col("l_discount") * 100).cast("int").cast("string")).alias("discount_amount"),
        F.when(_lane(p, 11) == 0, "abc").otherwise("4.99").alias("shipping"),
        F.when(_lane(p, 13) != 0, "1.50").alias("taxes"),
        F.when(_lane(p, 7) == 0, "Yes").when(_lane(p, 7) == 1, "no").when(_lane(p, 7) == 2, "1")
        .when(_lane(p, 7) == 3, "0").when(_lane(p, 7) == 4, "maybe").when(_lane(p, 7) == 5, "TRUE")
        .alias("accepts_marketing"),
        F.when(_lane(p, 17) == 0, "nan").when(_lane(p, 2) == 0, "GBP").otherwise(" usd ").alias("currency"),
        F.when(_lane(p, 61) == 0, "").when(_lane(p, 71) == 0, "None").otherwise(F.col("p_name")).alias("product_name"),
        F.col("financial_status"),
    )


def numbered_rows(raw: DataFrame) -> DataFrame:
    """Raw rows with their exact position in their file, from 0, for files of any size."""
    order = [F.col(c) for c in ROW_ORDER if c not in FILE]
    ranked = OrderedGroups(raw, FILE, order, "raw-rows").ranked("_rank")
    return ranked.withColumn("row_pos", F.col("_rank") - 1).drop("_rank")


# Header names a file may use, by column; the customer's number picks one.
HEADER_CHOICES = [
    ["Order ID", "order_no", "Order Number ", "Reference", "OrderRef", "Name"],
    ["Email", "customer_email", "E-mail Address", "Customer ID", "Buyer-ID"],
    ["Created at", "order date", "Order Dat", "Placed On"],
    ["Quantity", "order_qty", "lineitem quantity"],
    ["Price", "unit price", "item_price", "product_price"],
    ["Total", "Order Total", "Totl Price", "Gross", "total amount"],
    ["Lineitem name", "Product", "Product Titel"],
    ["Billing City", "shipping_city", "State", "Region code"],
    ["Subtotal", "Shipping", "Total"],
    ["Discount Amount", "Currency", "Email"],
]


# Files of at most about this many a task: a compressed customer table is read by very few.
FILES_PER_TASK = 20_000


def file_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file and header; a file per customer. The files are dealt over tasks before they become rows."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-customer.count() // FILES_PER_TASK))
    customer = customer.repartition(parts, "c_custkey")
    key = F.col("c_custkey")
    picks = [
        F.struct(
            F.lit(i).alias("position"),
            F.element_at(
                F.array(*[F.lit(c) for c in choices]), ((key * (i + 3) + F.floor(key / 7)) % len(choices) + 1).cast("int")
            ).alias("header"),
        )
        for i, choices in enumerate(HEADER_CHOICES)
    ]
    return customer.select(
        F.col("c_mktsegment").alias("tenant_id"),
        F.concat(F.lit("u"), (key % 50).cast("string")).alias("upload_id"),
        F.concat(F.lit("file-"), key.cast("string"), F.lit(".csv")).alias("source_file"),
        F.explode(F.array(*picks)).alias("_h"),
    ).select(*FILE, "_h.position", "_h.header")


def user_mappings(headers: DataFrame) -> DataFrame:
    """The mapping a user confirmed for a file: odd names for order id and total."""
    canonical = (
        F.when(F.col("header").isin("Reference", "OrderRef"), "order_id")
        .when(F.col("header") == "Gross", "total")
        .when(F.col("header") == "Buyer-ID", "customer_id")
    )
    return headers.withColumn("canonical", canonical).where(F.col("canonical").isNotNull()).select(
        *FILE, "header", "canonical"
    )
