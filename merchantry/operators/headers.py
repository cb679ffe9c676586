"""Header matching over a catalogue of files: one row per file and header.

Input columns: `tenant_id`, `upload_id`, `source_file`, `position` (from 0), `header`.
A file has at most a few hundred headers, so windows over one file stay short.
"""

import difflib
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantry.operators.order_statistics import top_rows
from merchantry.session import store

FILE = ["tenant_id", "upload_id", "source_file"]

# Required columns and their names in exports.
REQUIRED = {
    "order_id": ["order id", "orderid", "order number", "order_no", "order", "id", "order_id"],
    "customer_email": ["email", "customer email", "customer_email", "email address", "customer_en"],
    "order_date": ["date", "order date", "created at", "purchase date", "paid at", "order_date"],
    "quantity": ["quantity", "qty", "amount", "units", "lineitem quantity"],
    "unit_price": ["price", "unit price", "price per unit", "lineitem price", "unit_price"],
    "total": ["total", "total amount", "order total", "total_amount"],
}

# Optional columns and their names in exports.
OPTIONAL = {
    "product_name": [
        "product", "item name", "title", "product name", "lineitem name", "product_name", "item", "product_title",
    ],
    "product_id": ["product id", "product_id", "productid", "item id", "item_id", "sku", "product_sku"],
    "customer_location": [
        "location", "city", "address", "shipping address", "billing city", "shipping city", "customer_location",
        "customer_location_1", "customer_location_2",
    ],
    "customer_name": [
        "name", "customer name", "billing name", "shipping name", "first name", "last name", "customer_na",
    ],
    "customer_id": ["customer id", "customer_id", "customerid"],
    "financial_status": ["financial status", "payment status", "status"],
    "fulfillment_status": ["fulfillment status", "fulfillment_status"],
    "currency": ["currency"],
    "shipping": ["shipping"],
    "taxes": ["taxes", "tax"],
    "subtotal": ["subtotal"],
    "discount_amount": ["discount amount", "discount_amount"],
    "phone": ["phone", "billing phone", "shipping phone", "default address phone"],
    "country": ["country", "billing country", "shipping country", "default address country code"],
    "accepts_marketing": ["accepts email marketing", "accepts marketing", "accepts sms marketing"],
    "total_spent": ["total spent", "total_spent"],
    "total_orders": ["total orders", "total_orders"],
}
SYNONYMS = {**REQUIRED, **OPTIONAL}

# The fields a file cannot do without, and their names.
CRITICAL = {
    "order_id": [*REQUIRED["order_id"], "name"],
    "order_date": REQUIRED["order_date"],
    "total_price": [
        *REQUIRED["total"], "total price", "total_price", "subtotal", "grand total", "order total", "price",
    ],
    "line_items": [
        "lineitem name", "lineitem quantity", "lineitem price", "line item", "line items", "line_items", "product_name",
        "item name", "title", "product name", "product", "item", "variant title", "lineitem_name",
    ],
    "customer_identifier": [
        "email", "customer email", "customer_email", "email address", "customer id", "customer_id", "customerid",
        "customer number", "user id", "user_id", "userid", "client id", "client_id", "buyer id", "buyer_id",
        "shopper id", "contact email", "contact id", "member id", "member_id", "account id", "account_id",
    ],
}
BLOCKING = ["order_id", "order_date", "total_price"]
CRITICAL_COLUMN = {
    "order_id": "order_id", "order_date": "order_date", "total_price": "total", "line_items": "product_name",
    "customer_identifier": "customer_id",
}
SUGGEST_FROM, MEDIUM_FROM, SUGGESTIONS = 0.60, 0.75, 3

# Renames tried after the user's own mapping.
EXTRA_RENAMES = {
    "order_quantity": "quantity",
    "order_qty": "quantity",
    "lineitem_quantity": "quantity",
    "product_price": "unit_price",
    "item_price": "unit_price",
    "price_per_item": "unit_price",
    "order_price": "unit_price",
}

# Location columns by preference, and words that mark one.
LOCATION_COLUMNS = [
    "customer_location", "city", "location", "billing_city", "shipping_city", "billing_address", "shipping_address",
]
LOCATION_MARKS = "city|location|address|state|country|region"

# The columns each kind of file must have.
FILE_CONTRACTS = {
    "orders": ["order", "email", "total", "created at"],
    "products": ["title", "type", "vendor", "price"],
    "customers": ["email", "name", "total spent"],
}

# Features, their tier and the columns they need.
FEATURES = [
    ("repeat-behavior", "Starter", ["order_id", "customer_email", "order_date"]),
    ("basket-trends", "Starter", ["order_id", "product_name", "customer_email"]),
    ("customer-segments", "Pro", ["total", "quantity", "customer_email", "order_date"]),
    ("clv-analysis", "Pro", ["customer_email", "order_date", "total"]),
    ("churn-prediction", "Pro", ["customer_email", "order_date", "total"]),
    ("advanced-forecasting", "Pro", ["order_date", "total"]),
    ("ai-insights", "Pro", ["order_date", "total", "customer_email"]),
]


def plain(header: Column | str) -> Column:
    header = F.col(header) if isinstance(header, str) else header
    return F.lower(F.trim(header))


def _dictionary(spark: SparkSession, names: dict[str, list[str]], column: str) -> DataFrame:
    """A name list as a table: a few dozen fixed rows, always small enough to broadcast."""
    rows = [
        (target, i, j, name) for i, (target, listed) in enumerate(names.items()) for j, name in enumerate(listed)
    ]
    table = spark.createDataFrame(rows, f"{column} string, _dict int, _variant int, _name string")
    return F.broadcast(table.dropDuplicates([column, "_name"]))


def _standard_name() -> Column:
    """The canonical column of a plain header, from a map literal; null if none."""
    first: dict[str, str] = {}
    for target, listed in SYNONYMS.items():
        for name in listed:
            first.setdefault(name, target)
    return F.create_map(*[F.lit(x) for item in first.items() for x in item])[plain("header")]


def match_exact(headers: DataFrame) -> DataFrame:
    """Each header's canonical column; a second header for the same column
    passes through under its own plain name."""
    order = Window.partitionBy(*FILE, "_canonical").orderBy("position")
    first = F.col("_canonical").isNotNull() & (F.row_number().over(order) == 1)
    return (
        headers.withColumn("_canonical", _standard_name())
        .withColumn("canonical", F.when(first, F.col("_canonical")))
        .withColumn("column_name", F.coalesce("canonical", plain("header")))
        .drop("_canonical")
    )


def unique_names(named: DataFrame, column: str = "column_name") -> DataFrame:
    """Repeated names in a file get the suffixes _1, _2, …"""
    order = Window.partitionBy(*FILE, column).orderBy("position")
    return named.withColumn("_again", F.row_number().over(order) - 1).withColumn(
        "unique_name",
        F.when(F.col("_again") == 0, F.col(column)).otherwise(F.concat_ws("_", column, F.col("_again").cast("string"))),
    ).drop("_again")


def standard_names(headers: DataFrame) -> DataFrame:
    """Headers as cleaning names them: canonical or plain, made unique per file."""
    return unique_names(headers.withColumn("column_name", F.coalesce(_standard_name(), plain("header"))))


def best_ratio(header: str, names: Sequence[str], least: float = SUGGEST_FROM) -> float:
    """The best similarity of a header to any of some names; 0 where none reaches `least`.

    The letters that two texts share bound their similarity from above, so the full comparison runs on the names in
    the order of that bound, and only as long as one could still be better.
    """
    letters = Counter(header)

    def bound(name: str) -> float:
        return 2.0 * (letters & Counter(name)).total() / ((len(header) + len(name)) or 1)

    best = 0.0
    for most, name in sorted(((bound(name), name) for name in names), reverse=True):
        if most < least or most <= best:
            break
        best = max(best, difflib.SequenceMatcher(None, name, header).ratio())
    return best if best >= least else 0.0


def _best_ratios():
    """Per header the best similarity to any name of each critical field."""
    fields = list(CRITICAL.values())

    def best(header: str) -> list[float]:
        return [best_ratio(header, names) for names in fields]

    def ratios(headers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in headers:
            yield batch.map(best)

    return F.pandas_udf(ratios, T.ArrayType(T.DoubleType()))


def header_similarity(headers: DataFrame) -> DataFrame:
    """Similarity of every distinct header text to each critical field.

    The text comparison runs once per distinct header, not once per file.
    """
    texts = headers.select(F.lower("header").alias("_text")).distinct()
    fields = F.array(*[F.lit(f) for f in CRITICAL])
    return texts.withColumn("_ratios", _best_ratios()("_text")).select(
        "_text", F.explode(F.arrays_zip(fields.alias("field"), F.col("_ratios").alias("ratio"))).alias("_z")
    ).select("_text", F.col("_z.field").alias("field"), F.col("_z.ratio").alias("ratio"))


def exact_critical(headers: DataFrame) -> DataFrame:
    """Per file and field the header with the field's best-placed name."""
    names = _dictionary(headers.sparkSession, CRITICAL, "field")
    hits = headers.join(names, plain("header") == F.col("_name"))
    best = F.min(F.struct("_variant", (-F.col("position")).alias("_last"), "header"))
    return hits.groupBy(*FILE, "field").agg(best["header"].alias("matched_header"))


def critical_fields(headers: DataFrame) -> DataFrame:
    """B2: per file and critical field the match, its confidence and up to three suggestions."""
    # Stored: a few header texts are in most files, so joined by shuffle all files would meet on a few tasks.
    similar = store(header_similarity(headers).where(F.col("ratio") >= SUGGEST_FROM), "header-similarity")
    scored = headers.withColumn("_text", F.lower("header")).join(similar, "_text")
    best = top_rows(scored, [*FILE, "field"], [F.desc("ratio"), F.asc("position")], SUGGESTIONS, "_rank")
    suggested = best.groupBy(*FILE, "field").agg(
        F.max("ratio").alias("top_ratio"),
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "header"))), lambda s: s["header"]).alias("suggestions"),
    )
    all_fields = headers.select(*FILE).distinct().select(
        *FILE, F.explode(F.array(*[F.lit(f) for f in CRITICAL])).alias("field")
    )
    joined = all_fields.join(exact_critical(headers), [*FILE, "field"], "left").join(
        suggested, [*FILE, "field"], "left"
    )
    exact = F.col("matched_header").isNotNull()
    return joined.select(
        *FILE,
        "field",
        "matched_header",
        F.when(exact, "high")
        .when(F.col("top_ratio") >= MEDIUM_FROM, "medium")
        .when(F.col("top_ratio").isNotNull(), "low")
        .otherwise("missing")
        .alias("confidence"),
        F.when(exact, F.array().cast("array<string>"))
        .otherwise(F.coalesce("suggestions", F.array().cast("array<string>")))
        .alias("suggestions"),
    )


def needs_mapping(analysis: DataFrame) -> DataFrame:
    """B2: whether a blocking field of the file is uncertain or missing."""
    open_field = F.col("field").isin(BLOCKING) & (F.col("confidence") != "high")
    return analysis.groupBy(*FILE).agg(
        (F.count_if(open_field) > 0).alias("needs_mapping"),
        F.count_if(F.col("confidence") == "missing").alias("missing_fields"),
    )


def resolve_mapping(headers: DataFrame, user_mapping: DataFrame) -> DataFrame:
    """The user's mapping first, then the extra renames, then the synonyms.

    `user_mapping` holds the file columns, `header` and `canonical`. A later step
    never takes a column that an earlier one has filled.
    """
    user = user_mapping.select(*FILE, "header", F.col("canonical").alias("_user"))
    renamed = headers.join(user, [*FILE, "header"], "left")
    current = F.coalesce("_user", "header")
    taken = F.collect_set(current).over(Window.partitionBy(*FILE))  # the file's headers
    extra = F.create_map(*[F.lit(x) for item in EXTRA_RENAMES.items() for x in item])[F.col("header")]
    order_of = F.create_map(*[F.lit(x) for i, k in enumerate(EXTRA_RENAMES) for x in (k, i)])[F.col("header")]
    free = F.col("_user").isNull() & F.col("_extra").isNotNull() & ~F.array_contains("_taken", F.col("_extra"))
    first_extra = F.row_number().over(
        Window.partitionBy(*FILE, F.when(F.col("_free"), F.col("_extra"))).orderBy("_order")
    )
    step = (
        renamed.withColumn("_taken", taken)
        .withColumn("_extra", extra)
        .withColumn("_order", order_of)
        .withColumn("_free", free)
        .withColumn("_renamed", F.when(F.col("_free") & (first_extra == 1), F.col("_extra")))
    )
    name = F.coalesce("_user", "_renamed", _standard_name(), plain("header"))
    source = (
        F.when(F.col("_user").isNotNull(), "user")
        .when(F.col("_renamed").isNotNull(), "rename")
        .when(_standard_name().isNotNull(), "synonym")
        .otherwise("none")
    )
    return unique_names(
        step.select(*FILE, "position", "header", name.alias("column_name"), source.alias("mapped_by"))
    )


def required_columns(headers: DataFrame) -> DataFrame:
    """Required columns found and missing per file."""
    required = F.array(*[F.lit(c) for c in sorted(REQUIRED)])
    found = F.array_sort(F.coalesce(F.collect_set(F.col("_canonical")), F.array().cast("array<string>")))
    return (
        headers.withColumn("_canonical", _standard_name())
        .groupBy(*FILE)
        .agg(found.alias("found_columns"))
        .withColumn("missing_columns", F.array_except(required, "found_columns"))
    )


def upload_valid(per_file: DataFrame) -> DataFrame:
    """An export is valid when its files together have every required column."""
    required = F.array(*[F.lit(c) for c in sorted(REQUIRED)])
    return (
        per_file.select("tenant_id", "upload_id", F.explode_outer("found_columns").alias("_c"))
        .groupBy("tenant_id", "upload_id")
        .agg(F.collect_set("_c").alias("_found"))
        .withColumn("missing_columns", F.array_sort(F.array_except(required, "_found")))
        .withColumn("is_valid", F.size("missing_columns") == 0)
        .drop("_found")
    )


def normalised(header: Column | str) -> Column:
    """Plain, with spaces and hyphens as underscores."""
    return F.regexp_replace(plain(header), "[ -]", "_")


def location_header(headers: DataFrame) -> DataFrame:
    """Each file's location column: the preferred one, else the first that looks like one."""
    names = F.array(*[F.lit(c) for c in LOCATION_COLUMNS])
    preferred = F.array_position(names, F.col("header"))
    looks = F.lower("header").rlike(LOCATION_MARKS)
    rank = F.when(preferred > 0, F.struct(preferred.cast("int"), "position", "header")).when(
        looks, F.struct(F.lit(99), "position", "header")
    )
    return headers.groupBy(*FILE).agg(F.min(rank)["header"].alias("location_header"))


def customer_header(headers: DataFrame) -> DataFrame:
    """Each file's customer key column: the email, else the id."""
    canonical = _standard_name()
    choice = F.min(F.when(canonical == "customer_email", 0).when(canonical == "customer_id", 1))
    return headers.groupBy(*FILE).agg(
        F.when(choice == 0, "customer_email").when(choice == 1, "customer_id").alias("customer_key_column")
    )


def contract_check(headers: DataFrame, kind: str) -> DataFrame:
    """Which columns a file of this kind lacks; names are compared without spaces."""
    wanted = F.array(*[F.lit(c) for c in FILE_CONTRACTS[kind]])
    seen = F.collect_set(F.replace(plain("header"), F.lit(" "), F.lit("")))
    return headers.groupBy(*FILE).agg(seen.alias("_seen")).select(
        *FILE,
        F.filter(wanted, lambda c: ~F.array_contains("_seen", F.replace(c, F.lit(" "), F.lit("")))).alias("missing_columns"),
    ).withColumn("accepted", F.size("missing_columns") == 0)


def feature_availability(per_upload: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which features an export's `columns` array allows."""
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("feature"), F.lit(tier).alias("tier"),
            F.array(*[F.lit(c) for c in columns]).alias("required"),
        )
        for name, tier, columns in FEATURES
    ])
    rows = per_upload.select(*keys, "columns", F.explode(entries).alias("_f"))
    return rows.select(
        *keys, "_f.feature", "_f.tier", (F.size(F.array_except("_f.required", "columns")) == 0).alias("available")
    )


def feature_summary(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Available features in total and per tier."""
    return features.groupBy(*keys).agg(
        F.count_if("available").alias("total_available"),
        F.count_if(F.col("available") & (F.col("tier") == "Starter")).alias("starter_available"),
        F.count_if(F.col("available") & (F.col("tier") == "Pro")).alias("pro_available"),
    )


def saved_mapping(log: DataFrame) -> DataFrame:
    """Each merchant's latest saved mapping, one row per column."""
    latest = top_rows(log, ["tenant_id", "canonical"], [F.desc("updated_at"), F.asc("header")], 1, "_rank")
    return latest.select("tenant_id", "canonical", "header")


def confirmed_mapping(confirmed: DataFrame) -> DataFrame:
    """What a user confirmed, (file columns, `field`, `header`), as the mapping `resolve_mapping` takes.

    Critical fields stand for the columns they fill; other fields are columns already.
    """
    column_of = F.create_map(*[F.lit(x) for item in CRITICAL_COLUMN.items() for x in item])
    return confirmed.select(*FILE, "header", F.coalesce(column_of[F.col("field")], "field").alias("canonical"))
