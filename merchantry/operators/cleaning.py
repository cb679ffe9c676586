"""Cleaning of raw order rows: parsing, defaults, filters, one row per order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.functions.expressions import finite
from merchantry.session import store

TENANT = ["tenant_id"]

# The columns each step applies to, null tokens and symbols.
DATE_COLUMNS = ["order_date", "paid_at", "fulfilled_at", "created_at"]
NUMERIC_COLUMNS = [
    "quantity", "unit_price", "total", "subtotal", "shipping", "taxes", "discount_amount", "total_spent", "total_orders",
]
BOOLEAN_COLUMNS = [
    "accepts_marketing", "accepts_email_marketing", "accepts_sms_marketing", "lineitem_taxable",
    "lineitem_requires_shipping",
]
STRING_COLUMNS = [
    "customer_email", "product_name", "customer_location", "customer_name", "financial_status", "fulfillment_status",
    "currency", "phone", "country", "lineitem_name", "lineitem_sku", "payment_method", "billing_name", "shipping_name",
    "order_id", "customer_id",
]
NULL_NUMBERS = ["", "null", "NULL", "None", "nan", "NaN"]
NULL_STRINGS = ["nan", "NaN", "None", "NULL"]
CURRENCY_SYMBOLS = "£$€¥,"
TRUE_WORDS = ["true", "yes", "1", "y"]
UNKNOWN_PRODUCT = "Unknown Product"
CORE_DEFAULTS = {"quantity": 1, "unit_price": 0, "total": 0}
LEFTOVER_DEFAULTS = {"quantity": 1, "shipping": 0, "taxes": 0, "discount_amount": 0}
REPORT_ERRORS = ["order_id", "total", "order_date"]
FEED_COLUMNS = {
    "sales": ["order_id", "customer_id", "product_id", "price"],
    "products": ["product_id", "name", "category", "price"],
}
QUANTITIES = {"quantity", "total_orders"}


# Dates come year first, as eight digits, with slashes, dots or dashes and a year of four or two digits, or with the
# month's English name; time of day, fraction, AM or PM and offset are optional.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_NAME = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?)"
)
_TIME = r"([T ]\s*\d{1,2}:\d{2}(:\d{2})?(\.\d+)?(\s*[AaPp]\.?[Mm]\.?)?)?\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})?$"
_ISO = r"^\d{4}([-/.])\d{1,2}\1\d{1,2}" + _TIME
_SLASHED = r"^\d{1,2}([/.-])\d{1,2}\1(\d{4}|\d{2})" + _TIME
_CLOCK = r"[T ]\s*\d{1,2}:\d{2}"
_NAMED_MONTH_FIRST = rf"(?i)^(?:[a-z]{{3,9}},?\s+)?({_NAME})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?=$|[T ,])"
_NAMED_DAY_FIRST = rf"(?i)^(?:[a-z]{{3,9}},?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?[ -]({_NAME})\.?,?[ -](\d{{4}})(?=$|[T ,])"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])"


def _plain_date(text: Column) -> Column:
    """Dates with a month's name or of eight digits as year-month-day; all others as they are."""
    text = F.trim(text)

    def named(pattern: str, year: int, month: int, day: int) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(text, pattern, i)

        name = F.lower(F.substring(part(month), 1, 3))
        number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("string")
        return F.concat(part(year), F.lit("-"), number, F.lit("-"), part(day), F.regexp_replace(F.regexp_replace(text, pattern, ""), "^,", ""))

    return (
        F.when(text.rlike(_COMPACT), F.regexp_replace(text, _COMPACT, "$1-$2-$3"))
        .when(~text.rlike("(?i)[a-z]{3}"), text)
        .when(text.rlike(_NAMED_MONTH_FIRST), named(_NAMED_MONTH_FIRST, 3, 1, 2))
        .when(text.rlike(_NAMED_DAY_FIRST), named(_NAMED_DAY_FIRST, 3, 2, 1))
        .otherwise(text)
    )


def _numbers(text: Column) -> Column:
    return F.split(text, "[^0-9]+")


def _date_shape(text: Column) -> Column:
    """What a date text looks like, and its numbers; each text is searched once."""
    return _shape_of(_plain_date(text), _numbers(_plain_date(text)))


def _with_shapes(rows: DataFrame, shapes: dict[str, str]) -> DataFrame:
    """`rows` with the shape of a date column for each name in `shapes`, in three steps that Spark compiles apart."""
    plain = {f"_{name}_plain": _plain_date(F.col(c)) for name, c in shapes.items()}
    numbers = {f"_{name}_numbers": _numbers(F.col(f"_{name}_plain")) for name in shapes}
    shaped = {name: _shape_of(F.col(f"_{name}_plain"), F.col(f"_{name}_numbers")) for name in shapes}
    return rows.withColumns(plain).withColumns(numbers).withColumns(shaped).drop(*plain, *numbers)


def _shape_of(text: Column, numbers: Column) -> Column:
    """`first`, `second` and `third` are the date's numbers as written; hour, minute and `sixtieth` (the second) are null
    where they are no time of day.
    """
    def number(i: int) -> Column:
        return F.try_element_at(numbers, F.lit(i)).try_cast("int")

    def clock(i: int, last: int) -> Column:
        value = F.coalesce(number(i), F.lit(0))
        return F.when(text.rlike(_CLOCK), F.when(value <= last, value)).otherwise(0)

    hour, half = clock(4, 99), F.lower(F.regexp_extract(text, r"(?i)\d\s*([ap])\.?m\.?", 1))
    halved = F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    return F.struct(
        F.when(text.rlike(_ISO), "iso").when(text.rlike(_SLASHED), "slashed").alias("form"),
        number(1).alias("first"), number(2).alias("second"), number(3).alias("third"),
        (F.length(F.try_element_at(numbers, F.lit(3))) == 2).alias("short"),
        F.when(half != "", halved).otherwise(hour).alias("hour"), clock(5, 59).alias("minute"), clock(6, 60).alias("sixtieth"),
    )


def _date_numbers(shape: Column, day_first: bool) -> tuple[Column, Column, Column]:
    """(year, month, day) of a shape; years of two digits are 1969 to 2068."""
    iso = shape["form"] == "iso"
    month, day = (shape["second"], shape["first"]) if day_first else (shape["first"], shape["second"])
    short = shape["third"] + F.when(shape["third"] >= 69, 1900).otherwise(2000)
    return (
        F.when(iso, shape["first"]).when(shape["short"], short).otherwise(shape["third"]),
        F.when(iso, shape["second"]).otherwise(month), F.when(iso, shape["third"]).otherwise(day),
    )


def _is_date(shape: Column, day_first: bool) -> Column:
    """Whether a shape is a date in that reading: worked out from its numbers, so that a wrong one costs no exception."""
    year, month, day = _date_numbers(shape, day_first)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    known = shape["form"].isNotNull() & year.isNotNull() & month.between(1, 12) & (day >= 1) & (day <= days)
    timed = (shape["hour"] <= 23) & shape["minute"].isNotNull() & shape["sixtieth"].isNotNull()
    return F.coalesce(known & timed, F.lit(False))


def _read_date(shape: Column, day_first: bool) -> Column:
    """The timestamp a shape stands for; slashed dates are read month or day first.

    An hour with AM or PM is one of 1 to 12, else the text
    is no date. An offset is not applied: the time stays as it is written.
    """
    return F.when(_is_date(shape, day_first), F.try_make_timestamp_ntz(
        *_date_numbers(shape, day_first), shape["hour"], shape["minute"], shape["sixtieth"].cast("decimal(16,6)")))


def parse_date(text: Column, day_first: bool) -> Column:
    return _read_date(_date_shape(text), day_first)


def date_evidence(rows: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Per group how many texts of each date column either reading can't read; sums over parts of a file add up.

    Columns: the group, then `<column>_month_nulls` and `<column>_day_nulls` of each date column present.
    """
    columns = [c for c in DATE_COLUMNS if c in rows.columns]
    shaped = _with_shapes(rows.select(*by, *columns), {f"_{c}_shape": c for c in columns})
    return shaped.groupBy(*by).agg(*[
        F.count_if(~_is_date(F.col(f"_{c}_shape"), day_first)).alias(f"{c}_{reading}_nulls")
        for c in columns for reading, day_first in (("month", False), ("day", True))
    ])


def date_readings(evidence: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Per group whether each column is day-first: that reading leaves fewer nulls; month first on a tie.

    `evidence` may hold several rows a group, from parts of a file.
    """
    columns = [c.removesuffix("_day_nulls") for c in evidence.columns if c.endswith("_day_nulls")]
    return evidence.groupBy(*by).agg(*[
        (F.sum(f"{c}_day_nulls") < F.sum(f"{c}_month_nulls")).alias(f"{c}_day_first") for c in columns
    ])


def read_dates(rows: DataFrame, readings: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """The texts of the date columns as timestamps, by each group's reading; a group without one is month-first."""
    columns = [c.removesuffix("_day_first") for c in readings.columns if c.endswith("_day_first") and c.removesuffix("_day_first") in rows.columns]
    named = readings.select(*by, *[F.col(f"{c}_day_first").alias(f"_{c}_day_first") for c in columns])
    joined = _with_shapes(rows, {f"_{c}_shape": c for c in columns}).join(named, list(by), "left")
    return joined.withColumns({
        c: F.when(F.col(f"_{c}_day_first"), _read_date(F.col(f"_{c}_shape"), True)).otherwise(
            _read_date(F.col(f"_{c}_shape"), False)
        )
        for c in columns
    }).select(*rows.columns)


def parse_dates(rows: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Whichever reading of a whole column leaves fewer nulls; month first on a tie."""
    if not any(c in rows.columns for c in DATE_COLUMNS):
        return rows
    return read_dates(rows, store(date_readings(date_evidence(rows, by), by), "date-readings"), by)


def parse_number(text: Column, kind: str = "decimal(18,4)") -> Column:
    """A number without its currency symbols; null if it is not one."""
    text = text.cast("string")
    kept = F.when(~text.isin(NULL_NUMBERS), F.trim(F.translate(text, CURRENCY_SYMBOLS, "")))
    return kept.try_cast(kind)


def parse_numbers(rows: DataFrame) -> DataFrame:
    """C2 on every numeric column present."""
    return rows.withColumns({
        c: parse_number(F.col(c), "double" if c in QUANTITIES else "decimal(18,4)")
        for c in NUMERIC_COLUMNS
        if c in rows.columns
    })


def core_defaults(rows: DataFrame, signed_totals: bool = False) -> DataFrame:
    """Default for missing quantity, price and total, and no negative ones.

    `signed_totals` keeps refunds negative.
    """
    out = {}
    for c, default in CORE_DEFAULTS.items():
        if c in rows.columns:
            kind = rows.schema[c].dataType
            filled = F.coalesce(F.col(c), F.lit(default).cast(kind))
            out[c] = filled if signed_totals and c == "total" else F.abs(filled).cast(kind)
    return rows.withColumns(out)


def parse_booleans(rows: DataFrame) -> DataFrame:
    """C4: true for true, yes, 1 and y; false for all else."""
    return rows.withColumns({
        c: F.coalesce(F.lower(F.col(c).cast("string")).isin(TRUE_WORDS), F.lit(False))
        for c in BOOLEAN_COLUMNS
        if c in rows.columns
    })


def tidy_string(text: Column) -> Column:
    """Trimmed; null and null words become empty."""
    text = text.cast("string")
    return F.trim(F.when(text.isNull() | text.isin(NULL_STRINGS), "").otherwise(text))


def tidy_strings(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: tidy_string(F.col(c)) for c in STRING_COLUMNS if c in rows.columns})


def keep_valid(rows: DataFrame) -> DataFrame:
    """Rows with an email address and an order id; a name for blank products."""
    if "customer_email" in rows.columns:
        rows = rows.where(F.col("customer_email").contains("@"))
    if "order_id" in rows.columns:
        rows = rows.where(F.col("order_id") != "")
    if "product_name" in rows.columns:
        rows = rows.withColumn(
            "product_name", F.when(F.col("product_name") == "", UNKNOWN_PRODUCT).otherwise(F.col("product_name"))
        )
    return rows


def first_row_per_order(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every order; `keys` identify the order.

    The rank-1 filter runs on each task before the shuffle, so an id repeated
    many times sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")


def drop_duplicate_orders(rows: DataFrame, order: Sequence[Column], by: Sequence[str] = TENANT) -> DataFrame:
    """C9, or C10 (whole-row duplicates) where there is no order id."""
    if "order_id" in rows.columns:
        return first_row_per_order(rows, [*by, "order_id"], order)
    return rows.dropDuplicates()


def final_check(rows: DataFrame) -> DataFrame:
    """No blank email, no null total, defaults for what is left."""
    if "customer_email" in rows.columns:
        rows = rows.where(F.col("customer_email") != "")
    if "total" in rows.columns:
        rows = rows.where(F.col("total").isNotNull())
    return rows.withColumns({
        c: F.coalesce(F.col(c), F.lit(default).cast(rows.schema[c].dataType))
        for c, default in LEFTOVER_DEFAULTS.items()
        if c in rows.columns
    })


def clean_orders(
    raw: DataFrame, order: Sequence[Column], by: Sequence[str] = TENANT, signed_totals: bool = False,
    readings: DataFrame | None = None,
) -> DataFrame:
    """All cleaning steps in their order: raw text rows to one clean row per order.

    `readings` says how each group's dates are read where more is known of them than these rows show.
    """
    dated = parse_dates(raw, by) if readings is None else read_dates(raw, readings, by)
    rows = parse_booleans(core_defaults(parse_numbers(dated), signed_totals))
    return final_check(drop_duplicate_orders(keep_valid(tidy_strings(rows)), order, by))


def row_problems(raw: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """Blank order id, total or date is an error, a missing product a warning.

    Reads mapped raw rows, numbered by `row_pos` from 0; the header is row 1.
    """
    def empty(c: str) -> Column:
        return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")

    checks = [
        F.when(
            empty(c),
            F.struct(
                F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"),
                F.lit(f"{c.replace('_', ' ').title()} is empty").alias("error"), F.lit("error").alias("severity"),
            ),
        )
        for c in REPORT_ERRORS
        if c in raw.columns
    ]
    if "product_name" in raw.columns:
        product = F.trim(F.col("product_name"))
        checks.append(F.when(
            empty("product_name") | (product == UNKNOWN_PRODUCT),
            F.struct(
                F.lit("product_name").alias("field"), F.coalesce(F.col("product_name"), F.lit("")).alias("value"),
                F.lit("Product Name is empty").alias("error"), F.lit("warning").alias("severity"),
            ),
        ))
    found = F.filter(F.array(*checks), lambda p: p.isNotNull())
    return raw.select(*keys, (F.col("row_pos") + 2).alias("row"), F.explode(found).alias("_p")).select(*keys, "row", "_p.*")


def duplicate_orders(raw: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """C14: every row but the first of each order id, with a message.

    The first positions are found by aggregation. Only ids that do repeat are
    joined back, and a partition made large by one id is split at run time.
    """
    keyed = raw.withColumn("order_id", tidy_string(F.col("order_id"))).where(F.col("order_id") != "")
    firsts = (
        keyed.groupBy(*by, "order_id")
        .agg(F.min("row_pos").alias("_first"), F.count("*").alias("_rows"))
        .where(F.col("_rows") > 1)
        .drop("_rows")
    )
    repeated = keyed.select(*by, "order_id", "row_pos").join(firsts, [*by, "order_id"])
    # Message text.
    message = F.concat(
        F.lit("Duplicate Order ID '"), F.col("order_id"), F.lit("' — this row was skipped during cleaning")
    )
    return repeated.where(F.col("row_pos") != F.col("_first")).select(
        *by, (F.col("row_pos") + 2).alias("row"), "order_id", message.alias("message"), F.lit("warning").alias("severity")
    )


def sanitised(rows: DataFrame) -> DataFrame:
    """C17: no NaN or infinite numbers, dates as ISO text."""
    out = {}
    for name, kind in rows.dtypes:
        if kind in ("double", "float"):
            out[name] = F.when(F.col(name).isNotNull(), finite(name))
        elif kind in ("timestamp", "timestamp_ntz"):
            out[name] = F.date_format(F.col(name).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "date":
            out[name] = F.date_format(name, "yyyy-MM-dd")
    return rows.withColumns(out)


def typed_feed(rows: DataFrame, kind: str) -> DataFrame:
    """A sales or products feed with its required columns and a numeric price."""
    missing = [c for c in FEED_COLUMNS[kind] if c not in rows.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return rows.withColumn("price", F.trim(F.col("price").cast("string")).try_cast("decimal(18,4)")).where(
        F.col("price").isNotNull()
    )
