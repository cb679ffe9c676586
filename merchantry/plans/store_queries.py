"""Registered queries that write to the shared folder and read back, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.operators import cleaning, exports, headers
from merchantry.plans.ingest_queries import CLEAN_DUPLICATES, CLEAN_PROBLEMS, RAW, clean_columns, raw_row_order
from merchantry.plans.ingest_queries import SQL as INGEST_SQL
from merchantry.plans.insight_queries import MARKS, TOLD_ACTIONS
from merchantry.plans.recommendation_queries import TOLD
from merchantry.plans.shared import acted_customers, insight_members_table, insights_table, members_table, orders_table
from merchantry.plans.sql_customers import with_customers, with_recommended
from merchantry.plans.sql_tables import HEADS, with_lines, with_orders
from merchantry.session import new_table_path, read_bytes
from merchantry.session import store_packed as store
from merchantry.sources import files, snapshots
from merchantry.sources.raw_exports import FILE, numbered_rows, raw_orders
from merchantry.sources.star_schema import LINE_ORDER, UPLOAD, order_heads, sales_lines, sales_orders, table
from merchantry.streaming import orders as streams

RAW_TEXT = [
    *UPLOAD, "order_id", "customer_email", "order_date", "quantity", "unit_price", "total", "discount_amount", "currency",
    "product_name",
]


def _csv_copy(s: SparkSession, rows: DataFrame, name: str) -> str:
    path = new_table_path(s, name)
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def _scan(s, f):
    path = _csv_copy(s, raw_orders(s, f).select(*RAW_TEXT), "csv-exports")
    return files.read_exports(s, path).drop("source_file")


def _numbered(s, f):
    """Rows and last position of all files read back: positions run from 0 without gaps."""
    path = _csv_copy(s, raw_orders(s, f).select(*RAW_TEXT), "csv-exports")
    rows = files.numbered_exports(s, path)
    per_file = rows.groupBy("source_file").agg(
        F.count("*").alias("rows"), F.max("row_pos").alias("last"), F.countDistinct("row_pos").alias("places")
    )
    return per_file.agg(
        F.sum("rows").alias("total_rows"),
        F.sum(F.col("last") + 1).alias("total_positions"),
        F.sum("places").alias("total_places"),
    )


# Each layout's header for a raw column, in the order of its file; two need the user's word.
LAYOUTS = [
    {"order_id": "OrderRef", "customer_email": "Email", "order_date": "Created at", "total": "Total", "quantity": "Quantity",
     "unit_price": "item_price", "product_name": "Product", "discount_amount": "Discount Amount", "currency": "Currency",
     "shipping": "Shipping", "taxes": "Tax", "accepts_marketing": "Accepts Marketing", "financial_status": "Status"},
    {"total": "Gross sum", "order_id": "Order ID", "product_name": "Item Name", "customer_email": "Customer Email",
     "quantity": "order_qty", "currency": "currency", "order_date": "Purchase Date", "unit_price": "Price",
     "taxes": "taxes", "shipping": "shipping", "discount_amount": "discount amount", "financial_status": "Payment Status",
     "accepts_marketing": "Accepts Email Marketing"},
    {"financial_status": "status", "accepts_marketing": "accepts marketing", "currency": "CURRENCY", "unit_price": "unit price",
     "customer_email": "email address", "order_date": "date", "quantity": "units", "taxes": "TAX", "shipping": "SHIPPING",
     "discount_amount": "discount_amount", "total": "total_amount", "order_id": "order number", "product_name": "title"},
]
# The text of all order lines is several times the tables it is made from, so its files are packed. Packed files aren't split: each has few rows.
PACKED = {"compression": "gzip", "maxRecordsPerFile": "1000000"}
_ORDER_TEXT = ["tenant_id", "upload_id", "source_file", "o_orderkey", *LINE_ORDER]


def _mixed_folder(s, f):
    """All raw rows as packed CSV files of three layouts, by the year of the export."""
    path = new_table_path(s, "mixed-exports")
    # Stored: each layout's files are written from it.
    raw = store(raw_orders(s, f).select(*dict.fromkeys([*LAYOUTS[0], *_ORDER_TEXT])), "raw-orders")
    for i, layout in enumerate(LAYOUTS):
        rows = raw.where(F.col("upload_id").cast("int") % len(LAYOUTS) == i).select(
            *[F.col(c).alias(h) for c, h in layout.items()], *[F.col(c).cast("string").alias(f"raw {c}") for c in _ORDER_TEXT])
        rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **PACKED).csv(f"{path}/layout-{i}")
    return f"{path}/*"


def _mixed(s, f):
    """The columns that two layouts share a header for are read by name, not by place."""
    rows = files.read_exports(s, _mixed_folder(s, f))
    names = {c: [layout[c] for layout in LAYOUTS] for c in LAYOUTS[0]}
    return rows.select(
        F.col("raw tenant_id").alias("tenant_id"), F.col("raw upload_id").alias("upload_id"), F.col("raw o_orderkey").alias("o_orderkey"),
        F.col("raw l_partkey").alias("l_partkey"),
        *[F.coalesce(*[F.col(f"`{h}`") for h in dict.fromkeys(names[c])]).alias(c) for c in ("order_id", "total", "product_name")],
    )


def _mapped(s, f):
    """Files of three layouts to clean orders in one job: scan, headers, the user's mapping, names applied, cleaning."""
    scan = files.Exports(s, _mixed_folder(s, f))
    every = store(scan.headers().select(F.lit("").alias("tenant_id"), F.lit("").alias("upload_id"), "*"), "file-headers")
    found = every.where(~F.col("header").startswith("raw "))
    field = F.when(F.col("header") == "OrderRef", "order_id").when(F.col("header") == "Gross sum", "total_price")
    user = headers.confirmed_mapping(found.withColumn("field", field).where("field is not null"))
    columns = ["tenant_id", "upload_id", "source_file", "position", "unique_name"]
    names = headers.resolve_mapping(found, user).select(*columns)
    own = every.where(F.col("header").startswith("raw ")).withColumn("unique_name", F.regexp_replace("header", "^raw ", "raw_"))
    rows = files.apply_mapping(scan.fields(), names.unionByName(own.select(*columns))).drop("tenant_id", "upload_id", "source_file")
    kinds = {"o_orderkey": "bigint", **{c: raw_orders(s, f).schema[c].dataType for c in LINE_ORDER}}
    rows = rows.withColumns({c: F.col(f"raw_{c}").cast(kinds.get(c, "string")) for c in _ORDER_TEXT})
    return clean_columns(cleaning.clean_orders(rows, raw_row_order(), UPLOAD))


def _encodings(s, f):
    """All raw rows as files in UTF-8 with and without a mark and in Latin-1, with text beyond ASCII in their headers and fields."""
    path = new_table_path(s, "encoded-exports")
    # Stored: the files of each encoding are written from it.
    raw = store(raw_orders(s, f).select(
        F.col("o_orderkey").cast("string").alias("Commande n°"), F.col("unit_price").alias("Prix"),
        F.concat(F.lit("é "), F.coalesce("product_name", F.lit(""))).alias("Détail")), "raw-orders")
    lane = F.pmod(F.xxhash64("Commande n°"), F.lit(3))
    for i, (encoding, first) in enumerate((("UTF-8", "Commande n°"), ("UTF-8", "\ufeffCommande n°"), ("ISO-8859-1", "Commande n°"))):
        raw.where(lane == i).withColumnRenamed("Commande n°", first).write.options(
            header=True, escape='"', encoding=encoding, ignoreTrailingWhiteSpace=False).csv(f"{path}/part-{i}")
    rows = files.Exports(s, f"{path}/*").rows()
    return rows.select(F.col("`Commande n°`").alias("o_orderkey"), F.col("Prix").alias("unit_price"), F.col("`Détail`").alias("detail"))


# Small splits cut many records at their edges; beyond so many they grow, as a split costs a task a scan.
SMALLEST_SPLIT, MOST_SPLITS = 262_144, 1_000


def small_split(size: int) -> int:
    """Bytes of a split for files of `size` bytes in all."""
    return max(SMALLEST_SPLIT, -(-size // MOST_SPLITS))


def _quoted_breaks(s, f):
    """All raw rows as files whose fields hold line breaks and quotes, read in small splits; with each row's place in its file."""
    path = new_table_path(s, "broken-exports")
    note = F.concat(F.lit('line one of "'), "product_name", F.lit('"\n\n, line two,\r\n"'), F.col("l_partkey").cast("string"), F.lit('"'))
    raw = raw_orders(s, f).select(F.col("o_orderkey").cast("string").alias("order"), note.alias("note"), F.col("l_partkey").cast("string").alias("part"))
    raw.write.options(header=True, escape='"').csv(path)
    before = s.conf.get("spark.sql.files.maxPartitionBytes")
    s.conf.set("spark.sql.files.maxPartitionBytes", str(small_split(read_bytes(s.read.text(path)))))
    try:
        rows = store(files.Exports(s, path).rows(), "unbroken")
    finally:
        s.conf.set("spark.sql.files.maxPartitionBytes", before)
    per_file = rows.groupBy("source_file").agg(F.count("*").alias("rows"), F.max("row_pos").alias("last"), F.countDistinct("row_pos").alias("places"))
    exact = per_file.agg(F.bool_and((F.col("rows") == F.col("last") + 1) & (F.col("rows") == F.col("places"))).alias("places_exact"))
    return rows.crossJoin(F.broadcast(exact)).select("order", "note", "part", "places_exact")  # one row of facts


def _money_as_double(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n, t in df.dtypes if t.startswith("decimal")})


def _union(s, f):
    sales = _money_as_double(sales_lines(s, f)).select(*UPLOAD, "order_id", "product_id", "total", "discount_amount")
    early = F.col("upload_id") < "1998"
    return files.union_files([sales.where(early).drop("discount_amount"), sales.where(~early)])


def _enrich(s, f):
    """Orders with their buyers in credit, the others' names null, and their priority."""
    sales = _money_as_double(sales_orders(s, f)).select("order_id", "customer_id", "total")
    buyers = table(s, f, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_name")
    )
    status = table(s, f, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_orderpriority").alias("priority")
    )
    return files.enrich_files([buyers, sales, status])


def _preview(s, f):
    heads = order_heads(s, f).orderBy("o_orderkey").select("o_orderkey", "customer_id", "order_date")
    return files.preview(heads)


def _snapshot(s, f):
    path = new_table_path(s, "snapshot")
    rows = orders_table(s, f)
    snapshots.save_snapshot(rows, path)
    # A second save of one year replaces that year only.
    snapshots.save_snapshot(rows.where(F.col("upload_id") == "2000"), path)
    return path


def _loaded(s, f, **only):
    rows = snapshots.load_snapshot(s, _snapshot(s, f), **only)
    return _money_as_double(rows).select(*UPLOAD, "order_id", "customer_id", "total", "product_name")


def _uploads(s, f):
    return order_heads(s, f).groupBy(*UPLOAD).agg(
        F.date_format(F.max("order_date"), "yyyy-MM-dd").alias("generated_at")
    )


def _active(s, f):
    """Merchants with an active export: the one of 1998, for names up to F; one names a missing export."""
    names = order_heads(s, f).select("tenant_id").distinct()
    return names.where(F.col("tenant_id") < "G").withColumn(
        "upload_id", F.when(F.col("tenant_id") < "B", "1812").otherwise("1998")
    )


def _current(s, f):
    return snapshots.current_uploads(_uploads(s, f), _active(s, f))


def _current_totals(s, f):
    rows = snapshots.current_rows(orders_table(s, f), _current(s, f))
    return rows.groupBy(*UPLOAD).agg(F.count("*").alias("orders"), F.sum("total").cast("double").alias("revenue"))


def _history(s, f):
    """Every order is one status change of its customer's export."""
    step = F.col("o_orderkey")
    events = order_heads(s, f).select(
        "tenant_id",
        F.col("customer_id").alias("upload_id"),
        F.date_format("order_date", "yyyy-MM-dd").alias("event_time"),
        step.alias("step"),
        F.when(step % 3 == 0, "processing").when(step % 3 == 1, "complete").otherwise("failed").alias("status"),
        (step % 1000).alias("row_count"),
    )
    return snapshots.upload_history(events)


def _csv_round_trip(s: SparkSession, rows: DataFrame, name: str, folder: str) -> DataFrame:
    """Lists as merchants get them, packed as the texts in them repeat, and read back."""
    path = new_table_path(s, name)
    exports.write_csv(rows, path, [folder], PACKED["compression"])
    back = s.read.schema(rows.schema).options(header=True, escape='"', emptyValue="", nullValue="\\N").csv(path)
    return back.select(*rows.columns)


def _full(s, f, part: str):
    return exports.full_export(acted_customers(s, f), insight_members_table(s, f), insights_table(s, f), UPLOAD)[part]


def _problems(s, f):
    raw = numbered_rows(raw_orders(s, f))
    return exports.problem_export(cleaning.row_problems(raw, FILE), cleaning.duplicate_orders(raw, FILE), FILE)


def _stream_orders(s, f):
    """L2: raw rows in four arrivals that cut every export, by a hash of the order; one arrival is delivered twice.

    Whether an export is month- or day-first shows in some arrivals only. Then the whole feed is delivered once
    more, and one export is replaced by a plain save.
    """
    feed_path, out, state = (new_table_path(s, n) for n in ("feed", "stream-orders", "stream-orders-state"))
    raw = raw_orders(s, f).withColumn("l_shipdate", F.col("l_shipdate").cast("string"))
    lane = F.pmod(F.xxhash64("o_orderkey"), F.lit(3))
    for arrival in (lane == 0, lane == 1, lane == 0, lane == 2):
        raw.where(arrival).write.mode("append").parquet(feed_path)
        streams.load_orders(streams.order_feed(s, feed_path, raw.schema), out, state, raw_row_order()).awaitTermination()
    again = streams.order_feed(s, feed_path, raw.schema)
    streams.load_orders(again, out, new_table_path(s, "stream-orders-state"), raw_row_order()).awaitTermination()
    loaded = snapshots.load_snapshot(s, out)
    snapshots.save_snapshot(store(loaded.where("tenant_id = 'BUILDING' AND upload_id = '1999'"), "one-export"), out)
    return clean_columns(snapshots.load_snapshot(s, out))


def _stream_revenue(s, f):
    """L3: the events table as a stream in four arrivals, the latest days first and every day in two of them."""
    feed_path, out, state = (new_table_path(s, n) for n in ("events", "stream-revenue", "stream-revenue-state"))
    events = table(s, f, "events")
    late, odd = F.dayofmonth("ts") > 15, F.col("event_id") % 2 == 1
    for arrival in (late & odd, ~late & odd, late & ~odd, ~late & ~odd):
        events.where(arrival).write.mode("append").parquet(feed_path)
        streams.load_revenue(streams.order_feed(s, feed_path, events.schema), out, state).awaitTermination()
    return streams.load_trend(s, out)


QUERIES = {
    "a1_csv_scan": _scan,
    "a1_numbered_rows": _numbered,
    "a1_mixed_layouts": _mixed,
    "b3_applied_mapping": _mapped,
    "a1_encodings": _encodings,
    "a1_quoted_breaks": _quoted_breaks,
    "a2_union_files": _union,
    "a3_enrich_files": _enrich,
    "a4_preview": _preview,
    "a5_save_snapshot": _loaded,
    "a6_load_snapshot": lambda s, f: _loaded(s, f, tenant="BUILDING", upload="1999"),
    "a7_stored_insights": lambda s, f: insights_table(s, f).select(*UPLOAD, "insight_id", "score"),
    "a8_current_uploads": _current,
    "a8_current_rows": _current_totals,
    "a9_upload_history": _history,
    "a10_segment_export": lambda s, f: _csv_round_trip(
        s, exports.segment_export(acted_customers(s, f), UPLOAD), "segments-csv", "segment"
    ),
    "a11_action_export": lambda s, f: _csv_round_trip(
        s, exports.action_export(acted_customers(s, f), members_table(s, f), UPLOAD), "actions-csv", "action_key"
    ),
    "a12_insight_export": lambda s, f: _csv_round_trip(
        s, exports.insight_export(acted_customers(s, f), insight_members_table(s, f), insights_table(s, f), UPLOAD), "insights-csv", "insight_id"
    ),
    "a13_full_export_segments": lambda s, f: _full(s, f, "segments"),
    "a13_full_export_actions": lambda s, f: _full(s, f, "actions"),
    "a13_full_export_insights": lambda s, f: _full(s, f, "insights").drop("suggested_action"),
    "a14_problem_export": _problems,
    "l2_order_stream": _stream_orders,
    "l3_revenue_stream": _stream_revenue,
    "l3_daily_revenue": lambda s, f: streams.daily_revenue(table(s, f, "events")),
}

_U = "tenant_id, upload_id"
_BLANK = "''"
_DAY = "strftime(last_order_date, '%d %b %Y') AS last_order"
_DAILY = """WITH d AS (SELECT date_trunc('day', ts) AS day, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS orders, count(DISTINCT user_id) AS customers
  FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d') AS period, revenue, orders"""

SQL = {
    # An empty field is read as null.
    "a1_csv_scan": RAW + f"SELECT {', '.join(f'nullif({c}, {_BLANK}) AS {c}' for c in RAW_TEXT)} FROM raw",
    "a1_numbered_rows": RAW + "SELECT count(*) AS total_rows, count(*) AS total_positions, count(*) AS total_places FROM raw",
    "a1_mixed_layouts": RAW + f"""
SELECT tenant_id, upload_id, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey,
  nullif(order_id, '') AS order_id, nullif(total, '') AS total, nullif(product_name, '') AS product_name FROM raw""",
    "b3_applied_mapping": INGEST_SQL["c12_clean_orders"],
    "a1_encodings": RAW + "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, unit_price, 'é ' || product_name AS detail FROM raw",
    "a1_quoted_breaks": RAW + """SELECT CAST(o_orderkey AS VARCHAR) AS "order", CAST(l_partkey AS VARCHAR) AS part, TRUE AS places_exact,
  'line one of "' || product_name || '"' || chr(10) || chr(10) || ', line two,' || chr(13) || chr(10) || '"' || l_partkey || '"' AS note FROM raw""",
    "a2_union_files": with_lines(f"""
SELECT {_U}, order_id, product_id, CAST(total AS DOUBLE) AS total,
  CASE WHEN upload_id >= '1998' THEN CAST(discount_amount AS DOUBLE) END AS discount_amount FROM lines"""),
    "a3_enrich_files": with_orders("""
SELECT order_id, customer_id, CAST(total AS DOUBLE) AS total, c_name AS customer_name, o_orderpriority AS priority
FROM sales LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON CAST(c_custkey AS VARCHAR) = customer_id
LEFT JOIN orders ON CAST(orders.o_orderkey AS VARCHAR) = order_id"""),
    "a4_preview": f"""WITH {HEADS}
SELECT o_orderkey, customer_id, strftime(order_date, '%Y-%m-%d %H:%M:%S') AS order_date FROM heads ORDER BY o_orderkey LIMIT 10""",
    "a5_save_snapshot": with_orders(f"SELECT {_U}, order_id, customer_id, CAST(total AS DOUBLE) AS total, product_name FROM sales"),
    "a6_load_snapshot": with_orders(f"""
SELECT {_U}, order_id, customer_id, CAST(total AS DOUBLE) AS total, product_name FROM sales WHERE tenant_id = 'BUILDING' AND upload_id = '1999'"""),
    "a7_stored_insights": with_customers(MARKS + f"SELECT {_U}, insight_id, score FROM placed"),
    "a8_current_uploads": f"""WITH {HEADS},
up AS (SELECT {_U}, strftime(max(order_date), '%Y-%m-%d') AS generated_at FROM heads GROUP BY ALL)
SELECT *, upload_id = '1998' AND tenant_id < 'G' AND tenant_id >= 'B' AS is_active FROM up
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY upload_id = '1998' AND tenant_id < 'G' AND tenant_id >= 'B' DESC, generated_at DESC, upload_id DESC) = 1""",
    "a8_current_rows": with_orders(f"""
, tops AS (SELECT {_U}, max(order_date) AS generated_at FROM heads GROUP BY ALL),
up AS (SELECT * FROM tops QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY upload_id = '1998' AND tenant_id < 'G' AND tenant_id >= 'B' DESC, generated_at DESC, upload_id DESC) = 1)
SELECT {_U}, count(*) AS orders, CAST(sum(total) AS DOUBLE) AS revenue FROM sales SEMI JOIN up USING ({_U}) GROUP BY ALL"""),
    "a9_upload_history": f"""WITH {HEADS},
e AS (SELECT tenant_id, customer_id AS upload_id, strftime(order_date, '%Y-%m-%d') AS event_time, o_orderkey AS step,
        CASE o_orderkey % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'complete' ELSE 'failed' END AS status, o_orderkey % 1000 AS row_count FROM heads),
l AS (SELECT *, min(event_time) OVER g AS created_at, count(*) OVER g AS status_changes,
        row_number() OVER (PARTITION BY {_U} ORDER BY event_time DESC, step DESC) AS r FROM e WINDOW g AS (PARTITION BY {_U}))
SELECT {_U}, created_at, status, row_count, status_changes, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, upload_id DESC) AS position
FROM l WHERE r = 1""",
    "a10_segment_export": with_recommended(TOLD + f"""
SELECT {_U}, customer_key AS email_or_id, segment, total_revenue AS total_spent, order_count AS orders, {_DAY},
  floor(aov * 100 + 0.5) / 100 AS avg_order_value, days_since_last_order, recommended_action, action_reason FROM told"""),
    "a11_action_export": with_recommended(TOLD_ACTIONS + f"""
SELECT {_U}, action_key, customer_key AS email_or_id, recommended_action AS action, action_priority AS priority, suggested_channel AS channel,
  suggested_timing AS timing, action_reason AS reason, total_revenue AS total_spent, order_count AS orders, {_DAY} FROM chosen"""),
    "a12_insight_export": with_customers(MARKS + f"""
SELECT {_U}, insight_id, customer_key AS email_or_id, p.category AS insight_category, p.headline AS insight_headline,
  total_revenue AS total_spent, order_count AS orders, {_DAY}, days_since_last_order, segment FROM behind JOIN placed p USING ({_U}, insight_id)"""),
    "a13_full_export_segments": with_recommended(f"""
SELECT {_U}, customer_key AS email_or_id, segment, total_revenue AS total_spent, order_count AS orders, {_DAY},
  floor(aov * 100 + 0.5) / 100 AS avg_order_value, recommended_action FROM acted"""),
    "a13_full_export_actions": with_recommended(TOLD + f"""
SELECT {_U}, customer_key AS email_or_id, recommended_action AS action, action_priority AS priority, suggested_channel AS channel,
  suggested_timing AS timing, action_reason AS reason, total_revenue AS total_spent, order_count AS orders, {_DAY} FROM told"""),
    "a13_full_export_insights": with_customers(MARKS + f"""
SELECT {_U}, customer_key AS email_or_id, insight_id, p.category, p.headline, p.confidence, p.revenue_at_stake,
  total_revenue AS total_spent, segment FROM behind JOIN placed p USING ({_U}, insight_id)"""),
    "a14_problem_export": RAW + f""", problems AS ({CLEAN_PROBLEMS}){CLEAN_DUPLICATES[0]}
SELECT * FROM problems UNION ALL BY NAME
SELECT {', '.join(FILE)}, "row", 'order_id' AS field, order_id AS value, message AS error, severity FROM ({CLEAN_DUPLICATES[1]})""",
    "l2_order_stream": INGEST_SQL["c12_clean_orders"],
    "l3_revenue_stream": _DAILY + ", customers FROM d",
    "l3_daily_revenue": _DAILY + ", customers FROM d",
}
