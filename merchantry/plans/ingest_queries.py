"""Registered queries over raw rows and file headers."""

from __future__ import annotations

import difflib

from pyspark.sql import functions as F

from merchantry.functions.expressions import safe_div, slug
from merchantry.operators import cleaning as c
from merchantry.operators import headers as b
from merchantry.plans.sql_tables import HEADS
from merchantry.sources.raw_exports import (
    FILE, HEADER_CHOICES, ROW_ORDER, file_headers, numbered_rows, raw_orders, user_mappings,
)
from merchantry.sources.star_schema import UPLOAD, table

KEYS = [*UPLOAD, "o_orderkey", "l_partkey"]


def raw_row_order():
    return [F.col(name) for name in ROW_ORDER if name not in UPLOAD]


def _raw(s, f):
    return raw_orders(s, f)


def _text_dates(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def _as_doubles(df, names):
    return df.withColumns({n: F.col(n).cast("double") for n in names if n in df.columns})


NUMBERS = ["quantity", "unit_price", "total", "discount_amount", "shipping", "taxes"]
STRINGS = ["customer_email", "product_name", "financial_status", "currency", "order_id"]


def _clean(s, f):
    return clean_columns(c.clean_orders(_raw(s, f), raw_row_order(), UPLOAD))


def clean_columns(clean):
    return _as_doubles(_text_dates(clean, "order_date"), NUMBERS).select(
        *UPLOAD, "source_file", "order_id", "customer_email", "order_date", *NUMBERS, "accepts_marketing", "currency",
        "product_name", "financial_status",
    )


def _no_order_id(s, f):
    """Rows that carry no order id: whole-row duplicates are dropped."""
    rows = _raw(s, f).select(*UPLOAD, "customer_email", "quantity", "product_name")
    return c.drop_duplicate_orders(rows, [], UPLOAD)


def _ratios(s, f):
    """Discount share of price over all lines, with zero and null denominators."""
    lines = table(s, f, "lineitem")
    zero_or_null = F.when(F.col("l_partkey") % 5 == 0, 0.0).when(F.col("l_partkey") % 7 != 0, F.col("l_quantity"))
    return lines.select("l_orderkey", "l_partkey", safe_div("l_extendedprice", zero_or_null).alias("ratio"))


def _sanitised(s, f):
    lines = table(s, f, "lineitem")
    odd = (
        F.when(F.col("l_partkey") % 11 == 0, F.lit(float("nan")))
        .when(F.col("l_partkey") % 13 == 0, F.lit(float("inf")))
        .when(F.col("l_partkey") % 17 != 0, F.col("l_extendedprice"))
    )
    rows = lines.select("l_orderkey", "l_partkey", odd.alias("amount"), F.col("l_shipdate").cast("timestamp_ntz").alias("shipped"))
    return c.sanitised(rows)


def _sales_feed(s, f):
    raw = _raw(s, f).withColumn("price", F.regexp_replace("total", "[$,]", ""))
    feed = raw.select(
        *UPLOAD, "order_id", F.col("customer_email").alias("customer_id"), F.col("l_partkey").alias("product_id"), "price"
    )
    return _as_doubles(c.typed_feed(feed, "sales"), ["price"])


def _columns_per_upload(s, f):
    named = b.match_exact(file_headers(s, f)).where(F.col("canonical").isNotNull())
    return named.groupBy(*FILE).agg(F.collect_set("canonical").alias("columns"))


def _mapping_log(s, f):
    """One saved mapping entry per file and confirmed column; later files are newer."""
    mapped = user_mappings(file_headers(s, f))
    return mapped.withColumn("updated_at", F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint"))


def _joined(column):
    return F.array_join(column, ",").alias(column)


QUERIES = {
    "b1_header_match": lambda s, f: b.match_exact(file_headers(s, f)),
    "b2_critical_fields": lambda s, f: (lambda a: a.select(
        *FILE, "field", "matched_header", "confidence", F.array_join("suggestions", "|").alias("suggestions")
    ))(b.critical_fields(file_headers(s, f))),
    "b2_needs_mapping": lambda s, f: b.needs_mapping(b.critical_fields(file_headers(s, f))),
    "b2_exact_critical": lambda s, f: b.exact_critical(file_headers(s, f)),
    "b3_resolved_mapping": lambda s, f: b.resolve_mapping(file_headers(s, f), user_mappings(file_headers(s, f))),
    "b4_required_columns": lambda s, f: b.required_columns(file_headers(s, f)).select(
        *FILE, _joined("found_columns"), _joined("missing_columns")
    ),
    "b4_upload_valid": lambda s, f: b.upload_valid(b.required_columns(file_headers(s, f))).select(
        *UPLOAD, _joined("missing_columns"), "is_valid"
    ),
    "b5_literal_total": lambda s, f: b.match_exact(file_headers(s, f)).where(F.col("canonical").isin("total", "subtotal")).select(
        *FILE, "position", "header", "canonical"
    ),
    "b6_unique_names": lambda s, f: b.standard_names(file_headers(s, f)).select(*FILE, "position", "unique_name"),
    "b7_normalised_headers": lambda s, f: file_headers(s, f).select(
        *FILE, "position", b.normalised("header").alias("normalised")
    ),
    "b8_location_header": lambda s, f: b.location_header(
        file_headers(s, f).withColumn("header", b.normalised("header"))
    ),
    "b9_customer_header": lambda s, f: b.customer_header(file_headers(s, f)),
    "b10_feature_availability": lambda s, f: b.feature_availability(_columns_per_upload(s, f), FILE),
    "b10_feature_summary": lambda s, f: b.feature_summary(
        b.feature_availability(_columns_per_upload(s, f), FILE), FILE
    ),
    "b11_saved_mapping": lambda s, f: b.saved_mapping(_mapping_log(s, f)),
    "c1_parsed_dates": lambda s, f: _text_dates(c.parse_dates(_raw(s, f), UPLOAD), "order_date").select(*KEYS, "order_date"),
    "c2_parsed_numbers": lambda s, f: _as_doubles(c.parse_numbers(_raw(s, f)), NUMBERS).select(*KEYS, *NUMBERS),
    "c3_core_defaults": lambda s, f: _as_doubles(c.core_defaults(c.parse_numbers(_raw(s, f))), NUMBERS).select(
        *KEYS, "quantity", "unit_price", "total"
    ),
    "c4_booleans": lambda s, f: c.parse_booleans(_raw(s, f)).select(*KEYS, "accepts_marketing"),
    "c5_tidy_strings": lambda s, f: c.tidy_strings(_raw(s, f)).select(*KEYS, *STRINGS),
    "c6_valid_rows": lambda s, f: c.keep_valid(c.tidy_strings(_raw(s, f))).select(
        *KEYS, "customer_email", "order_id", "product_name"
    ),
    "c9_first_row_per_order": lambda s, f: c.drop_duplicate_orders(
        c.keep_valid(c.tidy_strings(_raw(s, f))), raw_row_order(), UPLOAD
    ).select(*KEYS, "order_id", "product_name"),
    "c10_drop_duplicates": _no_order_id,
    "c12_clean_orders": _clean,
    "c13_row_problems": lambda s, f: c.row_problems(numbered_rows(_raw(s, f)), FILE),
    "c14_duplicate_orders": lambda s, f: c.duplicate_orders(numbered_rows(_raw(s, f)), FILE),
    "c16_safe_division": _ratios,
    "c17_sanitised": _sanitised,
    "c18_sales_feed": _sales_feed,
    "c19_file_contract": lambda s, f: b.contract_check(file_headers(s, f), "orders").select(
        *FILE, _joined("missing_columns"), "accepted"
    ),
    "j5_slugs": lambda s, f: table(s, f, "pages").select("page_id", slug("url").alias("slug")),
}

RAW = f"""WITH {HEADS},
raw AS (
  SELECT tenant_id, upload_id, upload_id || '/' || customer_location AS source_file, o_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_shipdate, l_quantity, l_partkey AS p, financial_status,
    CASE WHEN l_partkey % 97 = 0 THEN '' WHEN l_partkey % 101 = 0 THEN ' #' || order_id || ' ' ELSE '#' || order_id END AS order_id,
    CASE WHEN c_custkey % 41 = 0 THEN 'user' || customer_id WHEN l_partkey % 3 = 0 THEN '  user' || customer_id || '@shop.example '
         ELSE 'user' || customer_id || '@shop.example' END AS customer_email,
    CASE WHEN l_partkey % 89 = 0 THEN 'not a date' WHEN l_partkey % 83 = 0 THEN strftime(order_date, '%Y%m%d')
         WHEN l_partkey % 79 = 0 THEN strftime(order_date, '%Y/%m/%d') || ' 3:30 PM' WHEN l_partkey % 73 = 0 THEN strftime(order_date, '%b %-d, %Y')
         WHEN l_partkey % 43 = 0 THEN strftime(order_date, '%-d %B %Y') || ' 12:05 am'
         WHEN l_partkey % 37 = 0 THEN CASE WHEN CAST(upload_id AS INT) % 2 = 0 THEN strftime(order_date, '%d/%m/%y') ELSE strftime(order_date, '%m/%d/%y') END
         WHEN l_partkey % 7 = 0 THEN strftime(order_date, '%Y-%m-%d') || ' 14:30:00 +0000'
         WHEN CAST(upload_id AS INT) % 2 = 0 THEN strftime(order_date, '%d/%m/%Y') ELSE strftime(order_date, '%m/%d/%Y') END AS order_date,
    CASE WHEN l_partkey % 53 = 0 THEN '' WHEN l_partkey % 59 = 0 THEN '-5' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS quantity,
    CASE WHEN l_partkey % 61 = 0 THEN 'NaN' ELSE '£' || format('{{:,.2f}}', p_retailprice) END AS unit_price,
    CASE WHEN l_partkey % 67 = 0 THEN 'null' WHEN l_returnflag = 'R' THEN '-£' || format('{{:,.2f}}', l_extendedprice)
         ELSE '$' || format('{{:,.2f}}', l_extendedprice) END AS total,
    CASE WHEN l_partkey % 5 <> 0 THEN CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) END AS discount_amount,
    CASE WHEN l_partkey % 11 = 0 THEN 'abc' ELSE '4.99' END AS shipping,
    CASE WHEN l_partkey % 13 <> 0 THEN '1.50' END AS taxes,
    CASE l_partkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' WHEN 5 THEN 'TRUE' END AS accepts_marketing,
    CASE WHEN l_partkey % 17 = 0 THEN 'nan' WHEN l_partkey % 2 = 0 THEN 'GBP' ELSE ' usd ' END AS currency,
    CASE WHEN l_partkey % 61 = 0 THEN '' WHEN l_partkey % 71 = 0 THEN 'None' ELSE p_name END AS product_name
  FROM lineitem JOIN heads ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
dated AS (
  SELECT *, CASE WHEN length(order_date) = 8 AND contains(order_date, '/') THEN try_strptime(order_date, '%m/%d/%y')
      ELSE coalesce(try_strptime(order_date, '%m/%d/%Y'), clear) END AS month_first,
    CASE WHEN length(order_date) = 8 AND contains(order_date, '/') THEN try_strptime(order_date, '%d/%m/%y')
      ELSE coalesce(try_strptime(order_date, '%d/%m/%Y'), clear) END AS day_first
  FROM (SELECT *, coalesce(CAST(try_strptime(order_date, '%Y-%m-%d %H:%M:%S +0000') AS TIMESTAMP),
    try_strptime(order_date, ['%Y%m%d', '%Y/%m/%d %I:%M %p', '%b %d, %Y', '%d %B %Y %I:%M %p'])) AS clear FROM raw)),
picked AS (SELECT tenant_id, upload_id, count(*) FILTER (WHERE day_first IS NULL) < count(*) FILTER (WHERE month_first IS NULL) AS use_day
           FROM dated GROUP BY ALL),
parsed AS (
  SELECT d.* EXCLUDE (clear) REPLACE (strftime(CASE WHEN use_day THEN day_first ELSE month_first END, '%Y-%m-%d %H:%M:%S') AS order_date,
    TRY_CAST(CASE WHEN quantity NOT IN ('','null','NaN') THEN regexp_replace(quantity, '[£$€¥,]', '', 'g') END AS DOUBLE) AS quantity,
    TRY_CAST(CASE WHEN unit_price NOT IN ('','null','NaN') THEN regexp_replace(unit_price, '[£$€¥,]', '', 'g') END AS DOUBLE) AS unit_price,
    TRY_CAST(CASE WHEN total NOT IN ('','null','NaN') THEN regexp_replace(total, '[£$€¥,]', '', 'g') END AS DOUBLE) AS total,
    TRY_CAST(discount_amount AS DOUBLE) AS discount_amount, TRY_CAST(shipping AS DOUBLE) AS shipping, TRY_CAST(taxes AS DOUBLE) AS taxes,
    coalesce(lower(accepts_marketing) IN ('true', 'yes', '1', 'y'), FALSE) AS accepts_marketing,
    trim(customer_email) AS customer_email, trim(order_id) AS order_id,
    CASE WHEN currency = 'nan' THEN '' ELSE trim(currency) END AS currency,
    CASE WHEN product_name = 'None' THEN '' ELSE trim(product_name) END AS product_name)
  FROM dated d JOIN picked USING (tenant_id, upload_id)),
valid AS (SELECT * REPLACE (CASE WHEN product_name = '' THEN 'Unknown Product' ELSE product_name END AS product_name) FROM parsed
          WHERE contains(customer_email, '@') AND order_id <> ''),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, upload_id, source_file ORDER BY o_orderkey, l_linenumber, l_partkey,
               l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS row_pos FROM raw)
"""

_ROW_ORDER = "source_file, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity"


def _dictionary_sql() -> str:
    rows = [
        f"('{target}', {i}, {j}, '{name}')"
        for i, (target, names) in enumerate(b.SYNONYMS.items())
        for j, name in enumerate(names)
    ]
    return "synonyms(canonical, dict_pos, variant_pos, name) AS (VALUES " + ", ".join(rows) + ")"


def _critical_sql() -> str:
    rows = [
        f"('{field}', {j}, '{name}')" for field, names in b.CRITICAL.items() for j, name in enumerate(names)
    ]
    return "critical(field, variant_pos, name) AS (VALUES " + ", ".join(rows) + ")"


def _choices_sql() -> str:
    picks = []
    for i, choices in enumerate(HEADER_CHOICES):
        listed = ", ".join(f"'{name}'" for name in choices)
        picks.append(f"{{'position': {i}, 'header': [{listed}][(c_custkey * {i + 3} + c_custkey // 7) % {len(choices)} + 1]}}")
    return "[" + ", ".join(picks) + "]"


_HEADERS = f"""WITH exploded AS (
  SELECT c_mktsegment AS tenant_id, 'u' || (c_custkey % 50) AS upload_id, 'file-' || c_custkey || '.csv' AS source_file, c_custkey,
    unnest({_choices_sql()}) AS h FROM customer),
headers AS (SELECT tenant_id, upload_id, source_file, c_custkey, h.position AS position, h.header AS header FROM exploded),
{_dictionary_sql()},
{_critical_sql()},
named AS (SELECT h.*, s.canonical AS canon FROM headers h
  LEFT JOIN (SELECT name, arg_min(canonical, dict_pos) AS canonical FROM synonyms GROUP BY name) s ON lower(trim(h.header)) = s.name),
users AS (SELECT *, CASE WHEN header IN ('Reference', 'OrderRef') THEN 'order_id' WHEN header = 'Gross' THEN 'total'
                         WHEN header = 'Buyer-ID' THEN 'customer_id' END AS user_name FROM named)
"""

_FILE = "tenant_id, upload_id, source_file"


def _ratios_sql() -> str:
    """The similarity of every header text that occurs to every critical field, compared in full with all its names."""
    texts = sorted({name.lower() for choices in HEADER_CHOICES for name in choices})
    rows = [
        f"('{text}', '{field}', {max(difflib.SequenceMatcher(None, name, text).ratio() for name in names)!r}::DOUBLE)"
        for text in texts for field, names in b.CRITICAL.items()
    ]
    return "ratios(text, field, ratio) AS (VALUES " + ", ".join(rows) + ")"


_BLOCKING = ", ".join(f"'{name}'" for name in b.BLOCKING)
_ANALYSIS = f""",
{_ratios_sql()},
alike AS (SELECT {_FILE}, field, header, position, ratio FROM headers JOIN ratios ON lower(header) = text WHERE ratio >= 0.60),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_FILE}, field ORDER BY ratio DESC, position) AS r FROM alike),
tops AS (SELECT {_FILE}, field, max(ratio) AS top, string_agg(header, '|' ORDER BY r) AS listed FROM ranked WHERE r <= 3 GROUP BY ALL),
exacts AS (SELECT {_FILE}, field, header AS matched_header FROM headers JOIN critical ON lower(trim(header)) = name
  QUALIFY row_number() OVER (PARTITION BY {_FILE}, field ORDER BY variant_pos, position DESC) = 1),
pairs AS (SELECT DISTINCT {_FILE}, field FROM headers, (SELECT DISTINCT field FROM critical)),
analysis AS (SELECT {_FILE}, field, matched_header,
    CASE WHEN matched_header IS NOT NULL THEN 'high' WHEN top >= 0.75 THEN 'medium' WHEN top IS NOT NULL THEN 'low' ELSE 'missing' END AS confidence,
    CASE WHEN matched_header IS NOT NULL THEN '' ELSE coalesce(listed, '') END AS suggestions
  FROM pairs LEFT JOIN exacts USING ({_FILE}, field) LEFT JOIN tops USING ({_FILE}, field))
"""


_FOUND = f"""
, found AS (SELECT {_FILE}, list_sort(list_distinct(list(canon) FILTER (WHERE canon IS NOT NULL))) AS f FROM named GROUP BY ALL),
req AS (SELECT {_FILE}, coalesce(f, []) AS f, [x FOR x IN ['customer_email','order_date','order_id','quantity','total','unit_price'] IF NOT list_contains(coalesce(f, []), x)] AS m FROM found)"""

_FEATURES = f"""
, canon_sets AS (SELECT {_FILE}, list(canon) FILTER (WHERE canon IS NOT NULL) AS cols FROM named GROUP BY ALL HAVING count(canon) > 0),
features(feature, tier, required) AS (VALUES ('repeat-behavior', 'Starter', ['order_id','customer_email','order_date']),
  ('basket-trends', 'Starter', ['order_id','product_name','customer_email']), ('customer-segments', 'Pro', ['total','quantity','customer_email','order_date']),
  ('clv-analysis', 'Pro', ['customer_email','order_date','total']), ('churn-prediction', 'Pro', ['customer_email','order_date','total']),
  ('advanced-forecasting', 'Pro', ['order_date','total']), ('ai-insights', 'Pro', ['order_date','total','customer_email'])),
avail AS (SELECT {_FILE}, feature, tier, list_has_all(cols, required) AS available FROM canon_sets, features)"""

_K = "tenant_id, upload_id, o_orderkey, l_partkey"
CLEAN_DUPLICATES = (
    f"""
, ids AS (SELECT *, trim(order_id) AS oid FROM numbered WHERE trim(order_id) <> ''),
dups AS (SELECT *, min(row_pos) OVER (PARTITION BY {_FILE}, oid) AS first_pos FROM ids)""",
    f"""
SELECT {_FILE}, row_pos + 2 AS "row", oid AS order_id, 'Duplicate Order ID ''' || oid || ''' — this row was skipped during cleaning' AS message,
  'warning' AS severity FROM dups WHERE row_pos <> first_pos""",
)
CLEAN_PROBLEMS = f"""
SELECT {_FILE}, row_pos + 2 AS "row", 'order_id' AS field, order_id AS value, 'Order Id is empty' AS error, 'error' AS severity FROM numbered WHERE trim(order_id) = ''
UNION ALL SELECT {_FILE}, row_pos + 2, 'product_name', product_name, 'Product Name is empty', 'warning' FROM numbered WHERE trim(product_name) IN ('', 'Unknown Product')"""


SQL = {
    "b2_critical_fields": _HEADERS + _ANALYSIS + f"SELECT {_FILE}, field, matched_header, confidence, suggestions FROM analysis",
    "b2_needs_mapping": _HEADERS + _ANALYSIS + f"""
SELECT {_FILE}, count(*) FILTER (WHERE field IN ({_BLOCKING}) AND confidence <> 'high') > 0 AS needs_mapping,
  count(*) FILTER (WHERE confidence = 'missing') AS missing_fields FROM analysis GROUP BY ALL""",
    "b5_literal_total": _HEADERS + f"""SELECT {_FILE}, position, header, canon AS canonical FROM named WHERE canon IN ('total', 'subtotal')
QUALIFY row_number() OVER (PARTITION BY {_FILE}, canon ORDER BY position) = 1""",
    "b1_header_match": _HEADERS + f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY {_FILE}, canon ORDER BY position) AS r FROM named)
SELECT {_FILE}, position, header, CASE WHEN r = 1 THEN canon END AS canonical,
  coalesce(CASE WHEN r = 1 THEN canon END, lower(trim(header))) AS column_name FROM ranked""",
    "b2_exact_critical": _HEADERS + f"""
SELECT {_FILE}, field, header AS matched_header FROM headers JOIN critical ON lower(trim(header)) = name
QUALIFY row_number() OVER (PARTITION BY {_FILE}, field ORDER BY variant_pos, position DESC) = 1""",
    "b3_resolved_mapping": _HEADERS + f"""
, extras(src, dst, ord) AS (VALUES ('order_quantity','quantity',0),('order_qty','quantity',1),('lineitem_quantity','quantity',2),
  ('product_price','unit_price',3),('item_price','unit_price',4),('price_per_item','unit_price',5),('order_price','unit_price',6)),
taken AS (SELECT {_FILE}, list(coalesce(user_name, header)) AS names FROM users GROUP BY ALL),
free AS (SELECT u.*, e.ord, CASE WHEN user_name IS NULL AND dst IS NOT NULL AND NOT list_contains(names, dst) THEN dst END AS target
         FROM users u JOIN taken USING ({_FILE}) LEFT JOIN extras e ON u.header = e.src),
renamed AS (SELECT *, CASE WHEN target IS NOT NULL AND row_number() OVER (PARTITION BY {_FILE}, target ORDER BY ord) = 1 THEN target END AS renamed FROM free),
final AS (SELECT *, coalesce(user_name, renamed, canon, lower(trim(header))) AS column_name FROM renamed),
again AS (SELECT *, row_number() OVER (PARTITION BY {_FILE}, column_name ORDER BY position) - 1 AS a FROM final)
SELECT {_FILE}, position, header, column_name,
  CASE WHEN user_name IS NOT NULL THEN 'user' WHEN renamed IS NOT NULL THEN 'rename' WHEN canon IS NOT NULL THEN 'synonym' ELSE 'none' END AS mapped_by,
  CASE WHEN a = 0 THEN column_name ELSE column_name || '_' || a END AS unique_name FROM again""",
    "b4_required_columns": _HEADERS + _FOUND + f"""
SELECT {_FILE}, array_to_string(f, ',') AS found_columns, array_to_string(m, ',') AS missing_columns FROM req""",
    "b4_upload_valid": _HEADERS + _FOUND + """
, ups AS (SELECT tenant_id, upload_id, list_distinct(flatten(list(f))) AS f FROM req GROUP BY ALL),
miss AS (SELECT tenant_id, upload_id, [x FOR x IN ['customer_email','order_date','order_id','quantity','total','unit_price'] IF NOT list_contains(f, x)] AS m FROM ups)
SELECT tenant_id, upload_id, array_to_string(m, ',') AS missing_columns, len(m) = 0 AS is_valid FROM miss""",
    "b6_unique_names": _HEADERS + f"""
, n2 AS (SELECT *, coalesce(canon, lower(trim(header))) AS nm FROM named),
again AS (SELECT *, row_number() OVER (PARTITION BY {_FILE}, nm ORDER BY position) - 1 AS a FROM n2)
SELECT {_FILE}, position, CASE WHEN a = 0 THEN nm ELSE nm || '_' || a END AS unique_name FROM again""",
    "b7_normalised_headers": _HEADERS + f"SELECT {_FILE}, position, regexp_replace(lower(trim(header)), '[ -]', '_', 'g') AS normalised FROM headers",
    "b8_location_header": _HEADERS + f"""
, n2 AS (SELECT *, regexp_replace(lower(trim(header)), '[ -]', '_', 'g') AS nm FROM headers),
r AS (SELECT *, CASE WHEN list_position(['customer_location','city','location','billing_city','shipping_city','billing_address','shipping_address'], nm) > 0
    THEN list_position(['customer_location','city','location','billing_city','shipping_city','billing_address','shipping_address'], nm)
    WHEN regexp_matches(nm, 'city|location|address|state|country|region') THEN 99 END AS pref FROM n2)
SELECT {_FILE}, arg_min(nm, pref * 1000 + position) FILTER (WHERE pref IS NOT NULL) AS location_header FROM r GROUP BY ALL""",
    "b9_customer_header": _HEADERS + f"""
SELECT {_FILE}, CASE WHEN bool_or(canon = 'customer_email') THEN 'customer_email' WHEN bool_or(canon = 'customer_id') THEN 'customer_id' END AS customer_key_column
FROM named GROUP BY ALL""",
    "b10_feature_availability": _HEADERS + _FEATURES + f"SELECT {_FILE}, feature, tier, available FROM avail",
    "b10_feature_summary": _HEADERS + _FEATURES + f"""
SELECT {_FILE}, count(*) FILTER (WHERE available) AS total_available, count(*) FILTER (WHERE available AND tier = 'Starter') AS starter_available,
  count(*) FILTER (WHERE available AND tier = 'Pro') AS pro_available FROM avail GROUP BY ALL""",
    "b11_saved_mapping": _HEADERS + """
SELECT tenant_id, user_name AS canonical, header FROM users WHERE user_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY tenant_id, user_name ORDER BY c_custkey DESC, header) = 1""",
    "c1_parsed_dates": RAW + f"SELECT {_K}, order_date FROM parsed",
    "c2_parsed_numbers": RAW + f"SELECT {_K}, quantity, unit_price, total, discount_amount, shipping, taxes FROM parsed",
    "c3_core_defaults": RAW + f"SELECT {_K}, abs(coalesce(quantity, 1.0)) AS quantity, abs(coalesce(unit_price, 0.0)) AS unit_price, abs(coalesce(total, 0.0)) AS total FROM parsed",
    "c4_booleans": RAW + f"SELECT {_K}, accepts_marketing FROM parsed",
    "c5_tidy_strings": RAW + f"SELECT {_K}, customer_email, product_name, financial_status, currency, order_id FROM parsed",
    "c6_valid_rows": RAW + f"SELECT {_K}, customer_email, order_id, product_name FROM valid",
    "c9_first_row_per_order": RAW + f"""
SELECT {_K}, order_id, product_name FROM valid QUALIFY row_number() OVER (PARTITION BY tenant_id, upload_id, order_id ORDER BY {_ROW_ORDER}) = 1""",
    "c10_drop_duplicates": RAW + "SELECT DISTINCT tenant_id, upload_id, customer_email, quantity, product_name FROM raw",
    "c12_clean_orders": RAW + f"""
SELECT tenant_id, upload_id, source_file, order_id, customer_email, order_date, abs(coalesce(quantity, 1.0)) AS quantity,
  abs(coalesce(unit_price, 0.0)) AS unit_price, abs(coalesce(total, 0.0)) AS total, coalesce(discount_amount, 0.0) AS discount_amount,
  coalesce(shipping, 0.0) AS shipping, coalesce(taxes, 0.0) AS taxes, accepts_marketing, currency, product_name, financial_status
FROM valid QUALIFY row_number() OVER (PARTITION BY tenant_id, upload_id, order_id ORDER BY {_ROW_ORDER}) = 1""",
    "c13_row_problems": RAW + CLEAN_PROBLEMS,
    "c14_duplicate_orders": RAW + "".join(CLEAN_DUPLICATES),
    "c16_safe_division": """
SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 5 = 0 OR l_partkey % 7 = 0 OR l_quantity = 0 THEN 0.0 ELSE l_extendedprice / l_quantity END AS ratio FROM lineitem""",
    "c17_sanitised": """
SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 11 = 0 OR l_partkey % 13 = 0 THEN 0.0 WHEN l_partkey % 17 <> 0 THEN l_extendedprice END AS amount,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS shipped FROM lineitem""",
    "c18_sales_feed": RAW + """
SELECT tenant_id, upload_id, order_id, customer_email AS customer_id, l_partkey AS product_id, TRY_CAST(regexp_replace(total, '[$,]', '', 'g') AS DOUBLE) AS price
FROM raw WHERE TRY_CAST(regexp_replace(total, '[$,]', '', 'g') AS DOUBLE) IS NOT NULL""",
    "c19_file_contract": _HEADERS + f"""
, seen AS (SELECT {_FILE}, list(replace(lower(trim(header)), ' ', '')) AS s FROM headers GROUP BY ALL),
miss AS (SELECT {_FILE}, [x FOR x IN ['order', 'email', 'total', 'created at'] IF NOT list_contains(s, replace(x, ' ', ''))] AS m FROM seen)
SELECT {_FILE}, array_to_string(m, ',') AS missing_columns, len(m) = 0 AS accepted FROM miss""",
    "j5_slugs": "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages",
}
