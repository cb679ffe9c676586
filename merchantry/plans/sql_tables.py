"""Common table expressions that give the check SQL the same input tables."""

# All order heads with their customers.
HEADS = """
heads AS (
  SELECT o_orderkey, c_mktsegment AS tenant_id, strftime(o_orderdate, '%Y') AS upload_id,
         CAST(o_orderkey AS VARCHAR) AS order_id, CAST(c_custkey AS VARCHAR) AS customer_id,
         c_custkey, c_name AS customer_name, n_name AS customer_location,
         o_orderdate AS order_date, o_orderstatus AS financial_status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

# Line grain, with product columns.
LINES = HEADS + """,
priced AS (
  SELECT h.*, l.*, p_name AS product_name, p_type AS category, p_retailprice AS unit_price,
         CAST(p_partkey AS VARCHAR) AS product_id, l_quantity AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price2, CAST(l_discount AS DECIMAL(4,2)) AS disc2,
         CASE c_custkey % 4 WHEN 0 THEN l_discount >= 0.02 WHEN 1 THEN FALSE ELSE l_discount >= 0.05 END AS promoted
  FROM lineitem l JOIN heads h ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
lines AS (
  SELECT tenant_id, upload_id, order_id, customer_id, customer_name, customer_location, order_date,
         financial_status, product_id, product_name, category, unit_price, quantity,
         CAST(price2 AS DECIMAL(18,4)) AS subtotal,
         CAST(price2 * (1 - disc2) AS DECIMAL(18,4)) AS total,
         CASE WHEN promoted THEN CAST(price2 * disc2 AS DECIMAL(18,4)) ELSE 0 END AS discount_amount,
         CASE WHEN l_returnflag = 'R' THEN CAST(price2 * (1 - disc2) AS DECIMAL(18,4)) ELSE 0 END AS refund_amount,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice, l_shipdate, l_quantity) AS line_rank
  FROM priced
)"""

# Order grain: the first line of each order.
ORDERS = LINES + """,
sales AS (SELECT * EXCLUDE (line_rank) FROM lines WHERE line_rank = 1)"""


def with_lines(body: str) -> str:
    return f"WITH {LINES}\n{body}"


def with_orders(body: str) -> str:
    return f"WITH {ORDERS}\n{body}"
