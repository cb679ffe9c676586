"""The customer table kept up batch by batch against a full rebuild."""

import datetime as dt
import random

from merchantry.operators.customer_state import update_customers
from merchantry.operators.customers import customer360
from merchantry.sources.snapshots import UPLOAD, load_snapshot

SCHEMA = """tenant_id string, upload_id string, order_id string, customer_id string, order_date timestamp_ntz, total decimal(18,4),
    quantity double, discount_amount decimal(18,4), refund_amount decimal(18,4), product_name string"""


def _rows(n, seed):
    rnd = random.Random(seed)
    return [
        (rnd.choice("tu"), rnd.choice("12"), str(i), rnd.choice([None, "", "a", "b", "c", "d"]),
         rnd.choice([None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(40 * 24), minutes=30 * rnd.randrange(2))]),
         rnd.randrange(900) / 4, float(rnd.randrange(5)), rnd.choice([0, 0, 5]) / 1, rnd.choice([0, 0, 3]) / 1, rnd.choice([None, "x", "y", "z"]))
        for i in range(n)
    ]


def _table(df):
    names = sorted(df.columns)
    return sorted((tuple(row[c] for c in names) for row in df.collect()), key=repr)


def test_batches_equal_a_full_rebuild(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = _rows(240, 3)
    done = []
    batches = [rows[:100], [r for r in rows[100:] if r[:2] == ("t", "1")], [r for r in rows[100:] if r[:2] != ("t", "1")]]
    for number, batch in enumerate(batches):
        from decimal import Decimal

        cents = [(*r[:5], Decimal(r[5]), r[6], Decimal(r[7]), Decimal(r[8]), r[9]) for r in batch]
        done += cents
        before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "state").glob("customers/*/*/*.parquet")}
        df = spark.createDataFrame(cents, SCHEMA)
        update_customers(df, path, f"b{number}")
        if number == 1:  # only the touched export is written
            after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "state").glob("customers/*/*/*.parquet")}
            changed = {p.split("customers/")[1].rsplit("/", 1)[0] for p in after if after[p] != before.get(p)}
            assert changed == {"tenant_id=t/upload_id=1"}
            update_customers(df, path, f"b{number}")  # a batch that is run again counts once
        assert _table(load_snapshot(spark, f"{path}/customers")) == _table(customer360(spark.createDataFrame(done, SCHEMA), UPLOAD))
    update_customers(spark.createDataFrame([], SCHEMA), path, "none")


def test_state_files_follow_their_exports_not_the_tasks(spark, tmp_path):
    from decimal import Decimal

    rows = [(*r[:5], Decimal(r[5]), r[6], Decimal(r[7]), Decimal(r[8]), r[9]) for r in _rows(400, 5)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        update_customers(spark.createDataFrame(rows, SCHEMA), str(tmp_path), "a")
    finally:
        spark.conf.unset(key)
    for name in ("totals", "days", "products"):
        for folder in tmp_path.glob(f"{name}/tenant_id=*/upload_id=*/part=a"):
            assert len(list(folder.glob("*.parquet"))) == 1
