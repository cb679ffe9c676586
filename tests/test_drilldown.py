"""Action state from logs of clicks, and what the shared tables store."""

import glob
import os

from pyspark.sql import functions as F

from merchantry.operators.drilldown import apply_action_state
from merchantry.plans import shared, store_queries
from merchantry.sources import files

FOLDER = "/root/testdata/sf0.001"
LOG = "tenant_id string, action_key string, is_done boolean, snoozed boolean, snooze_upload_id string, updated_at string"


def test_the_latest_entry_counts_without_sorting_the_log(spark):
    groups = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c"), ("t", None)], "tenant_id string, action_key string")
    log = spark.createDataFrame([
        ("t", "a", True, False, None, "2"), ("t", "a", False, True, "", "1"), ("t", "a", False, False, None, None),
        ("t", "b", True, False, None, "1"), ("t", "b", False, True, "now", "1"), ("t", "b", True, None, "x", "1"),
        ("t", "c", False, True, "now", "5"), ("t", "c", True, False, None, "4"), ("t", None, True, False, None, "9"),
    ], LOG)
    out = apply_action_state(groups, log, F.lit("now"))
    assert sorted((r.action_key or "", r.is_done) for r in out.collect()) == [("", False), ("a", True), ("b", True)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_made_where_they_are_read(spark, monkeypatch):
    stored = {}
    real = shared.store
    monkeypatch.setattr(shared, "store", lambda df, name: stored.setdefault(name, df) is None or real(df, name))
    shared.reset()
    acted = shared.acted_customers(spark, FOLDER)
    assert not {"summary", "supporting_behaviour"} & set(stored["best-actions"].columns) and "acted-customers" not in stored
    assert acted.columns[:3] == ["tenant_id", "upload_id", "customer_key"]
    assert acted.where("action_reason like 'This customer has spent%' or action_reason like '%has spent%'").count() > 0


def test_raw_rows_are_made_once_for_all_layouts(spark, monkeypatch):
    calls = []
    real = store_queries.store
    monkeypatch.setattr(store_queries, "store", lambda df, name: calls.append(name) or real(df, name))
    store_queries._mixed_folder(spark, FOLDER)
    assert calls == ["raw-orders"]


def test_files_of_mixed_layouts_are_packed_and_read_whole(spark, monkeypatch):
    texts = [c for c in dict.fromkeys([*store_queries.LAYOUTS[0], *store_queries._ORDER_TEXT]) if c not in ("upload_id", "product_name")]
    rows = spark.range(6_000).select(
        *[F.concat(F.lit(f"{c} "), F.col("id") % 50).alias(c) for c in texts], (F.col("id") % 7 + 1990).cast("string").alias("upload_id"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit('é "two\nlines" '), "id")).alias("product_name"),
    )
    monkeypatch.setattr(store_queries, "raw_orders", lambda s, f: rows)
    folder = store_queries._mixed_folder(spark, "none")
    text = sum(len(row.value.encode()) + 1 for row in spark.read.text(folder).collect())
    assert sum(os.path.getsize(path) for path in glob.glob(f"{folder}/part-*")) < text / 4
    read = files.read_exports(spark, folder)
    name = F.coalesce(*[F.col(f"`{layout['product_name']}`") for layout in store_queries.LAYOUTS])
    for mine, theirs in (("upload_id", F.col("`raw upload_id`")), ("product_name", name), ("l_suppkey", F.col("`raw l_suppkey`"))):
        assert sorted(str(row[0]) for row in read.select(theirs).collect()) == sorted(str(row[0]) for row in rows.select(mine).collect())


def test_splits_grow_with_the_files():
    assert store_queries.small_split(1_000) == store_queries.SMALLEST_SPLIT
    size = 20 << 30
    assert -(-size // store_queries.small_split(size)) <= store_queries.MOST_SPLITS
