"""Stored tables per merchant and export, and which of them is current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantry.operators.order_statistics import OrderedGroups, top_rows

UPLOAD = ["tenant_id", "upload_id"]

# Exports that a filter names one by one; more are found by their merchants and a join.
NAMED_EXPORTS = 1_000

# Files of at most this many rows, so that a large merchant is written by many tasks.
ROWS_PER_FILE = 20_000_000


def save_snapshot(rows: DataFrame, path: str) -> None:
    """Write the rows of each export, replacing the export if it is there.

    Rebalancing by export keeps small exports in one file and splits large ones.
    """
    rows.hint("rebalance", *UPLOAD).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "maxRecordsPerFile", ROWS_PER_FILE
    ).partitionBy(*UPLOAD).parquet(path)


def append_snapshot(rows: DataFrame, path: str) -> None:
    """L2: add rows to the exports that are there.

    A Bloom filter on the order ids of every file lets a look-up of few ids pass over the files without them.
    """
    rows.hint("rebalance", *UPLOAD).write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).option(
        "parquet.bloom.filter.enabled#order_id", "true").partitionBy(*UPLOAD).parquet(path)


def of_exports(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """The stored rows of the exports in `touched` (tenant_id, upload_id, distinct), the only folders that are read.

    Up to NAMED_EXPORTS exports become a filter on the folders; beyond it their merchants do, up to as many, and a join does the rest.
    """
    found = touched.select(*UPLOAD).limit(NAMED_EXPORTS + 1).collect()
    if len(found) <= NAMED_EXPORTS:
        by_tenant: dict[str, list[str]] = {}
        for row in found:
            by_tenant.setdefault(row[0], []).append(row[1])
        wanted = F.lit(False)
        for tenant, uploads in by_tenant.items():
            wanted |= (F.col("tenant_id") == tenant) & F.col("upload_id").isin(uploads)
        return stored.where(wanted)
    tenants = [row[0] for row in touched.select("tenant_id").distinct().limit(NAMED_EXPORTS + 1).collect()]
    if len(tenants) <= NAMED_EXPORTS:
        stored = stored.where(F.col("tenant_id").isin(tenants))
    return stored.join(touched.select(*UPLOAD), UPLOAD, "left_semi")


def load_snapshot(
    spark: SparkSession, path: str, tenant: str | None = None, upload: str | None = None
) -> DataFrame:
    """Stored rows; filters on merchant and export prune folders."""
    # Export names such as 2001 stay text.
    inferred = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in UPLOAD else f.dataType) for f in inferred])
    rows = spark.read.schema(schema).parquet(path)
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    if upload is not None:
        rows = rows.where(F.col("upload_id") == upload)
    return rows


def current_uploads(uploads: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Each merchant's active export, else its newest.

    `uploads` holds `tenant_id`, `upload_id`, `generated_at`; `active` names the
    chosen export of some merchants. An active export that is not stored does not count.
    """
    marked = uploads.withColumn("_active", F.lit(False))
    if active is not None:
        chosen = active.select(*UPLOAD).distinct().withColumn("_chosen", F.lit(True))
        marked = uploads.join(chosen, UPLOAD, "left").withColumn("_active", F.coalesce("_chosen", F.lit(False)))
    best = top_rows(
        marked, ["tenant_id"], [F.desc("_active"), F.desc("generated_at"), F.desc("upload_id")], 1, "_rank"
    )
    return best.select(*UPLOAD, "generated_at", F.col("_active").alias("is_active"))


def current_rows(rows: DataFrame, current: DataFrame) -> DataFrame:
    """The stored rows of the current exports."""
    return rows.join(current.select(*UPLOAD), UPLOAD, "left_semi")


def upload_history(events: DataFrame, by: Sequence[str] = UPLOAD) -> DataFrame:
    """The latest status of every export with its row count.

    `events` holds one row per status change: processing, then complete or failed.
    `position` counts from each merchant's newest.
    """
    def latest(column: str) -> Column:
        return F.max_by(F.col(column), F.struct("event_time", "step")).alias(column)

    history = events.groupBy(*by).agg(
        F.min("event_time").alias("created_at"), latest("status"), latest("row_count"),
        F.count("*").alias("status_changes"),
    )
    newest = [F.desc("created_at"), F.desc("upload_id")]
    return OrderedGroups(history, ["tenant_id"], newest, "upload-history").ranked("position")
