"""Streams: new order files into the snapshot, and the daily revenue trend."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from merchantry.operators.cleaning import DATE_COLUMNS, clean_orders, date_evidence, date_readings, read_dates
from merchantry.session import store
from merchantry.sources.snapshots import UPLOAD, append_snapshot, load_snapshot, of_exports, save_snapshot


def order_feed(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", file_names: str = "*"
) -> DataFrame:
    """New files as they arrive in a folder."""
    return spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", file_names).load(folder)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot, or None before the first batch."""
    try:
        return load_snapshot(spark, path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def new_orders(clean: DataFrame, path: str) -> DataFrame:
    """Clean orders, stored, whose id the snapshot's export doesn't hold yet, however old they are.

    Only the ids are read, and only in the folders of the exports that the rows belong to.
    """
    stored = _stored(clean.sparkSession, path)
    if stored is None:
        return clean  # the first batch
    known = of_exports(stored, clean.select(*UPLOAD).distinct()).select(*UPLOAD, "order_id")
    return clean.join(known, [*UPLOAD, "order_id"], "left_anti")


def _text(column: str) -> str:
    return f"{column}_text"


class DateEvidence:
    """What the batches of an export have shown of the order of day and month, beside the snapshot.

    A batch's counts replace those that it wrote before, so a batch that is run again counts once.
    """

    def __init__(self, spark: SparkSession, path: str, feed: str):
        self.spark, self.path, self.feed = spark, f"{path.rstrip('/')}-dates", feed

    def add(self, rows: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """(readings of the batch's exports, exports whose reading the batch has turned)."""
        mine = f"{self.feed}-{batch}"
        found = store(date_evidence(rows, UPLOAD), "date-evidence")
        found.withColumn("part", F.lit(mine)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *UPLOAD, "part").parquet(self.path)
        schema = T.StructType([*found.schema.fields, T.StructField("part", T.StringType())])
        held = store(of_exports(self.spark.read.schema(schema).parquet(self.path), found.select(*UPLOAD)), "date-evidence")
        columns = [c for c in held.columns if c.endswith("_nulls")]
        after = store(date_readings(held, UPLOAD), "date-readings")
        before = date_readings(held.where(F.col("part") != mine).select(*UPLOAD, *columns), UPLOAD)
        readings = [c for c in after.columns if c not in UPLOAD]
        turned = after.join(before.select(*UPLOAD, *[F.col(c).alias(f"_{c}") for c in readings]), UPLOAD)
        changed = F.lit(False)
        for c in readings:
            changed |= F.col(c) != F.col(f"_{c}")
        return after, turned.where(changed).select(*after.columns)


def load_orders(feed: DataFrame, path: str, checkpoint: str, order: Sequence[Column]) -> StreamingQuery:
    """L2: every arriving batch of raw rows is cleaned as a file upload is and added to the snapshot.

    Of an order id that comes more than once in a batch, the first row by `order` stays; an
    id that the snapshot holds is not added again. So a batch that is delivered again, in part
    or whole, adds nothing twice, and the snapshot is plain Parquet that `save_snapshot` can
    replace exports in. How an export's dates are read follows from all its batches so far: the
    snapshot keeps the texts of date columns as `<column>_text`, and when a batch turns the
    reading, the export's stored dates are read again. So any cut of an export into batches gives the dates of one file.
    """
    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dates = [c for c in DATE_COLUMNS if c in batch.columns]
        rows = store(batch.withColumns({_text(c): F.col(c) for c in dates}), "arrived")
        readings = None
        if dates:
            readings, turned = DateEvidence(spark, path, hashlib.sha256(checkpoint.encode()).hexdigest()[:12]).add(rows, number)
            stored = _stored(spark, path)
            if stored is not None and not turned.isEmpty():
                again = of_exports(stored, turned).withColumns({c: F.col(_text(c)) for c in dates})
                # Stored first: the folders that are read are then replaced.
                save_snapshot(store(read_dates(again, turned, UPLOAD), "read-again"), path)
        clean = store(clean_orders(rows, order, UPLOAD, readings=readings), "clean-orders")
        append_snapshot(store(new_orders(clean, path), "new-orders"), path)

    return feed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def purchases(events: DataFrame) -> DataFrame:
    """Purchases with their local day."""
    return events.where(F.col("event_type") == "purchase").select(
        F.date_format("ts", "yyyy-MM-dd").alias("period"), "user_id", F.col("value").cast("decimal(18,4)").alias("total")
    )


def _per_user(events: DataFrame) -> DataFrame:
    """The part of the state that some events make: revenue and orders of each day and user."""
    return purchases(events).groupBy("period", "user_id").agg(F.sum("total").alias("revenue"), F.count("*").alias("orders"))


def _per_day(parts: DataFrame) -> DataFrame:
    users = parts.groupBy("period", "user_id").agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"))
    return users.groupBy("period").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("orders").alias("orders"), F.count("user_id").alias("customers"))


def daily_revenue(events: DataFrame) -> DataFrame:
    """L3: revenue, orders and distinct customers per local day; purchases without a user count to no customer."""
    return _per_day(_per_user(events))


def load_revenue(feed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """L3: the daily trend as far as it has come, exact however late or out of order events arrive.

    `path`/users holds every batch's revenue and orders by day and user, `path`/days the trend. A batch
    replaces its own part of each day that it touches, so one that is run again counts once; then those
    days alone are summed from their parts and replaced. Events that another checkpoint delivers
    are other events.
    """
    users, days = f"{path.rstrip('/')}/users", f"{path.rstrip('/')}/days"
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def replace(rows: DataFrame, folder: str, *by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = store(_per_user(batch).withColumn("part", F.lit(f"{name}-{number}")), "revenue-part")
        touched = [row.period for row in part.select("period").distinct().collect()]  # days of one batch
        if not touched:
            return
        replace(part, users, "period", "part")
        held = spark.read.schema(part.schema).parquet(users).where(F.col("period").isin(touched))
        replace(_per_day(held), days, "period")

    return feed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_trend(spark: SparkSession, path: str) -> DataFrame:
    """L3: (period, revenue, orders, customers) of all days that `load_revenue` has written."""
    return spark.read.schema("revenue double, orders long, customers long, period string").parquet(f"{path.rstrip('/')}/days").select(
        "period", "revenue", "orders", "customers")
