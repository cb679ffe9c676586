"""The session's sizes follow the tables, so that tasks stay as large as they are."""

import pytest

from merchantry import session
from merchantry.plans import shared, store_queries

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def conf(spark):
    keys = [INITIAL, SPLIT, "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {key: spark.conf.get(key, None) for key in keys}
    for key in keys:
        spark.conf.unset(key)
    yield spark.conf
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_shuffles_start_with_more_partitions_for_larger_tables(spark, conf, tmp_path, monkeypatch):
    spark.range(10_000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    session.fit_partitions(table)
    assert conf.get(INITIAL, None) is None  # a small table asks for no more than the session has
    monkeypatch.setattr(session, "_TASK_BYTES", 1_000)
    session.fit_partitions(table)
    most = int(conf.get(INITIAL))
    assert most == -(-session.read_bytes(table) // 1_000) > 8
    monkeypatch.setattr(session, "_TASK_BYTES", 2_000)
    session.fit_partitions(table)
    assert int(conf.get(INITIAL)) == most  # never lowered


def test_sizes_that_a_session_names_stay(spark, conf):
    conf.set(SPLIT, "1000000")
    session.fit_partitions(spark.range(10))
    assert conf.get(SPLIT) == "1000000"
    conf.unset(SPLIT)
    session.fit_partitions(spark.range(10))
    assert conf.get(SPLIT) == "16777216b"


def test_shared_tables_are_packed_whatever_the_session_names(spark):
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "snappy")
    try:
        for own in (shared.store, store_queries.store):
            files = own(spark.range(5), "packed").inputFiles()
            assert files and all(".zstd." in f for f in files)
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", before)
