"""Session defaults and the shared folder that holds intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Trial folders, one per local application; a cluster names its own folder.
_trial_folders: dict[str, str] = {}


def local_session(cores: str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("merchantry")
    settings = {**SESSION_DEFAULTS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": memory}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local session without the setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _trial_folders:
        _trial_folders[app] = tempfile.mkdtemp(prefix="merchantry-")
    return _trial_folders[app]


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# Sizes that a task should get of a compressed table or shuffle, whose rows take many times as much memory, by setting: (Spark's own, ours).
_FINER = {
    "spark.sql.files.maxPartitionBytes": ("134217728b", "16777216b"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "16777216b"),
}
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_TASK_BYTES = 4 << 20  # of a compressed table, for each shuffle partition to start with


def read_bytes(table: DataFrame) -> int:
    """The bytes of the files that a table is read from, as the optimizer knows them."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fit_partitions(table: DataFrame) -> DataFrame:
    """`table`, after the session's shuffles got a partition for every few megabytes of it, so that tasks don't grow with it.

    The number is raised, never lowered, and Spark joins the partitions that turn out small; sizes of a task's share are
    made smaller where the session has Spark's own.
    """
    conf = table.sparkSession.conf
    parts = -(-read_bytes(table) // _TASK_BYTES)
    if parts > int(conf.get(_INITIAL, None) or conf.get("spark.sql.shuffle.partitions")):
        conf.set(_INITIAL, str(parts))
    for key, (usual, finer) in _FINER.items():
        if conf.get(key, usual) == usual:
            conf.set(key, finer)
    return table


def in_few_tasks(df: DataFrame, n_bytes: int, task_bytes: int) -> DataFrame:
    """`df` in a task for every `task_bytes` of `n_bytes`, but one a core at least, where it has more.

    For small tables that are made again and again: without it each has as many tasks, and files, as the session's shuffles have partitions.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // task_bytes))
    return df.coalesce(min(tasks, 1 << 30))  # the optimizer's size may be a guess beyond all bounds


def store(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write `df` to the shared folder, with Parquet's `options`, and return the table read back.

    Cuts the lineage, survives lost executors, is computed once for all its
    readers, and gives the optimizer the true size: a stored table is broadcast
    only when it is below spark.sql.autoBroadcastJoinThreshold and is otherwise
    joined by shuffle, with skewed partitions split at run time.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.mode("overwrite").options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_packed(df: DataFrame, name: str) -> DataFrame:
    """`store` for large tables of orders and customers: a quarter less disk than Spark's own codec takes, for some more time."""
    return store(df, name, {"compression": "zstd"})
