"""Connected components of a graph given as pairs of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.session import in_few_tasks, read_bytes, store

_TASK_BYTES = 1 << 20  # of stored links, for each task that writes a round's labels


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in `links` (a, b): the smallest id reachable.

    Each round takes the smallest label among an id's neighbours, then follows labels of labels;
    both sides are stored, so long chains of links shrink by halves and rounds don't
    recompute each other. Sums and minima combine on each task, so an id with very many
    links costs one row a task; the number of tasks that write follows the size of the graph. Null ids link nothing; repeated links
    and self-links are harmless.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a is not null and b is not null")
    edges = store(in_few_tasks(both.distinct(), 2 * read_bytes(links), _TASK_BYTES), "graph-links")
    n_bytes = read_bytes(edges)

    def stored(rows: DataFrame) -> DataFrame:
        return store(in_few_tasks(rows, n_bytes, _TASK_BYTES), "graph-labels")

    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select(
        "id", F.least("id", "least").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("label").alias("near"))
        lower = stored(labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("before")))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = stored(
            lower.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "before"))
        if not after.where("label <> before").limit(1).count():
            return after.select("id", F.col("label").alias("component_id"))
        labels = after.select("id", "label")
