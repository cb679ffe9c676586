"""Dated block and allow lists against dated captures: what was listed when a page was fetched.

Built-in expressions only. Entries become validity intervals; an as-of join looks up, for every
capture, the entry of each list and pattern that was in force at its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds of patterns, and what an entry can say.
KINDS = ("host", "domain", "prefix")


def url_host(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user, port and final dot; null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(F.lower(host), F.lit(".")), F.lit(""))


def url_path(url: Column) -> Column:
    """The path of an absolute URL without query and fragment; / where it is empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def patterns(host: Column, path: Column) -> Column:
    """All (kind, pattern) that a URL can be listed under: its host, the host and each domain above it, and the host
    with each folder of its path. Their number grows with the URL alone."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")),
    )
    folders = F.split(F.regexp_replace(path, "[^/]*$", ""), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(folders) - 1),
        lambda i: F.struct(
            F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(folders, F.lit(1), i), "/"), F.lit("/")).alias("pattern")),
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.concat(own, domains, prefixes)


def validity(entries: DataFrame) -> DataFrame:
    """(list, action, kind, pattern, valid_from, valid_to) from dated entries (list, action, kind, pattern, listed, at).

    An entry holds from `at` until the next entry of its list, kind and pattern; `listed` false
    ends it. Of several at one time the unlisting wins, and of several listings the action 'allow'.
    Runs of equal entries are one interval. valid_to is null while an entry still holds.
    Rows with a null in any of the six columns are left out; repeated rows change nothing.
    """
    whole = entries.select("list", "action", "kind", "pattern", "listed", "at").dropna()
    key = ["list", "kind", "pattern"]
    # One entry for each time first: what is left of a pattern is one row a change of its list.
    state = whole.groupBy(*key, "at").agg(F.min("listed").alias("listed"), F.min("action").alias("action"))
    order = Window.partitionBy(*key).orderBy("at")
    says = F.when(F.col("listed"), F.col("action"))
    changes = state.withColumn("says", says).withColumn("before", F.lag("says").over(order)).withColumn("n", F.row_number().over(order))
    changes = changes.where((F.col("n") == 1) | ~F.col("says").eqNullSafe(F.col("before")))
    ends = changes.withColumn("valid_to", F.lead("at").over(order))
    return ends.where("says is not null").select("list", F.col("says").alias("action"), "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, intervals: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """(key, host, at, n_active, lists, allowed, blocked) of every capture.

    Each entry in force at the capture's time on its host, a domain above it or a folder of
    its path is active. A capture is blocked when a block entry is active and no allow entry
    of a more special kind is (prefix before host before domain); of one kind, block wins.
    Captures with null or relative URLs or a null time have no active entries and aren't
    blocked. `key` is taken as unique; repeated rows count their entries together and have a
    row each. Other columns are ignored; an empty table on either side is fine.
    """
    seen = captures.select(F.col(key), F.col(at).alias("at"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    asked = seen.where("host is not null and at is not null").withColumn("p", F.explode(patterns(F.col("host"), F.col("path"))))
    asked = asked.select(key, "at", F.col("p.kind").alias("kind"), F.col("p.pattern").alias("pattern"))
    # Equal keys meet, then the time decides; Spark splits the partition of a hot host at run time.
    active = asked.join(intervals, ["kind", "pattern"]).where(
        (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    rank = F.when(F.col("kind") == "prefix", 3).when(F.col("kind") == "host", 2).otherwise(1)
    verdicts = active.distinct().groupBy(key).agg(
        F.count("*").alias("n_active"), F.array_sort(F.collect_set("list")).alias("lists"),
        F.max(F.when(F.col("action") == "block", rank)).alias("block"), F.max(F.when(F.col("action") == "allow", rank)).alias("allow"),
    )
    return seen.join(verdicts, key, "left").select(
        key, "host", F.col("at").alias(at), F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), F.col("allow").isNotNull().alias("allowed"),
        F.coalesce(F.col("block") >= F.coalesce("allow", F.lit(0)), F.lit(False)).alias("blocked"),
    )
