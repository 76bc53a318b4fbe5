"""Counts: messages per partition, commits per group, totals."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_counts(log: DataFrame) -> DataFrame:
    """(topic, partition, messages)."""
    return log.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("messages"))


def totals(log: DataFrame, commits: DataFrame) -> DataFrame:
    """(metric, value) rows: partitions, messages, commits, groups.

    One partial aggregation per input, unpivoted with ``stack``; the two
    results are stacked, not joined."""
    log_figures = partition_counts(log).agg(
        F.count(F.lit(1)).alias("partitions"),
        F.coalesce(F.sum("messages"), F.lit(0)).cast("long").alias("messages"))
    commit_figures = commits.agg(
        F.count(F.lit(1)).alias("commits"),
        F.count_distinct("consumer_group").cast("long").alias("groups"))
    unpivot = "stack(2, '{0}', {0}, '{1}', {1}) as (metric, value)"
    return (log_figures.selectExpr(unpivot.format("partitions", "messages"))
            .unionByName(commit_figures.selectExpr(unpivot.format("commits", "groups"))))
