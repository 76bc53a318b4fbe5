"""Constraint checks of a snapshot: null keys, null commit topics, duplicate offsets."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import LOG

# policies for messages without a key
NULL_KEY_POLICIES = ("error", "keep")


def null_keys(log: DataFrame) -> DataFrame:
    """Messages whose key is null (a snapshot requires a key)."""
    return log.where(F.col("key").isNull()).select("topic", "partition", "offset")


def guard_null_keys(log: DataFrame, policy: str = "error") -> DataFrame:
    """Inline check: with ``error`` the job fails at the first null key, in the
    same pass that writes; with ``keep`` rows pass unchanged."""
    if policy not in NULL_KEY_POLICIES:
        raise ValueError(f"null_key must be one of {NULL_KEY_POLICIES}")
    if policy == "keep":
        return log
    message = F.format_string("null key in topic %s partition %d offset %d",
                              F.col("topic"), F.col("partition"), F.col("offset"))
    checked = F.when(F.col("key").isNull(), F.raise_error(message).cast("binary")).otherwise(F.col("key"))
    return log.withColumn("key", checked)


def null_topic_commits(commits: DataFrame) -> DataFrame:
    """Commits without a topic."""
    return commits.where(F.col("topic").isNull())


def duplicate_offsets(log: DataFrame) -> DataFrame:
    """(topic, partition, offset, copies) for offsets held more than once."""
    return (log.groupBy("topic", "partition", "offset")
            .agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def latest_per_offset(log: DataFrame) -> DataFrame:
    """One message per (topic, partition, offset): the last one wins.

    "Last" is the greatest (timestamp, key, value, headers), an explicit total
    order.  One exchange and one sort: the row that no other follows in its
    key's window (a rank with a limit would sort the payload twice)."""
    key = ["topic", "partition", "offset"]
    order = Window.partitionBy(*key).orderBy("timestamp", "key", "value", "headers")
    return log.withColumn("_follows", F.lead(F.lit(1)).over(order)).where(F.col("_follows").isNull()).select(*[f.name for f in LOG.fields])
