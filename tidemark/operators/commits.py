"""Consumer-group commits: capture, grouping and counts."""
from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.groups import IGNORE_GROUP_PATTERN, is_ignored_group
from tidemark.operators.catalog import select_topics
from tidemark.schemas import COMMITS, conform

# fixed value: the "no committed offset" marker a group reports for a partition
NO_OFFSET = -1001


def union_commits(*frames: DataFrame) -> DataFrame:
    """Commits gathered from several tables, by column name."""
    if not frames:
        raise ValueError("no commit tables given")
    return reduce(lambda a, b: a.unionByName(b), [conform(f, COMMITS) for f in frames])


def consumer_groups(commits: DataFrame, ignore_pattern: str | None = IGNORE_GROUP_PATTERN) -> DataFrame:
    """(consumer_group, ignored): every group that has commits, and whether capture skips it."""
    groups = commits.select("consumer_group").distinct()
    ignored = is_ignored_group("consumer_group", ignore_pattern) if ignore_pattern else F.lit(False)
    return groups.select("consumer_group", F.coalesce(ignored, F.lit(False)).alias("ignored"))


def capture_commits(commits: DataFrame, partitions: DataFrame, topics: Iterable[str] | None = None,
                    ignore_pattern: str | None = IGNORE_GROUP_PATTERN) -> DataFrame:
    """Commits of kept groups on the given partitions.

    Every kept group is asked for every partition of the chosen topics and
    partitions without a commit give nothing: that is a semi join of the
    commits on the partition list, never a groups x partitions product."""
    c = conform(commits, COMMITS)
    c = c.where(F.col("committed").isNotNull() & (F.col("committed") != F.lit(NO_OFFSET)))
    if ignore_pattern:
        c = c.where(~is_ignored_group("consumer_group", ignore_pattern))
    c = select_topics(c, topics)
    kept = c.join(select_topics(partitions.select("topic", "partition"), topics), ["topic", "partition"], "left_semi")
    return kept.select(*c.columns)


def group_commits(commits: DataFrame, offset_col: str = "committed") -> DataFrame:
    """(consumer_group, offsets): the group's (topic, partition, offset) list, sorted.

    A group's list is bounded by the number of partitions, not by data size."""
    entry = F.struct("topic", "partition", F.col(offset_col).alias("offset"))
    return commits.groupBy("consumer_group").agg(F.sort_array(F.collect_list(entry)).alias("offsets"))


def commit_counts(commits: DataFrame) -> DataFrame:
    """(consumer_group, commits)."""
    return commits.groupBy("consumer_group").agg(F.count(F.lit(1)).alias("commits"))
