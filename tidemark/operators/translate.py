"""Offset translation: where each consumer group continues after a restore.

Restored messages are re-numbered 0, 1, 2, ... in offset order, so a group
that committed ``c`` (next offset to read) continues at the number of
snapshot messages with ``offset < c`` in that partition: 0 when it read
nothing, the partition length when it read past the end.  Commits on
partitions without messages in the snapshot produce no row.

Plan (see ``buckets``): commits materialised once, distinct points only; per-bucket counts with
partial aggregation; a prefix sum over buckets and points; an exact running
count inside the buckets that hold a point.  No message is paired with more
than its own bucket, and no partition is sorted whole in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.buckets import DEFAULT_BUCKET_SPAN, bucket_counts, bucket_of
from tidemark.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, join_checked
from tidemark.schemas import COMMITS, require_columns
from tidemark.session import materialize

KEY = ["topic", "partition"]


def commit_points(commits: DataFrame, span: int) -> DataFrame:
    """Distinct (topic, partition, committed) with their bucket: many groups share one point."""
    return (commits.select("topic", "partition", "committed")
            .where(F.col("committed").isNotNull())
            .distinct()
            .withColumn("bucket", bucket_of("committed", span)))


def _before_bucket(counts: DataFrame, points: DataFrame) -> DataFrame:
    """Messages in buckets strictly before each point's bucket.

    Points (kind 0) sort ahead of the count row (kind 1) of their own bucket,
    so the running sum at a point covers earlier buckets only."""
    marks = (counts.select(*KEY, "bucket", F.lit(1).alias("kind"), "n",
                           F.lit(None).cast("long").alias("committed"))
             .unionByName(points.select(*KEY, "bucket", F.lit(0).alias("kind"),
                                        F.lit(0).cast("long").alias("n"), "committed")))
    ordered = Window.partitionBy(*KEY).orderBy("bucket", "kind")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (marks
            .withColumn("before", F.sum("n").over(running))
            .withColumn("has_messages", F.max("kind").over(whole))
            .where((F.col("kind") == 0) & (F.col("has_messages") == 1))
            .select(*KEY, "committed", "before"))


def _inside_bucket(log: DataFrame, points: DataFrame, span: int, max_broadcast_rows: int,
                   points_rows: int | None = None) -> DataFrame:
    """Messages of the point's own bucket with ``offset < committed``."""
    msgs = log.select(*KEY, "offset", bucket_of("offset", span).alias("bucket"))
    point_buckets = points.select(*KEY, "bucket").distinct()
    # distinct point buckets are at most as many as the points
    near = join_checked(msgs, point_buckets, [*KEY, "bucket"], "left_semi", max_broadcast_rows,
                        known_rows=points_rows)
    rows = (near.select(*KEY, "bucket", "offset", F.lit(1).alias("kind"),
                        F.lit(None).cast("long").alias("committed"))
            .unionByName(points.select(*KEY, "bucket", F.col("committed").alias("offset"),
                                       F.lit(0).alias("kind"), "committed")))
    # at equal offsets the point comes first: only offsets < committed count
    w = (Window.partitionBy(*KEY, "bucket").orderBy("offset", "kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumn("inside", F.sum("kind").over(w))
            .where(F.col("kind") == 0)
            .select(*KEY, "committed", "inside"))


def translate_offsets(log: DataFrame, commits: DataFrame, bucket_span: int = DEFAULT_BUCKET_SPAN,
                      max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """commits -> (consumer_group, topic, partition, committed, new_offset)."""
    require_columns(commits, COMMITS, "commits")
    # commits are at most groups x partitions rows: materialise them once in
    # the checkpoint folder instead of re-deriving them in every branch
    wanted, n_commits = materialize(commits.select("consumer_group", *KEY, "committed")
                                    .where(F.col("committed").isNotNull()))
    points = commit_points(wanted, bucket_span)
    counts = bucket_counts(log, bucket_span)
    before = _before_bucket(counts, points)
    inside = _inside_bucket(log, points, bucket_span, max_broadcast_rows, n_commits)
    translated = (before.join(inside, [*KEY, "committed"])
                  .select(*KEY, "committed", (F.col("before") + F.col("inside")).alias("new_offset")))
    return (wanted.join(translated, [*KEY, "committed"])
            .select("consumer_group", *KEY, "committed", "new_offset"))
