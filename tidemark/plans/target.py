"""The target of a restore as it really is: read back, it may hold messages twice and begin anywhere.

A task that is retried sends its messages again, from its first one on, so the target holds runs of repeats and its offsets are
not the positions that an empty target without retries would give.  Messages that carry their source offset
(``publish_frame(..., offset_header=OFFSET_HEADER)``) tell where each one went.  The last copy counts: what follows it in the target
is what follows it in the source, so a group that continues there misses nothing and sees nothing twice.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.headers import header_value
from tidemark.operators.buckets import DEFAULT_BUCKET_SPAN
from tidemark.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, join_checked
from tidemark.operators.positions import with_target_offsets
from tidemark.operators.translate import translate_offsets
from tidemark.plans.publish import OFFSET_HEADER
from tidemark.session import materialize

KEY = ["topic", "partition"]


def delivered(target: DataFrame, before: DataFrame | None = None, offset_header: str = OFFSET_HEADER,
              max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """(topic, partition, offset, target_offset, copies): each source offset in the target log, its last copy and their number.

    ``before`` (topic, partition, low, high) are the target's ends before the restore: what an earlier one left below them does not
    count.  One aggregation with partial sums; only the header and the place are read."""
    if before is not None:
        ends, n = materialize(before.select(*KEY, F.col("high").alias("_from")))
        target = join_checked(target, ends, KEY, "left", max_broadcast_rows, known_rows=n).where("_from IS NULL OR offset >= _from")
    source = header_value("headers", offset_header).cast("string").try_cast("bigint")
    rows = target.select(*KEY, source.alias("source"), F.col("offset").alias("at")).where("source IS NOT NULL")
    return (rows.groupBy(*KEY, F.col("source").alias("offset"))
            .agg(F.max("at").alias("target_offset"), F.count(F.lit(1)).alias("copies")))


def undelivered(messages: DataFrame, found: DataFrame) -> DataFrame:
    """(topic, partition, offset) of the messages that the target lacks."""
    return messages.select(*KEY, "offset").join(found.select(*KEY, "offset"), [*KEY, "offset"], "left_anti")


def translate_to_target(found: DataFrame, commits: DataFrame, target_ends: DataFrame, bucket_span: int = DEFAULT_BUCKET_SPAN) -> DataFrame:
    """commits -> (consumer_group, topic, partition, committed, new_offset) in the target's own offsets.

    A commit continues at the target offset of the first delivered message at or behind it (an as-of join, forward): the
    translation counts the delivered messages before it, and that number is the place of the one to continue at.  Past the last
    one it is the target's end."""
    log = found.select(*KEY, "offset")
    ranked = translate_offsets(log, commits, bucket_span).withColumnRenamed("new_offset", "place")
    # the bucketed ranking orders by offset, then key and value: the value carries the target offset along
    rows = found.select(*KEY, "offset", F.lit(None).cast("binary").alias("key"), F.col("target_offset").alias("value"))
    places = with_target_offsets(rows, bucket_span).select(*KEY, F.col("target_offset").alias("place"), F.col("value").alias("_at"))
    points, n = materialize(ranked.select(*KEY, "place").distinct())
    near = join_checked(places, points, [*KEY, "place"], "left_semi", known_rows=n)
    ends = target_ends.select(*KEY, F.col("high").alias("_end"))
    both = ranked.join(near, [*KEY, "place"], "left").join(ends, KEY, "left")
    return both.select("consumer_group", *KEY, "committed", F.coalesce("_at", "_end").alias("new_offset"))
