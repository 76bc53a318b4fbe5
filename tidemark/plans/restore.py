"""``restore_plan``: what a restore publishes and where each group continues."""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.buckets import DEFAULT_BUCKET_SPAN
from tidemark.operators.counts import partition_counts
from tidemark.operators.ends import end_offsets
from tidemark.operators.positions import with_target_offsets
from tidemark.operators.translate import translate_offsets
from tidemark.plans.backup import check_topics
from tidemark.plans.publish import DEFAULT_WAVE_MESSAGES, OFFSET_HEADER, TIMESTAMP_HEADER, publish_waves
from tidemark.plans.target import delivered, translate_to_target, undelivered
from tidemark.session import materialize
from tidemark.sources.snapshot import read_commits, read_ends, read_messages

# fixed value: mismatching partitions named in the error
NAMED_MISMATCHES = 20


class TargetMismatchError(RuntimeError):
    def __init__(self, rows: list):
        super().__init__("the target does not hold what was published: " + "; ".join(
            f"{r.topic}[{r.partition}] published {r.published}, target grew by {r.grown}" for r in rows))
        self.rows = rows


def restore_plan(spark: SparkSession, path: str, topics: Iterable[str] | None = None,
                 bucket_span: int = DEFAULT_BUCKET_SPAN, ignore_missing_topics: bool = False
                 ) -> tuple[DataFrame, DataFrame]:
    """(messages with ``target_offset``, commit plan) of a snapshot.

    Topics that the snapshot lacks raise unless ``ignore_missing_topics``.  The snapshot
    is scanned twice rather than cached: the translation needs only (topic, partition,
    offset), so its scan reads three columns."""
    wanted = check_topics(read_ends(spark, path), topics, ignore_missing_topics)
    messages, commits = read_messages(spark, path, wanted), read_commits(spark, path, wanted)
    if wanted == []:        # only missing topics were asked for
        messages, commits = messages.where(F.lit(False)), commits.where(F.lit(False))
    rows = with_target_offsets(messages, bucket_span)
    plan = translate_offsets(messages.select("topic", "partition", "offset"), commits, bucket_span)
    return rows, plan


def target_mismatches(published: DataFrame, target_ends: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(topic, partition, published, grown): partitions whose target grew by another number than was published.

    ``published`` is a log; ``target_ends`` bounds the target's partitions now and ``before``
    bounded them before the restore (default: empty)."""
    key = ["topic", "partition"]
    size = lambda ends, name: ends.select(*key, (F.col("high") - F.coalesce("low", F.lit(0))).alias(name))     # noqa: E731
    both = partition_counts(published).withColumnRenamed("messages", "published").join(size(target_ends, "now"), key, "full")
    both = both.join(size(before, "old"), key, "left") if before is not None else both.withColumn("old", F.lit(0))
    out = both.select(*key, F.coalesce("published", F.lit(0)).cast("long").alias("published"),
                      (F.coalesce("now", F.lit(0)) - F.coalesce("old", F.lit(0))).cast("long").alias("grown"))
    return out.where(F.col("published") != F.col("grown"))


class UndeliveredError(RuntimeError):
    def __init__(self, rows: list):
        super().__init__("the target lacks messages: " + ", ".join(f"{r.topic}[{r.partition}]@{r.offset}" for r in rows))
        self.rows = rows


def restore(spark: SparkSession, path: str, publish: Callable[[DataFrame], None],
            topics: Iterable[str] | None = None, bucket_span: int = DEFAULT_BUCKET_SPAN,
            timestamp_header: str | None = TIMESTAMP_HEADER, ignore_missing_topics: bool = False,
            wave_messages: int = DEFAULT_WAVE_MESSAGES, target_ends: Callable[[], DataFrame] | None = None,
            target_log: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Publish a snapshot, check the target, then return the commit plan.

    ``publish`` receives the publication frames in order, one for each wave of about
    ``wave_messages`` messages a partition, e.g. ``lambda f: write_kafka(f, servers)``.
    ``target_ends`` gives the ends of the target's partitions (topic, partition, low, high); it is
    asked before and after, and a partition that did not grow by its messages raises.

    With ``target_log`` (the target read back, LOG layout) the messages carry their source offset: each must have
    arrived, repeats of retried tasks are no fault, and the plan is in the target's true offsets, whatever
    it held before.  The plan (consumer_group, topic, partition, committed, new_offset) is returned only after all that."""
    wanted = check_topics(read_ends(spark, path), topics, ignore_missing_topics)
    messages = read_messages(spark, path, wanted)
    if wanted == []:
        messages = messages.where(F.lit(False))
    # one row a partition, as it was before anything is sent
    before = materialize(target_ends())[0] if target_ends else None
    carried = OFFSET_HEADER if target_log else None
    for frame in publish_waves(messages, timestamp_header, wave_messages, offset_header=carried):
        publish(frame)
    if target_log:
        target = target_log()
        found, _ = materialize(delivered(target, before))
        lost = undelivered(messages, found).limit(NAMED_MISMATCHES).collect()
        if lost:
            raise UndeliveredError(lost)
        return translate_to_target(found, read_commits(spark, path, wanted), end_offsets(target), bucket_span)
    if target_ends:
        wrong = target_mismatches(messages.select("topic", "partition"), target_ends(), before)
        rows = wrong.limit(NAMED_MISMATCHES).collect()
        if rows:
            raise TargetMismatchError(rows)
    _, plan = restore_plan(spark, path, topics, bucket_span, ignore_missing_topics)
    return plan
