"""Publication frames and the commit plan.

``publish_frame`` turns restore rows into the Kafka sink's columns, clustered
by (topic, partition) and sorted by offset, ready for
``df.write.format("kafka")``.  Ordered publication into one Kafka partition
is sequential by nature (one producer appends in order), so each
(topic, partition) is one task here; ``publish_waves`` bounds what that task
holds, and the sort spills like any Spark sort.
The built-in sink has no timestamp column: the source timestamp travels as
a header unless ``timestamp_header`` is None.

``starting_offsets`` renders a commit plan as the per-group JSON that a
Spark Kafka reader takes as ``startingOffsets``.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.headers import without_header
from tidemark.functions.time import epoch_millis
from tidemark.operators.buckets import DEFAULT_BUCKET_SPAN, bucket_counts
from tidemark.operators.joins import join_checked
from tidemark.schemas import HEADERS
from tidemark.session import materialize

# fixed value: header that carries the source timestamp (epoch ms as text)
TIMESTAMP_HEADER = "source-timestamp-ms"

SINK_COLUMNS = ["topic", "partition", "key", "value", "headers"]

# fixed value: header that carries the source offset, for targets that are read back
OFFSET_HEADER = "source-offset"

# messages of one partition that one task publishes; a wave after wave keeps the order
DEFAULT_WAVE_MESSAGES = 5_000_000


def publish_frame(restore_rows: DataFrame, timestamp_header: str | None = TIMESTAMP_HEADER,
                  num_partitions: int | None = None, keep_offset: bool = False, offset_header: str | None = None) -> DataFrame:
    """Restore rows -> (topic, partition, key, value, headers) in publication order.

    A timestamp header that a message has from an earlier restore is replaced, not doubled.
    ``keep_offset`` also keeps the source offset (to check the order); ``offset_header`` sends it along, so that the
    target can be read back by it."""
    headers = F.col("headers")
    if timestamp_header:
        stamp = F.struct(F.lit(timestamp_header).alias("key"),
                         epoch_millis("timestamp").cast("string").cast("binary").alias("value"))
        plain = F.coalesce(without_header(headers, timestamp_header), F.array().cast(HEADERS))
        headers = F.when(F.col("timestamp").isNull(), headers).otherwise(F.concat(plain, F.array(stamp)))
    if offset_header:
        place = F.struct(F.lit(offset_header).alias("key"), F.col("offset").cast("string").cast("binary").alias("value"))
        headers = F.concat(F.coalesce(without_header(headers, offset_header), F.array().cast(HEADERS)), F.array(place))
    framed = restore_rows.select("topic", "partition", "offset", "key", "value", headers.alias("headers"))
    clustered = (framed.repartition(num_partitions, "topic", "partition") if num_partitions
                 else framed.repartition("topic", "partition"))
    ordered = clustered.sortWithinPartitions("topic", "partition", "offset")
    return ordered.select(*SINK_COLUMNS, "offset") if keep_offset else ordered.select(*SINK_COLUMNS)


def wave_plan(messages: DataFrame, wave_messages: int = DEFAULT_WAVE_MESSAGES) -> DataFrame:
    """(topic, partition, wave, low, high, messages): offset ranges of about ``wave_messages`` messages, in order.

    Messages are counted in buckets of offsets (partial aggregation, one narrow column), and a prefix sum over
    a partition's buckets cuts it where the messages are, however far apart their offsets lie.  A range holds whole buckets, so at most
    one bucket's messages more than asked; a partition of n messages has n / wave_messages ranges or fewer, plus one."""
    if wave_messages < 1:
        raise ValueError("wave_messages must be positive")
    span = min(DEFAULT_BUCKET_SPAN, wave_messages)
    before = Window.partitionBy("topic", "partition").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucket_counts(messages, span).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (placed.groupBy("topic", "partition", F.expr(f"start div {wave_messages}").alias("wave"))
            .agg((F.min("bucket") * span).alias("low"), ((F.max("bucket") + 1) * span).alias("high"), F.sum("n").alias("messages")))


def publish_waves(messages: DataFrame, timestamp_header: str | None = TIMESTAMP_HEADER,
                  wave_messages: int = DEFAULT_WAVE_MESSAGES, **options) -> Iterator[DataFrame]:
    """``publish_frame`` of one range of every partition after another.

    A partition is published in order, so by one task at a time; a wave bounds that task to about
    ``wave_messages`` messages.  The number of waves is that of the largest partition.  Every message is in exactly one wave; the
    ranges of a wave are joined by checked broadcast, and their bounds are a pushed-down filter on the snapshot's sorted files."""
    plan, _ = materialize(wave_plan(messages.select("topic", "partition", "offset"), wave_messages))
    waves = plan.groupBy("wave").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("wave").collect()
    for w in waves:     # three numbers a wave
        ranges = plan.where(F.col("wave") == w.wave).select("topic", "partition", F.col("low").alias("_low"), F.col("high").alias("_high"))
        near = messages.where((F.col("offset") >= w.low) & (F.col("offset") < w.high))
        wave = join_checked(near, ranges, ["topic", "partition"], known_rows=w.n).where("offset >= _low AND offset < _high")
        yield publish_frame(wave.select(*messages.columns), timestamp_header, **options)


def delivery_report(restore_rows: DataFrame) -> DataFrame:
    """The messages as the target topic will hold them: each at its target
    offset, headers left out (what a producer's acknowledgements report)."""
    return restore_rows.select("topic", "partition", F.col("target_offset").alias("offset"),
                               "key", "value", "timestamp")


def commit_triples(plan: DataFrame) -> DataFrame:
    """Commit plan -> (consumer_group, topic, partition, offset) to commit per group."""
    return plan.select("consumer_group", "topic", "partition", F.col("new_offset").alias("offset"))


def starting_offsets(plan: DataFrame, offset_col: str = "new_offset") -> DataFrame:
    """(consumer_group, starting_offsets): ``{"topic": {"partition": offset}}`` JSON,
    topics and partitions in ascending order.  Sorted before nesting: maps
    cannot be sorted once inside an array."""
    per_topic = plan.groupBy("consumer_group", "topic").agg(
        F.sort_array(F.collect_list(F.struct("partition", F.col(offset_col).alias("offset")))).alias("p"))
    per_topic = per_topic.select(
        "consumer_group", "topic",
        F.to_json(F.map_from_entries(F.transform(
            "p", lambda e: F.struct(e["partition"].cast("string"), e["offset"])))).alias("pj"))
    per_group = per_topic.groupBy("consumer_group").agg(
        F.sort_array(F.collect_list(F.struct("topic", "pj"))).alias("t"))
    nested = F.map_from_entries(F.transform(
        "t", lambda e: F.struct(e["topic"], F.from_json(e["pj"], "map<string,bigint>"))))
    return per_group.select("consumer_group", F.to_json(nested).alias("starting_offsets"))
