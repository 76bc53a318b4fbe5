"""Kafka as a log source (batch and streaming), where the connector is installed.

The Kafka source already has the LOG columns (plus ``timestampType``), so a
bounded read is a plain ``spark.read.format("kafka")`` with ``earliest`` as
start and the end snapshot as ``endingOffsets`` (exclusive, like our
``high``).  The option values are built here; reading needs the
``spark-sql-kafka`` package on the classpath.
"""
from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.headers import header_value, without_header
from tidemark.plans.publish import TIMESTAMP_HEADER
from tidemark.schemas import LOG, conform

FORMAT = "kafka"
# records of one micro-batch of a streaming read: a stopped run keeps its finished micro-batches
DEFAULT_MAX_OFFSETS_PER_TRIGGER = 50_000_000


class KafkaUnavailableError(RuntimeError):
    pass


def offsets_json(offsets: DataFrame, offset_col: str) -> str:
    """``{"topic": {"partition": offset}}`` for every row of ``offsets`` (one row per
    partition: the option value is built once, on the driver, as Spark requires)."""
    per_topic = offsets.groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("partition", F.col(offset_col).alias("o")))).alias("p"))
    rows = per_topic.select(
        "topic", F.to_json(F.map_from_entries(F.transform(
            "p", lambda e: F.struct(e["partition"].cast("string"), e["o"])))).alias("pj")).collect()
    return json.dumps({r.topic: json.loads(r.pj) for r in sorted(rows, key=lambda r: r.topic)},
                      separators=(",", ":"))


def read_options(bootstrap_servers: str | Iterable[str], topics: Iterable[str],
                 ending_offsets: str = "latest", **extra: str) -> dict[str, str]:
    servers = bootstrap_servers if isinstance(bootstrap_servers, str) else ",".join(bootstrap_servers)
    opts = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics),
            "startingOffsets": "earliest", "endingOffsets": ending_offsets, "includeHeaders": "true",
            "failOnDataLoss": "true"}
    opts.update(extra)
    return opts


def stream_options(bootstrap_servers: str | Iterable[str], topics: Iterable[str], **extra: str) -> dict[str, str]:
    opts = read_options(bootstrap_servers, topics, **{"maxOffsetsPerTrigger": str(DEFAULT_MAX_OFFSETS_PER_TRIGGER), **extra})
    opts.pop("endingOffsets")
    return opts


def _load(reader) -> DataFrame:
    try:
        return reader.load()
    except Exception as exc:  # the connector is a separate package
        if "kafka" in str(exc).lower() and "data source" in str(exc).lower():
            raise KafkaUnavailableError("the Kafka connector (spark-sql-kafka) is not on the classpath") from exc
        raise


def as_log(kafka_rows: DataFrame, timestamp_header: str | None = TIMESTAMP_HEADER) -> DataFrame:
    """Kafka source rows -> LOG (drops ``timestampType``).

    A message that a restore published carries its first timestamp in ``timestamp_header``: it
    becomes the timestamp again, and the header goes."""
    if timestamp_header:
        stamp = header_value("headers", timestamp_header).cast("string")
        kafka_rows = kafka_rows.withColumns({
            "timestamp": F.coalesce(F.timestamp_millis(stamp.try_cast("bigint")), F.col("timestamp")),
            "headers": without_header("headers", timestamp_header)})
    return conform(kafka_rows, LOG)


def read_kafka_log(spark: SparkSession, bootstrap_servers, topics: Iterable[str],
                   ends: DataFrame | None = None, **extra: str) -> DataFrame:
    """Bounded read of ``topics``: earliest up to ``ends`` (or the latest offsets)."""
    topics = list(topics)
    # specific ending offsets must name every partition, empty ones included (end = high)
    ending = offsets_json(ends.where(F.col("high").isNotNull()), "high") if ends is not None else "latest"
    reader = spark.read.format(FORMAT).options(**read_options(bootstrap_servers, topics, ending, **extra))
    return as_log(_load(reader))


def stream_kafka_log(spark: SparkSession, bootstrap_servers, topics: Iterable[str], **extra: str) -> DataFrame:
    """Streaming read for ``incremental_backup`` (``availableNow`` drains to the
    offsets current at start)."""
    reader = spark.readStream.format(FORMAT).options(**stream_options(bootstrap_servers, list(topics), **extra))
    return as_log(_load(reader))
