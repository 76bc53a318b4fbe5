"""Reports on a written snapshot."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.catalog import select_topics
from tidemark.operators.cut import DONE, KEY, REMAINING, consumption_complete, consumption_report
from tidemark.operators.offset_sets import missing_ranges, uncovered
from tidemark.session import materialize
from tidemark.sinks.snapshot import covered_ranges, held_sets
from tidemark.sources.snapshot import read_ends


def _inner_ranges(spark: SparkSession, path: str, ends: DataFrame, topics: list[str]) -> tuple[DataFrame, DataFrame]:
    """The snapshot's ends, and for each partition the range from its first offset to its last held one below the end."""
    held = read_ends(spark, path, topics)
    wanted = select_topics(ends, topics).select(*KEY, F.col("low").alias("_low"), F.col("high").alias("_high"))
    inner = held.join(wanted, KEY).select(*KEY, F.least("low", F.coalesce("_low", "low")).alias("low"),
                                          F.least("high", "_high").alias("high")).where("low < high")
    return held, inner


def snapshot_missing(spark: SparkSession, path: str, ends: DataFrame, topics: Iterable[str] | None = None) -> DataFrame:
    """(topic, partition, low, high): ranges below ``ends`` and the last offset held in which the snapshot may lack messages.

    An offset counts as there if it is held, or if an increment is known to have left nothing out around it (a batch
    backup below its ends, a stream that ran to its end), as logs have gaps of their own.  No message is read: ranges come from the state,
    and where they leave something open, from the offset sets."""
    _, inner = _inner_ranges(spark, path, ends, list(topics or []))
    return _missing(spark, path, inner)


def _missing(spark: SparkSession, path: str, inner: DataFrame) -> DataFrame:
    nothing = spark.createDataFrame([], "topic string, partition int, low bigint, high bigint")
    open_ranges, n = materialize(uncovered(inner, covered_ranges(spark, path)))
    return materialize(missing_ranges(open_ranges, held_sets(spark, path)))[0] if n else nothing


def snapshot_report(spark: SparkSession, path: str, ends: DataFrame, topics: Iterable[str] | None = None
                    ) -> DataFrame:
    """Consumption report of a snapshot against ``ends`` (e.g. the log's current ends), for the chosen topics.

    ``remaining`` counts the offsets behind the last one held and those that ``snapshot_missing`` names
    before it; a partition with any is not done.  No message is read."""
    wanted = list(topics or [])
    held, inner = _inner_ranges(spark, path, ends, wanted)
    last = held.select(*KEY, (F.col("high") - 1).alias("offset"))
    holes = _missing(spark, path, inner).groupBy(*KEY).agg(F.sum(F.col("high") - F.col("low")).alias("_holes"))
    report = consumption_report(select_topics(ends, wanted), last).join(holes, KEY, "left")
    return report.select(*KEY, "low", "high", "last_read",
                         F.when((F.col("status") == DONE) & F.col("_holes").isNotNull(), F.lit(REMAINING)).otherwise(F.col("status")).alias("status"),
                         (F.col("remaining") + F.coalesce("_holes", F.lit(0))).alias("remaining"))


def snapshot_complete(spark: SparkSession, path: str, ends: DataFrame, topics: Iterable[str] | None = None
                      ) -> DataFrame:
    return consumption_complete(snapshot_report(spark, path, ends, topics))
