"""Topic and partition catalogues, topic selection, requested-topic checks."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def topics(log: DataFrame) -> DataFrame:
    """Distinct topics of a log (one row per topic)."""
    return log.select("topic").distinct()


def partitions(log: DataFrame) -> DataFrame:
    """Distinct (topic, partition) pairs of a log."""
    return log.select("topic", "partition").distinct()


def select_topics(df: DataFrame, wanted: Iterable[str] | None) -> DataFrame:
    """Keep rows of the wanted topics; None or empty means all topics.

    On a snapshot written with ``partitionBy("topic", ...)`` this is a
    partition filter: the scan lists only the chosen topic folders."""
    names = sorted(set(wanted or []))
    if not names:
        return df
    return df.where(F.col("topic").isin(names))


def requested_frame(spark: SparkSession, requested: Iterable[str]) -> DataFrame:
    rows = [(t,) for t in dict.fromkeys(requested)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("topic", T.StringType(), True)]))


def requested_present(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested topics that exist in the log (semi join)."""
    return requested.join(existing.select("topic"), "topic", "left_semi")


def requested_missing(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested topics the log does not have (anti join)."""
    return requested.join(existing.select("topic"), "topic", "left_anti")
