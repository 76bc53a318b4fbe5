"""End offsets of a log: ``low`` and exclusive ``high`` per partition."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import ENDS, conform


def end_offsets(log: DataFrame) -> DataFrame:
    """(topic, partition, low, high) from the rows of a log.

    One partial aggregation over three narrow columns.  A table only shows
    rows that exist: an empty partition is absent and, after compaction,
    ``max + 1`` can lie below a broker's high watermark; pass ends in as a
    table when that matters."""
    agg = (log.groupBy("topic", "partition")
           .agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high")))
    return conform(agg, ENDS)


def usable_ends(ends: DataFrame) -> DataFrame:
    """Drop partitions with no end (``high`` null) or no messages (``low == high``)."""
    return ends.where(F.col("high").isNotNull() & (F.col("low").isNull() | (F.col("low") < F.col("high"))))


def last_offset(high: str = "high") -> Column:
    """Inclusive end: the offset of the last message before the cut."""
    return F.col(high) - F.lit(1)
