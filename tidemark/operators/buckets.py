"""Offset buckets: the unit that keeps per-partition order work bounded.

A Kafka partition can hold a third of all rows, so no operator sorts a whole
partition in one task.  Offsets are cut into buckets of ``span`` consecutive
offset values; a bucket holds at most ``span`` messages (offsets are unique
per partition).  Work that needs order inside a partition is split into
(1) a count per bucket, which partial aggregation shrinks map-side, (2) a
prefix sum over those counts, a window over at most ``range / span`` rows
per partition, and (3) an exact step inside single buckets only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 65,536 offsets a bucket: the in-bucket windows stay a few MB, and a
# 10^10-offset partition still has only ~150k buckets to prefix-sum
DEFAULT_BUCKET_SPAN = 1 << 16


def bucket_of(col: str, span: int) -> Column:
    """Monotone bucket number of an offset column (integer division, exact for bigint)."""
    if span < 1:
        raise ValueError("bucket span must be positive")
    return F.expr(f"`{col}` div {int(span)}")


def bucket_counts(log: DataFrame, span: int) -> DataFrame:
    """(topic, partition, bucket, n): messages per offset bucket."""
    return (log.select("topic", "partition", bucket_of("offset", span).alias("bucket"))
            .groupBy("topic", "partition", "bucket")
            .agg(F.count(F.lit(1)).alias("n")))
