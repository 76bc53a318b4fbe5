"""Restore positions: each message's offset in the restored (empty) topic.

Messages are published per partition in offset order, so the target offset
is the 0-based rank of the message in its partition.  Computed as the count
of messages in earlier buckets plus the rank inside the bucket; the only
window over messages is partitioned by (topic, partition, bucket), and the
join with the bucket bases reuses that window's shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.buckets import DEFAULT_BUCKET_SPAN, bucket_of


def with_target_offsets(log: DataFrame, bucket_span: int = DEFAULT_BUCKET_SPAN) -> DataFrame:
    """log -> log columns + ``target_offset`` (bigint)."""
    cols = log.columns
    # null topics and partitions are places of their own; the same plain keys serve the window and the join
    placed = log.withColumns({"_t": F.coalesce("topic", F.lit("")), "_tn": F.col("topic").isNull(),
                              "_p": F.coalesce("partition", F.lit(-1)), "_pn": F.col("partition").isNull(),
                              "bucket": bucket_of("offset", bucket_span)})
    place = ["_t", "_tn", "_p", "_pn"]
    counts = placed.groupBy(*place, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*place).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*place, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # key/value only break ties of duplicated offsets, which a valid log lacks
    in_bucket = Window.partitionBy(*place, "bucket").orderBy("offset", "key", "value")
    ranked = placed.withColumn("rank_in_bucket", F.row_number().over(in_bucket) - 1)
    # merged where the window's shuffle and sort left the messages: their payload is never broadcast, however small it looks
    return (ranked.join(bases.hint("merge"), [*place, "bucket"])
            .select(*cols, (F.col("base") + F.col("rank_in_bucket")).cast("long").alias("target_offset")))
