"""Offset sets: which offsets of a partition are held, as bitmaps in Spark's own bitmap format.

Kafka transactions and compaction leave gaps everywhere, so neither the largest offset nor a list of intervals
describes a partition well: with a gap behind every message the list is as long as the log.  A set is one row
for each ``SPAN`` consecutive offsets, (topic, partition, bucket, n, bits) with ``n`` held offsets and 4 KB of bits, or
null bits for a bucket that is held whole.  Sets are built by partial aggregation (at most one row a bucket and task is
shuffled), merged by OR, and tested bit by bit inside the join on the bucket, all in the JVM.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import join_checked
from tidemark.session import ship_package

# fixed value: bits of one bitmap of Spark's bitmap functions
SPAN = 32_768
SETS = T.StructType([
    T.StructField("topic", T.StringType(), True), T.StructField("partition", T.IntegerType(), True),
    T.StructField("bucket", T.LongType(), True), T.StructField("n", T.LongType(), True), T.StructField("bits", T.BinaryType(), True)])
# rows of sets that may be broadcast: 4 KB each, 64 MB in all
MAX_BROADCAST_SETS = 16_384


def bucket(offset: str = "offset") -> Column:
    """Number of the bucket that holds an offset (rounded down, exact for every bigint)."""
    return F.expr(f"(`{offset}` - pmod(`{offset}`, {SPAN})) div {SPAN}")


def position(offset: str = "offset") -> Column:
    """Place of an offset in its bucket."""
    return F.expr(f"pmod(`{offset}`, {SPAN})")


def _all_bits() -> Column:
    return F.unhex(F.repeat(F.lit("FF"), F.lit(SPAN // 8)))


def _compact(sets: DataFrame) -> DataFrame:
    n = F.bitmap_count("bits")
    return sets.select("topic", "partition", "bucket", n.alias("n"), F.when(n < SPAN, F.col("bits")).alias("bits"))


def offset_sets(log: DataFrame) -> DataFrame:
    """The sets of the offsets in ``log`` (topic, partition, offset)."""
    return _compact(log.where(F.col("offset").isNotNull()).groupBy("topic", "partition", bucket().alias("bucket"))
                    .agg(F.bitmap_construct_agg(position()).alias("bits")))


def merged_sets(sets: DataFrame) -> DataFrame:
    """Sets with several rows for a bucket (of several increments) as one row each."""
    whole = sets.withColumn("bits", F.coalesce("bits", _all_bits()))
    return _compact(whole.groupBy("topic", "partition", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))


def has_bit(bits: Column, at: Column) -> Column:
    """Whether a bit of a bitmap is set; null bits hold all."""
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return bits.isNull() | (F.call_function("getbit", byte, (at % 8).cast("int")) == 1)


def outside(log: DataFrame, sets: DataFrame, max_rows: int = MAX_BROADCAST_SETS) -> DataFrame:
    """Rows of ``log`` whose offset is not in ``sets`` (one row a bucket, ``merged_sets``).

    The sets are broadcast only if they are proven few; else both sides are dealt by (topic, partition, bucket), so a
    hot partition spreads over its buckets."""
    held = sets.select("topic", "partition", F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"), F.lit(True).alias("_known"))
    both = join_checked(log.withColumn("_bucket", bucket()), held, ["topic", "partition", "_bucket"], "left", max_rows)
    return both.where(F.col("_known").isNull() | ~has_bit(F.col("_bits"), position())).select(*log.columns)


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """(topic, partition, low, high) with ranges that overlap or meet joined (high exclusive); one window over the
    ranges of a partition, of which there is one for each increment."""
    by = Window.partitionBy("topic", "partition").orderBy("low", "high")
    before = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return (ranges.where("low < high").withColumn("_new", F.coalesce(F.col("low") > before, F.lit(True)).cast("long"))
            .withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("topic", "partition", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            .select("topic", "partition", "low", "high"))


def uncovered(expected: DataFrame, covered: DataFrame) -> DataFrame:
    """The parts of ``expected`` (one range a partition) that ``covered`` leaves."""
    lists = (merged_ranges(covered).groupBy("topic", "partition")
             .agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("c")))
    both = expected.join(lists, ["topic", "partition"], "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<low:bigint,high:bigint>>")))
    starts = F.concat(F.array(F.col("low")), F.transform("c", lambda r: F.greatest(r["high"], F.col("low"))))
    ends = F.concat(F.transform("c", lambda r: F.least(r["low"], F.col("high"))), F.array(F.col("high")))
    left = F.filter(F.arrays_zip(starts.alias("low"), ends.alias("high")), lambda r: r["low"] < r["high"])
    return both.select("topic", "partition", F.explode(left).alias("r")).select("topic", "partition", "r.low", "r.high")


def missing_ranges(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """(topic, partition, low, high): the maximal runs of offsets in the ranges ``asked`` (topic, partition, low, high;
    apart from each other) that ``sets`` (``merged_sets``) does not hold.

    Only buckets that meet an asked range are looked at.  Runs inside a bucket are final; a window joins only
    those that touch a bucket's edge, at most two a bucket."""
    ship_package(asked.sparkSession)
    first, last = F.expr(f"(low - pmod(low, {SPAN})) div {SPAN}"), F.expr(f"(high - 1 - pmod(high - 1, {SPAN})) div {SPAN}")
    each = asked.where("low < high").select("topic", "partition", "low", "high", F.explode(F.sequence(first, last)).alias("bucket"))
    clipped = each.select("topic", "partition", "bucket", F.greatest("low", F.col("bucket") * SPAN).alias("low"),
                          F.least("high", (F.col("bucket") + 1) * SPAN).alias("high"))
    both = clipped.join(sets.select("topic", "partition", "bucket", "n", "bits"), ["topic", "partition", "bucket"], "left")
    empty = both.where("n IS NULL").select("topic", "partition", "bucket", "low", "high")
    runs = both.where("bits IS NOT NULL").select("topic", "partition", "bucket", "low", "high", "bits").mapInArrow(
        _zero_runs, "topic string, partition int, bucket bigint, low bigint, high bigint").unionByName(empty)
    edge = (F.pmod("low", F.lit(SPAN)) == 0) | (F.pmod("high", F.lit(SPAN)) == 0)
    return runs.where(~edge).select("topic", "partition", "low", "high").unionByName(merged_ranges(runs.where(edge)))


def _zero_runs(batches):
    """Runs of offsets in [low, high) whose bit is not set, for each row."""
    for batch in batches:
        rows, low, high = [], [], []
        for i, (bucket_no, lo, hi, bits) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))):
            base = bucket_no * SPAN
            held = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[lo - base: hi - base]
            edges = np.flatnonzero(np.diff(np.concatenate([[1], held, [1]]).astype(np.int8)))
            rows += [i] * (len(edges) // 2)
            low.append(edges[0::2] + lo)
            high.append(edges[1::2] + lo)
        take = pa.array(rows, pa.int64())
        flat = [pa.array(np.concatenate(x).astype(np.int64)) if x else pa.array([], pa.int64()) for x in (low, high)]
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(3)], *flat], ["topic", "partition", "bucket", "low", "high"])
