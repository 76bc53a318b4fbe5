"""Repeated and missing offsets of a stream, found as it runs, without reading what it wrote.

The state is keyed by (topic, partition, bucket of offsets), one bitmap of the offsets seen in each, so a hot
partition spreads over its buckets and a key's state is 4 KB however long the stream runs.  Every micro-batch gives, for the buckets it
touches, the offsets that were seen before (in an earlier batch or twice in this one) and the bitmap so far.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.offset_sets import SETS, SPAN, bucket, merged_sets, position
from tidemark.session import ship_package

AUDIT = "topic string, partition int, bucket bigint, repeats array<bigint>, bits binary"


def _seen(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    topic, partition, number = key
    bits = np.unpackbits(np.frombuffer(state.get[0], np.uint8), bitorder="little") if state.exists else np.zeros(SPAN, np.uint8)
    repeats: list[int] = []
    for some in rows:
        at = some["at"].to_numpy(np.int64)
        count = np.bincount(at, minlength=SPAN)
        again = count - (bits == 0)         # the first one of an offset is none
        again[count == 0] = 0
        found = np.flatnonzero(again)
        repeats += np.repeat(found + number * SPAN, again[found]).tolist()
        bits[count > 0] = 1
    packed = np.packbits(bits, bitorder="little").tobytes()
    state.update((packed,))
    yield pd.DataFrame({"topic": [topic], "partition": [partition], "bucket": [number], "repeats": [repeats], "bits": [packed]})


def offset_audit(stream_log: DataFrame) -> DataFrame:
    """A stream of ``AUDIT`` rows in update mode: the buckets that a micro-batch touched."""
    ship_package(stream_log.sparkSession)
    slim = stream_log.where(F.col("offset").isNotNull()).select("topic", "partition", bucket().alias("bucket"), position().cast("int").alias("at"))
    return slim.groupBy("topic", "partition", "bucket").applyInPandasWithState(_seen, AUDIT, "bits binary", "update", GroupStateTimeout.NoTimeout)


def run_audit(stream_log: DataFrame, path: str, trigger: dict | None = None, on_repeats: Callable[[DataFrame], None] | None = None) -> None:
    """Audit all that the stream has now; each micro-batch is one folder of ``path``, and the checkpoint beside them keeps the
    state for the next run.  ``on_repeats`` gets each micro-batch's repeats (topic, partition, offset)."""
    root = path.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{root}/audit/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)       # a batch that runs again replaces its first attempt
        if on_repeats is not None:
            on_repeats(repeats_of(batch.sparkSession.read.schema(batch.schema).parquet(folder)))

    query = (offset_audit(stream_log).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", f"{root}/_checkpoint").trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()


def repeats_of(audit: DataFrame) -> DataFrame:
    """(topic, partition, offset, repeats): how often an offset came again."""
    each = audit.select("topic", "partition", F.explode("repeats").alias("offset"))
    return each.groupBy("topic", "partition", "offset").agg(F.count(F.lit(1)).alias("repeats"))


def seen_sets(audit: DataFrame) -> DataFrame:
    """The offset sets seen so far, one row a bucket, for ``missing_ranges``."""
    return merged_sets(audit.withColumn("n", F.bitmap_count("bits")).select(*SETS.fieldNames()))
