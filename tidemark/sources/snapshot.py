"""Parquet snapshot reader (the inverse of ``tidemark.sinks.snapshot``).

Only complete increments are read: those with a state.  A folder without one is refused."""
from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.catalog import select_topics
from tidemark.schemas import COMMITS, LOG, conform
from tidemark.sinks.snapshot import (INCREMENT, commits_path, held_ends, held_rows, messages_path, pending_path, read_state,
                                     row_digest)

# fixed value: partitions named in the error
NAMED_PARTITIONS = 20


class IncompleteSnapshotError(ValueError):
    def __init__(self, path: str):
        super().__init__(f"{path} holds no complete snapshot")


def _increments(spark: SparkSession, path: str) -> list:
    """The complete increments, oldest first (a driver list: one short row for each write job since the last
    ``merge_increments``).  Two that were written at once are told apart by their names."""
    state = read_state(spark, path)
    rows = [] if state is None else state.where("own").select("increment", "seq", "has_commits", "has_pending", "takes").collect()
    if not rows:
        raise IncompleteSnapshotError(path)
    return sorted(rows, key=lambda r: (r.seq, r.increment))


def read_messages(spark: SparkSession, path: str, topics: Iterable[str] | None = None) -> DataFrame:
    """Snapshot messages in the LOG layout, optionally for some topics only.

    The schema is given, so partition values are never type-inferred (a topic
    named ``007`` stays a string), and the topic filter prunes folders."""
    names = [r.increment for r in _increments(spark, path)]
    df = spark.read.schema(T.StructType([*LOG.fields, INCREMENT])).parquet(messages_path(path))
    return conform(select_topics(df.where(F.col("increment").isin(names)), topics), LOG)


def read_partition(spark: SparkSession, path: str, topic: str, partition: int) -> DataFrame:
    """Messages of one (topic, partition), in offset order; both filters prune folders.

    The order is a range exchange on the offset, so a hot partition is sorted by many tasks."""
    df = read_messages(spark, path, [topic]).where(F.col("partition") == F.lit(int(partition)))
    return df.orderBy("offset")


def read_commits(spark: SparkSession, path: str, topics: Iterable[str] | None = None) -> DataFrame:
    """The commits of the last increment that captured any, restricted to the chosen topics when given."""
    last = [r.increment for r in _increments(spark, path) if r.has_commits][-1:]
    if not last:
        return spark.createDataFrame([], COMMITS)
    df = spark.read.schema(COMMITS).parquet(f"{commits_path(path)}/increment={last[0]}")
    return conform(select_topics(df, topics), COMMITS)


def read_ends(spark: SparkSession, path: str, topics: Iterable[str] | None = None) -> DataFrame:
    """Ends of what the snapshot holds, from its state (no message is read)."""
    _increments(spark, path)
    return select_topics(held_ends(spark, path), topics)


def read_counts(spark: SparkSession, path: str, topics: Iterable[str] | None = None) -> DataFrame:
    """(topic, partition, messages, offsets) of the snapshot, from its state: ``offsets`` are the sums of the increments' distinct ones."""
    _increments(spark, path)
    rows = select_topics(held_rows(spark, path), topics)
    return rows.groupBy("topic", "partition").agg(F.sum("messages").alias("messages"), F.sum("offsets").alias("offsets"))


def read_pending(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """Messages that a stream read beyond its end bound and no later run has taken, and the increments that hold them."""
    state = read_state(spark, path)
    rows = [] if state is None else state.where("own").select("increment", "has_pending", "takes").collect()
    taken = {t for r in rows for t in r.takes or []}
    names = sorted(r.increment for r in rows if r.has_pending and r.increment not in taken)
    if not names:
        return None, []
    df = spark.read.schema(T.StructType([*LOG.fields, INCREMENT])).parquet(pending_path(path))
    return conform(df.where(F.col("increment").isin(names)), LOG), names


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(run, batch, increment, seen, written, outcome, at): one row for each micro-batch of a streaming backup, then one with
    its outcome, in the order ``at``; from the state, those of merged increments included."""
    state = read_state(spark, path, replaced=True)
    if state is None:
        raise IncompleteSnapshotError(path)
    return state.where("own AND run IS NOT NULL").select("run", "batch", "increment", "seen", "written", "outcome", "at")


class UnreadableSnapshotError(ValueError):
    pass


class DamagedSnapshotError(ValueError):
    def __init__(self, path: str, rows: list):
        super().__init__(f"{path} is damaged: " + "; ".join(
            f"{r.topic}[{r.partition}] has {r.found} of {r.messages} messages" + ("" if r.found != r.messages else " with other content") for r in rows))
        self.rows = rows


def damaged_partitions(spark: SparkSession, path: str, topics: Iterable[str] | None = None) -> DataFrame:
    """(topic, partition, messages, found): partitions whose messages are not those that were written.

    One aggregation over the snapshot: the number of rows and an order-free hash of each partition, against the state's.
    A file that cannot be read at all fails the job with its name."""
    rows = select_topics(held_rows(spark, path), topics)
    told = rows.groupBy("topic", "partition").agg(F.sum("messages").alias("messages"), F.bit_xor("digest").alias("digest"))
    real = (read_messages(spark, path, topics).groupBy(F.col("topic").alias("_t"), F.col("partition").alias("_p"))
            .agg(F.count(F.lit(1)).alias("found"), F.bit_xor(row_digest()).alias("_digest")))
    both = told.join(real, F.col("topic").eqNullSafe(F.col("_t")) & F.col("partition").eqNullSafe(F.col("_p")), "full")
    wrong = ~(F.col("messages").eqNullSafe(F.col("found")) & F.col("digest").eqNullSafe(F.col("_digest")))
    return both.where(wrong).select(F.coalesce("topic", "_t").alias("topic"), F.coalesce("partition", "_p").alias("partition"),
                                    F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("found", F.lit(0)).alias("found"))


def verified_messages(spark: SparkSession, path: str, topics: Iterable[str] | None = None) -> DataFrame:
    """``read_messages`` after a check of every partition; raises ``DamagedSnapshotError`` with the partitions' names."""
    try:
        wrong = damaged_partitions(spark, path, topics).limit(NAMED_PARTITIONS).collect()
    except Exception as e:
        named = re.search(r"while reading file (\S+)", str(e))
        raise UnreadableSnapshotError(f"{path} cannot be read: {named[1] if named else e}") from e
    if wrong:
        raise DamagedSnapshotError(path, wrong)
    return read_messages(spark, path, topics)
