"""Parquet snapshot writer: one layout for batch and streaming backups.

Layout of a snapshot folder::

    <path>/messages/increment=<i>/topic=<t>/partition=<p>/part-*.parquet   offset, key, value, timestamp, headers, digest
    <path>/offsets/increment=<i>/part-*.parquet                            the offsets held, as bitmaps, and sums of each bucket
    <path>/commits/increment=<i>/part-*.parquet                            consumer_group, topic, partition, committed
    <path>/pending/increment=<i>/topic=<t>/partition=<p>/part-*.parquet    messages a stream read beyond its end bound
    <path>/state/increment=<i>/part-*.parquet                              one row for the increment, one for each partition

An increment is written in this order: messages, offsets, commits, state.  Readers look at
the state first and see complete increments only, so a job that dies half-way leaves
nothing visible, and writing the same increment again replaces what it left.

The state holds, for each partition of an increment, its ends, its numbers of messages and distinct offsets, an order-free
hash of its rows and the range that the increment is known to complete; gapped partitions have their exact offsets in
``offsets``.  So appends, reports, counts and checks of a snapshot read no old messages.  ``merge_increments`` rewrites many increments
as one; the switch is the one state file that names those it replaces.
"""
from __future__ import annotations

import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.buckets import bucket_of
from tidemark.operators.offset_sets import SETS, SPAN, bucket, merged_ranges, merged_sets, position
from tidemark.schemas import COMMITS, ENDS, LOG, conform
from tidemark.session import observed_count

logger = logging.getLogger(__name__)

MESSAGES_DIR = "messages"
OFFSETS_DIR = "offsets"
COMMITS_DIR = "commits"
PENDING_DIR = "pending"
STATE_DIR = "state"
INCREMENT = T.StructField("increment", T.StringType(), True)
DIGEST = T.StructField("digest", T.LongType(), True)
# what an increment's own row tells about the run that wrote it
RUN = [T.StructField("run", T.StringType(), True), T.StructField("batch", T.LongType(), True),
       T.StructField("seen", T.LongType(), True), T.StructField("written", T.LongType(), True),
       T.StructField("outcome", T.StringType(), True), T.StructField("at", T.TimestampType(), True)]
# one row with a null topic and partition for the increment itself, then one for each partition
STATE = T.StructType([
    T.StructField("own", T.BooleanType(), True), T.StructField("seq", T.LongType(), True), T.StructField("has_commits", T.BooleanType(), True),
    T.StructField("has_pending", T.BooleanType(), True), T.StructField("replaces", T.ArrayType(T.StringType()), True),
    T.StructField("takes", T.ArrayType(T.StringType()), True), *RUN,
    *ENDS.fields, T.StructField("offsets", T.LongType(), True), T.StructField("messages", T.LongType(), True), DIGEST,
    T.StructField("covered_low", T.LongType(), True), T.StructField("covered_high", T.LongType(), True), INCREMENT])
# a bucket of the offsets folder: its set and the sums over its rows
BUCKETS = T.StructType([*SETS.fields, T.StructField("low", T.LongType(), True), T.StructField("high", T.LongType(), True),
                        T.StructField("messages", T.LongType(), True), DIGEST])

# offsets per write chunk: a hot partition is spread over many tasks in
# chunks of this many offsets, each task sorts only its own chunks
DEFAULT_FILE_SPAN = 1 << 20
DEFAULT_MAX_RECORDS_PER_FILE = 5_000_000
# message payloads dominate the snapshot size; zstd compresses them well at snappy-like speed
DEFAULT_COMPRESSION = "zstd"
MODES = ("errorifexists", "overwrite", "append")


class SnapshotExistsError(ValueError):
    pass


def messages_path(path: str) -> str:
    return f"{path.rstrip('/')}/{MESSAGES_DIR}"


def commits_path(path: str) -> str:
    return f"{path.rstrip('/')}/{COMMITS_DIR}"


def state_path(path: str) -> str:
    return f"{path.rstrip('/')}/{STATE_DIR}"


def offsets_path(path: str) -> str:
    return f"{path.rstrip('/')}/{OFFSETS_DIR}"


def pending_path(path: str) -> str:
    return f"{path.rstrip('/')}/{PENDING_DIR}"


def row_digest() -> Column:
    """A 64-bit hash of a message with its place; nulls count apart from values."""
    fields = [f.name for f in LOG.fields]
    return F.xxhash64(*fields, *[F.isnull(c) for c in fields])


def read_state(spark: SparkSession, path: str, replaced: bool = False) -> DataFrame | None:
    """The state of a snapshot folder, or None where there is none; increments that a merged one replaces are
    left out unless ``replaced``."""
    try:
        state = spark.read.schema(STATE).parquet(state_path(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if replaced:
        return state
    gone = state.where("own").select(F.explode("replaces").alias("increment"))
    return state.join(gone, "increment", "left_anti").select(*STATE.fieldNames())


def held_rows(spark: SparkSession, path: str, without_prefix: str | None = None) -> DataFrame | None:
    """State rows of the partitions that the complete increments hold; ``without_prefix`` leaves out the
    increments whose name starts so."""
    state = read_state(spark, path)
    if state is None:
        return None
    rows = state.where(F.col("low").isNotNull())
    return rows if without_prefix is None else rows.where(~F.col("increment").startswith(without_prefix))


def held_ends(spark: SparkSession, path: str, without_prefix: str | None = None) -> DataFrame | None:
    """Ends of what the complete increments hold, one row a partition; None without a snapshot."""
    rows = held_rows(spark, path, without_prefix)
    if rows is None:
        return None
    return conform(rows.groupBy("topic", "partition").agg(F.min("low").alias("low"), F.max("high").alias("high")), ENDS)


def _dense() -> Column:
    return F.coalesce(F.col("offsets") == F.col("high") - F.col("low"), F.lit(False))


def held_offsets(spark: SparkSession, path: str, without_prefix: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """What the complete increments hold: (topic, partition, ranges) of those without gaps, joined where they
    meet (low, and high exclusive), and the offset sets of those with gaps.  None for either where there is nothing."""
    rows = held_rows(spark, path, without_prefix)
    if rows is None:
        return None, None
    kinds = {r["dense"]: r["n"] for r in rows.groupBy(_dense().alias("dense")).agg(F.count(F.lit(1)).alias("n")).collect()}    # two rows
    ranges = sets = None
    if kinds.get(True):
        ranges = (merged_ranges(rows.where(_dense()).select("topic", "partition", "low", "high"))
                  .groupBy("topic", "partition").agg(F.collect_list(F.struct("low", "high")).alias("ranges")))
    if kinds.get(False):
        sets = _sets_of(spark, path, rows.where(~_dense()))
    return ranges, sets


def _sets_of(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The offset sets of the increments and partitions in ``rows``, one row a bucket."""
    of = rows.select(*[F.col(c).alias(f"_{c}") for c in ("increment", "topic", "partition")]).distinct()
    stored = spark.read.schema(T.StructType([*BUCKETS.fields, INCREMENT])).parquet(offsets_path(path))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("increment", "topic", "partition")]
    return merged_sets(stored.join(of, same, "left_semi").select(*SETS.fieldNames()))


def held_sets(spark: SparkSession, path: str) -> DataFrame | None:
    """The offset sets of all complete increments, one row a bucket."""
    rows = held_rows(spark, path)
    return None if rows is None else _sets_of(spark, path, rows)


def covered_ranges(spark: SparkSession, path: str) -> DataFrame | None:
    """(topic, partition, low, high): ranges in which a complete increment left nothing of its source out."""
    state = read_state(spark, path)
    if state is None:
        return None
    return (state.where(F.col("covered_low").isNotNull())
            .select("topic", "partition", F.col("covered_low").alias("low"), F.col("covered_high").alias("high")))


def write_messages(log: DataFrame, path: str, increment: str, file_span: int = DEFAULT_FILE_SPAN,
                   num_partitions: int | None = None,
                   max_records_per_file: int = DEFAULT_MAX_RECORDS_PER_FILE,
                   compression: str = DEFAULT_COMPRESSION, cluster: bool = True) -> int | None:
    """Write the messages of one increment, one folder per (topic, partition); what an
    earlier attempt at the same increment left is replaced.

    Rows are hash-partitioned on (topic, partition, offset chunk): no single
    task receives a whole hot partition and no range-sampling pass re-reads
    the payload.  Each task sorts its rows by (topic, partition, offset), so
    files hold ascending offsets; readers still sort explicitly.

    ``cluster=False`` skips the shuffle for input that is already grouped by
    partition (the Kafka source reads one partition range per task, a
    snapshot one file per task): each task sorts its own rows and writes.
    On mixed input it would leave many small files.

    Returns the number of messages, observed in the stage that writes them; None
    if the observation brought none."""
    rows = conform(log, LOG).withColumn(DIGEST.name, row_digest())
    if cluster:
        rows = rows.withColumn("_chunk", bucket_of("offset", file_span))
        keys = ["topic", "partition", "_chunk"]
        rows = (rows.repartition(num_partitions, *keys) if num_partitions else rows.repartition(*keys)).drop("_chunk")
    obs = Observation(f"written_{uuid.uuid4().hex[:8]}")
    folder = f"{messages_path(path)}/increment={increment}"
    (rows.observe(obs, F.count(F.lit(1)).alias("messages")).sortWithinPartitions("topic", "partition", "offset")
     .write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).option("compression", compression)
     .partitionBy("topic", "partition").parquet(folder))
    written = observed_count(obs, "messages")
    logger.info("wrote %s messages to %s", written, folder)
    return written


def write_commits(commits: DataFrame, path: str, increment: str) -> None:
    """Write captured commits (small: one row per group and partition)."""
    conform(commits, COMMITS).write.mode("overwrite").parquet(f"{commits_path(path)}/increment={increment}")


def write_pending(log: DataFrame, path: str, increment: str) -> None:
    """Write messages that wait for a later end bound."""
    (conform(log, LOG).repartition("topic", "partition", bucket_of("offset", DEFAULT_FILE_SPAN)).write.mode("overwrite")
     .option("compression", DEFAULT_COMPRESSION).partitionBy("topic", "partition").parquet(f"{pending_path(path)}/increment={increment}"))


def clear_snapshot(spark: SparkSession, path: str) -> None:
    """Make a snapshot folder empty: the state first, so no reader meets half of it."""
    for folder, schema in ((state_path(path), STATE), (commits_path(path), COMMITS), (offsets_path(path), BUCKETS),
                           (pending_path(path), LOG), (messages_path(path), LOG)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)


def write_offsets(spark: SparkSession, path: str, increment: str) -> DataFrame:
    """The buckets of an increment's messages, written, and read back: (topic, partition, low, high, offsets, messages, digest).

    Reads two narrow columns of the increment's own files; the offsets are not shuffled, only one row for each bucket and task."""
    own = spark.read.schema(T.StructType([*LOG.fields, DIGEST])).parquet(f"{messages_path(path)}/increment={increment}")
    n = F.bitmap_count("bits")
    buckets = (own.groupBy("topic", "partition", bucket().alias("bucket"))
               .agg(F.bitmap_construct_agg(position()).alias("bits"), F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"),
                    F.count(F.lit(1)).alias("messages"), F.bit_xor("digest").alias("digest"))
               .select("topic", "partition", "bucket", n.alias("n"), F.when(n < SPAN, F.col("bits")).alias("bits"), "low", "high", "messages", "digest"))
    folder = f"{offsets_path(path)}/increment={increment}"
    buckets.write.mode("overwrite").option("compression", DEFAULT_COMPRESSION).parquet(folder)
    return partition_sums(spark.read.schema(BUCKETS).parquet(folder))


def partition_sums(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("topic", "partition").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("offsets"), F.sum("messages").alias("messages"),
        F.bit_xor("digest").alias("digest"))


def write_state(spark: SparkSession, path: str, increment: str, partitions: DataFrame | None = None, covered: DataFrame | None = None, **own) -> None:
    """Write an increment's state: what makes it visible.  ``partitions`` as ``partition_sums`` gives them, ``covered`` (topic,
    partition, low, high), and the fields of its own row."""
    row = {"own": True, "seq": 0, "has_commits": False, "has_pending": False, **own}
    rows = spark.createDataFrame([tuple(row.get(f.name) for f in STATE.fields[:-1])], T.StructType(STATE.fields[:-1]))
    if covered is not None:
        ranges = covered.select("topic", "partition", F.col("low").alias("covered_low"), F.col("high").alias("covered_high"))
        empty = spark.createDataFrame([], T.StructType(STATE.fields[:-1])).select("topic", "partition", "low", "high", "offsets", "messages", "digest")
        held = (empty if partitions is None else partitions).withColumnsRenamed({"topic": "_t", "partition": "_p"})
        both = held.join(ranges, F.col("topic").eqNullSafe(F.col("_t")) & F.col("partition").eqNullSafe(F.col("_p")), "full")
        partitions = both.withColumns({"topic": F.coalesce("topic", "_t"), "partition": F.coalesce("partition", "_p")}).drop("_t", "_p")
    if partitions is not None:
        rows = rows.unionByName(partitions.withColumn("own", F.lit(False)), allowMissingColumns=True)
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in STATE.fields[:-1]])
    rows.coalesce(1).write.mode("overwrite").parquet(f"{state_path(path)}/increment={increment}")


def next_seq(spark: SparkSession, path: str, name: str) -> int:
    state = read_state(spark, path, replaced=True)
    before = None if state is None else state.where(F.col("increment") != name).agg(F.max("seq").alias("s")).first()["s"]
    return 0 if before is None else before + 1


def write_increment(log: DataFrame, path: str, commits: DataFrame | None = None, mode: str = "errorifexists",
                    increment: str | None = None, covered: DataFrame | None = None, pending: DataFrame | None = None,
                    own: dict | None = None, **options) -> int:
    """Add one increment (messages, offsets, commits, then its state) and return its number of messages.

    ``errorifexists`` wants a folder without complete increments; ``overwrite`` clears it
    first; ``append`` adds to it.  ``increment`` names it; writing a name again replaces it.  ``covered`` (topic, partition,
    low, high) are the ranges of which the increment leaves nothing out; ``pending`` are messages that wait for a
    later end bound.  ``own``: more fields of the increment's state (a function is called after the write)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = log.sparkSession
    name = increment or uuid.uuid4().hex
    if mode == "overwrite":
        clear_snapshot(spark, path)
    state = read_state(spark, path)
    if mode == "errorifexists" and state is not None and not state.isEmpty():
        raise SnapshotExistsError(f"{path} holds a snapshot")
    seq = next_seq(spark, path, name)
    messages = write_messages(log, path, name, **options)
    partitions = write_offsets(spark, path, name)
    if messages is None:
        messages = partitions.agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("n")).first()["n"]
    if pending is not None:
        write_pending(pending, path, name)
    if commits is not None:
        write_commits(commits, path, name)
    write_state(spark, path, name, partitions, covered, seq=seq, has_commits=commits is not None, has_pending=pending is not None,
                written=messages, **{k: v() if callable(v) else v for k, v in (own or {}).items()})
    logger.info("increment %s of %s: %d messages", name, path, messages)
    return messages


def merge_increments(spark: SparkSession, path: str, below: int | None = None, **options) -> list[str]:
    """Rewrite the complete increments of fewer than ``below`` messages (default: all) as one; the names it replaces.

    The merged increment is written beside the others and becomes visible with its state, which names what it replaces: one
    file, so a reader sees the old ones or the merged one, and a job that dies before leaves all as it was.  The folders of
    replaced increments stay for readers that have begun, until ``remove_replaced``."""
    state = read_state(spark, path)
    if state is None:
        return []
    own = state.where("own").select("increment", "seq", "has_commits", "has_pending", "takes", "written").collect()    # one short row an increment
    last_commits = max((r for r in own if r.has_commits), key=lambda r: (r.seq, r.increment), default=None)
    chosen = [r for r in own if below is None or (r.written or 0) < below]
    # messages that wait keep their increment: its name is what a later run takes them by
    chosen = [r for r in chosen if not r.has_pending]
    if len(chosen) < 2:
        return []
    names = sorted(r.increment for r in chosen)
    name = f"merged-{uuid.uuid4().hex}"
    of = spark.createDataFrame([(n,) for n in names], T.StructType([INCREMENT]))
    rows = spark.read.schema(T.StructType([*LOG.fields, INCREMENT])).parquet(messages_path(path))
    write_messages(rows.join(F.broadcast(of), "increment", "left_semi"), path, name, **options)
    partitions = write_offsets(spark, path, name)
    with_commits = last_commits is not None and last_commits.increment in names
    if with_commits:
        write_commits(spark.read.schema(COMMITS).parquet(f"{commits_path(path)}/increment={last_commits.increment}"), path, name)
    covered = covered_of(state, of)
    # the commits' place in the order: an increment that is not merged may have later ones
    seq = last_commits.seq if with_commits else max(r.seq for r in chosen)
    write_state(spark, path, name, partitions, covered, seq=seq, has_commits=with_commits, replaces=names,
                takes=sorted({t for r in chosen for t in r.takes or []}), written=sum(r.written or 0 for r in chosen), outcome="merged")
    logger.info("merged %d increments of %s into %s", len(names), path, name)
    return names


def covered_of(state: DataFrame, names: DataFrame) -> DataFrame:
    """The widest covered range of each partition in the named increments; ranges that do not meet it are given up."""
    rows = state.join(F.broadcast(names), "increment", "left_semi").where(F.col("covered_low").isNotNull())
    merged = merged_ranges(rows.select("topic", "partition", F.col("covered_low").alias("low"), F.col("covered_high").alias("high")))
    widest = merged.groupBy("topic", "partition").agg(F.max_by(F.struct("low", "high"), F.col("high") - F.col("low")).alias("r"))
    return widest.select("topic", "partition", "r.low", "r.high")


def remove_replaced(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of replaced increments, for when no reader that began before the merge is left; their names.

    The state goes first; the merged increment goes on naming what it replaced."""
    state = read_state(spark, path, replaced=True)
    if state is None:
        return []
    gone = [r.increment for r in state.where("own").select(F.explode("replaces").alias("increment")).distinct().collect()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in (state_path(path), commits_path(path), offsets_path(path), messages_path(path)):
        for name in gone:
            target = jvm.org.apache.hadoop.fs.Path(f"{folder}/increment={name}")
            target.getFileSystem(conf).delete(target, True)
    return sorted(gone)
