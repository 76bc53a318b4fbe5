"""The driver's test tables seen as message logs and commit tables.

These views are how the test suite, the registered queries and the bench
feed the operators; a real deployment passes its own log DataFrame (a
snapshot, a table in the LOG layout, or the Kafka source).

* ``events`` -> main log: topic = event_type, partition = user_id % 4,
  offset = event_id (unique, with gaps inside each partition).
* ``conversations`` -> many small partitions: topic = role,
  partition = conv_id, offset = turn; system turns carry no key.
* ``lineitem`` -> bench-size log with repeated offsets: topic =
  l_returnflag, partition = l_orderkey % 8, offset = l_orderkey * 8 + l_linenumber.
* ``hot``: the lineitem log with every message in one partition (skew).
* ``nation`` x ends -> commits: every partition is committed by the five
  nations of region ``partition % 5`` (an equi join, five rows a partition),
  plus temporary (UUID-named) groups and "no offset" rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import ntz_to_instant
from tidemark.operators.commits import NO_OFFSET
from tidemark.schemas import COMMITS, ENDS, LOG, conform

# fixed values of the test views (the oracle SQL repeats them)
EVENTS_PARTITIONS = 4
LINEITEM_PARTITIONS = 8
TYPE_HEADER = "type"
TRACE_HEADER = "trace"
LINESTATUS_HEADER = "linestatus"
TEMP_GROUP_PREFIX = "tmp-"
ABSENT_PARTITION = 99       # of every topic: no log has it
ORDER_STATUSES = "FOP"
HOT_TOPIC = "hot"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string").cast("binary")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_log(table(spark, sf_dir, "events"))


# files of one micro-batch: a stopped run keeps its finished micro-batches
DEFAULT_MAX_FILES_PER_TRIGGER = 1000


def file_stream(spark: SparkSession, schema, folder: str, glob: str = "*.parquet",
                max_files_per_trigger: int = DEFAULT_MAX_FILES_PER_TRIGGER) -> DataFrame:
    """A folder of parquet files as a stream (new files are new data), some files at a time."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder.rstrip("/")))


def write_waves(df: DataFrame, by: str, waves: int, folder: str) -> int:
    """Write ``df`` as files that arrive in ``waves``, one after the other, dealt by the hash of a column; returns the
    files of the largest wave, which as ``max_files_per_trigger`` makes each wave about one micro-batch.

    Every task writes its own rows of a wave, nothing is shuffled, so a file grows with the scan's split and not with
    the table."""
    spark, files = df.sparkSession, [0]
    for wave in range(waves):
        df.where(F.pmod(F.hash(by), F.lit(waves)) == wave).write.mode("append").parquet(folder)
        files.append(len(spark.read.schema(df.schema).parquet(folder).inputFiles()))
    return max(1, *(after - before for before, after in zip(files, files[1:])))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    return file_stream(spark, table(spark, sf_dir, "events").schema, sf_dir, "events.parquet")


def events_as_log(ev: DataFrame) -> DataFrame:
    """events rows (batch or streaming) -> LOG."""
    eid = F.col("event_id")
    type_header = F.struct(F.lit(TYPE_HEADER).alias("key"), _text(F.col("event_type")).alias("value"))
    trace_header = F.struct(F.lit(TRACE_HEADER).alias("key"), F.lit(None).cast("binary").alias("value"))
    headers = (F.when(eid % 10 == 0, F.lit(None))
               .when(eid % 10 == 1, F.array().cast(LOG["headers"].dataType))
               .when(eid % 3 == 0, F.array(type_header, trace_header))
               .otherwise(F.array(type_header)))
    return conform(ev.select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % EVENTS_PARTITIONS).cast("int").alias("partition"),
        eid.alias("offset"),
        _text(F.col("user_id")).alias("key"),
        _text(F.col("props")).alias("value"),
        ntz_to_instant("ts").alias("timestamp"),
        headers.alias("headers")), LOG)


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = table(spark, sf_dir, "conversations")
    key = F.when(F.col("role") == "system", F.lit(None).cast("binary")).otherwise(_text(F.col("conv_id")))
    return conform(cv.select(
        F.col("role").alias("topic"),
        F.col("conv_id").cast("int").alias("partition"),
        F.col("turn").alias("offset"),
        key.alias("key"),
        _text(F.col("text")).alias("value"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(None).alias("headers")), LOG)


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_as_log(table(spark, sf_dir, "lineitem"))


def lineitem_as_log(li: DataFrame) -> DataFrame:
    """lineitem rows (batch or streaming) -> LOG."""
    value = F.concat(F.col("l_partkey").cast("string"), F.lit("|"), F.col("l_suppkey").cast("string"))
    header = F.struct(F.lit(LINESTATUS_HEADER).alias("key"), _text(F.col("l_linestatus")).alias("value"))
    return conform(li.select(
        F.col("l_returnflag").alias("topic"),
        (F.col("l_orderkey") % LINEITEM_PARTITIONS).cast("int").alias("partition"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("offset"),
        _text(F.col("l_orderkey")).alias("key"),
        value.cast("binary").alias("value"),
        ntz_to_instant("l_shipdate").alias("timestamp"),
        F.array(header).alias("headers")), LOG)


def hot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem message in one partition (topic ``hot``, partition 0), one per
    offset: the skew case, a single partition holding all rows."""
    from tidemark.operators.checks import latest_per_offset

    li = lineitem_log(spark, sf_dir)
    return latest_per_offset(li.withColumn("topic", F.lit(HOT_TOPIC)).withColumn("partition", F.lit(0)))


def temp_group_name(name: Column) -> Column:
    """A UUID-shaped group name derived from ``name`` (md5 hex cut 8-4-4-4-12)."""
    h = F.md5(name)
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
             F.substring(h, 17, 4), F.substring(h, 21, 12)]
    return F.concat(F.lit(TEMP_GROUP_PREFIX), F.concat_ws("-", *parts))


def nation_commits(spark: SparkSession, sf_dir: str, ends: DataFrame) -> DataFrame:
    """Raw commits (before capture) for the partitions of ``ends``."""
    nation = table(spark, sf_dir, "nation")
    fan = ends.select("topic", "partition", "high").join(
        nation, F.col("n_regionkey") == (F.col("partition") % 5))
    slot = F.expr("n_nationkey div 5")
    committed = (F.when((slot == 2) & (F.col("partition") % 2 == 1), F.lit(NO_OFFSET).cast("long"))
                 .otherwise(F.expr("(high * (n_nationkey div 5)) div 3")))
    regular = fan.select(F.col("n_name").alias("consumer_group"), "topic", "partition",
                         committed.alias("committed"))
    temporary = fan.where(slot == 0).select(temp_group_name(F.col("n_name")).alias("consumer_group"),
                                            "topic", "partition", F.col("high").alias("committed"))
    return conform(regular.unionByName(temporary), COMMITS)


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits as another system left them: one for each order status and topic that meet by number, on
    a partition the log has, on one it lacks, and without a topic."""
    number = F.instr(F.lit(ORDER_STATUSES), F.col("o_orderstatus")) - 1
    status = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("k", number)
    topics = (table(spark, sf_dir, "events")
              .select(F.col("event_type").alias("topic"), (F.col("user_id") % len(ORDER_STATUSES)).cast("int").alias("k")).distinct())
    group = F.concat(F.lit("orders-"), F.col("o_orderstatus"))
    both = status.join(topics, "k")
    row = lambda topic, partition: F.struct(topic.cast("string").alias("topic"), partition.cast("int").alias("partition"))
    places = F.array(row(F.col("topic"), F.lit(1)), row(F.col("topic"), F.lit(ABSENT_PARTITION)), row(F.lit(None), F.lit(1)))
    flat = both.select(group.alias("consumer_group"), F.explode(places).alias("at"), F.col("n").alias("committed"))
    return conform(flat.select("consumer_group", "at.topic", "at.partition", "committed"), COMMITS)


def odd_ends(ends: DataFrame) -> DataFrame:
    """``ends`` with the end of partition 0 unknown and partition 1 empty."""
    high = F.when(F.col("partition") == 0, F.lit(None).cast("bigint")).when(F.col("partition") == 1, F.col("low")).otherwise(F.col("high"))
    return conform(ends.withColumn("high", high), ENDS)


def hashed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events log with keys and values that are no text: the bytes of an MD5."""
    digest = lambda *c: F.unhex(F.md5(F.concat_ws(":", *c)))      # noqa: E731
    log = events_log(spark, sf_dir)
    return conform(log.withColumns({"key": digest(F.col("offset")), "value": digest(F.col("topic"), F.col("offset"))}), LOG)
