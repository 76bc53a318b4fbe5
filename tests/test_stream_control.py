"""Bounds, stops, progress and audit of streams."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from builders import commits_df, messages
from tidemark.operators.offset_sets import missing_ranges
from tidemark.plans import backup, snapshot_report
from tidemark.schemas import ENDS, LOG
from tidemark.sources.snapshot import read_messages, read_pending, read_progress
from tidemark.streaming import incremental_backup, repeats_of, run_audit, seen_sets


def _arrive(log, src):
    log.coalesce(1).write.mode("append").parquet(src)


def _stream(spark, src):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)


def test_ends_bound_a_stream_and_the_rest_waits(spark, scratch):
    src, path = os.path.join(scratch, "src"), os.path.join(scratch, "snap")
    log = messages(spark, "t", 0, range(30)).unionByName(messages(spark, "u", 0, range(10))).cache()
    _arrive(log.where("offset < 15"), src)
    _arrive(log.where("offset >= 15"), src)

    def ends(t):
        return spark.createDataFrame([("t", 0, 0, t)], ENDS)

    def held():
        return sorted((r.topic, r.offset) for r in read_messages(spark, path).collect())

    first = incremental_backup(_stream(spark, src), path, ends=ends(10))
    assert first.finished and held() == [("t", o) for o in range(10)]
    assert read_pending(spark, path)[0].count() == 30
    assert {(r.topic, r.status) for r in first.report(ends(10)).collect()} == {("t", "done")}
    assert incremental_backup(_stream(spark, src), path, ends=ends(20)).rows == 10      # nothing new arrived: what waited
    assert held() == [("t", o) for o in range(20)]
    # others may have brought a waiting message meanwhile
    backup(log.where("topic = 't' and offset = 25"), commits_df(spark, []), path, mode="append")
    assert incremental_backup(_stream(spark, src), path).rows == 19
    assert held() == sorted([("t", o) for o in range(30)] + [("u", o) for o in range(10)])
    assert read_pending(spark, path) == (None, [])


def test_a_batch_limit_stops_and_reports(spark, scratch):
    src, path = os.path.join(scratch, "src"), os.path.join(scratch, "snap")
    log = messages(spark, "t", 0, range(30)).cache()
    for part in ("offset < 10", "offset >= 20", "offset between 10 and 19"):
        _arrive(log.where(part), src)
    ends = spark.createDataFrame([("t", 0, 0, 30)], ENDS)
    first = incremental_backup(_stream(spark, src), path, max_batches=2)
    assert (first.finished, first.outcome, first.rows, first.batches) == (False, "batch limit", 20, 2)
    assert [(r.status, r.remaining) for r in first.report(ends).collect()] == [("remaining", 10)]
    second = incremental_backup(_stream(spark, src), path)
    assert second.finished and second.rows == 10
    assert [(r.status, r.remaining) for r in second.report(ends).collect()] == [("done", 0)]
    progress = read_progress(spark, path).orderBy("at").collect()
    assert [(r.batch, r.seen, r.written, r.outcome) for r in progress] == [
        (0, 10, 10, None), (1, 10, 10, None), (None, 20, 20, "batch limit"), (2, 10, 10, None), (None, 10, 10, "finished")]


def test_a_time_limit_that_has_passed_writes_nothing(spark, scratch):
    src, path = os.path.join(scratch, "src"), os.path.join(scratch, "snap")
    _arrive(messages(spark, "t", 0, range(5)), src)
    stopped = incremental_backup(_stream(spark, src), path, timeout=0.0)
    assert (stopped.finished, stopped.outcome, stopped.rows) == (False, "time limit", 0)
    assert incremental_backup(_stream(spark, src), path).rows == 5


def test_small_increments_are_merged_at_the_end(spark, scratch):
    src, path = os.path.join(scratch, "src"), os.path.join(scratch, "snap")
    log = messages(spark, "t", 0, range(12)).cache()
    for k in range(4):
        _arrive(log.where(f"offset % 4 = {k}"), src)
    incremental_backup(_stream(spark, src), path, merge_above=2)
    assert read_messages(spark, path).select("offset").distinct().count() == 12
    ends = spark.createDataFrame([("t", 0, 0, 12)], ENDS)
    assert [r.status for r in snapshot_report(spark, path, ends).collect()] == ["done"]
    _arrive(messages(spark, "t", 0, [12]), src)
    assert incremental_backup(_stream(spark, src), path).rows == 1
    assert read_messages(spark, path).count() == 13


def test_audit_finds_repeats_and_holes_across_runs(spark, scratch):
    src, path = os.path.join(scratch, "src"), os.path.join(scratch, "audit")
    told = []
    _arrive(messages(spark, "t", 0, [0, 1, 1, 5, 40_000]), src)
    _arrive(messages(spark, "t", 0, [5, 6, -3]), src)
    run_audit(_stream(spark, src), path, on_repeats=lambda df: told.extend((r.offset, r.repeats) for r in df.collect()))
    _arrive(messages(spark, "t", 0, [2, 40_000, 40_000]), src)
    run_audit(_stream(spark, src), path)
    audit = spark.read.parquet(f"{path}/audit")
    assert {(r.offset, r.repeats) for r in repeats_of(audit).collect()} == {(1, 1), (5, 1), (40_000, 2)}
    assert sorted(told) == [(1, 1), (5, 1)]
    asked = spark.createDataFrame([("t", 0, -3, 40_001)], ENDS)
    holes = missing_ranges(asked, seen_sets(audit.drop("batch"))).orderBy("low").collect()
    assert [(r.low, r.high) for r in holes] == [(-2, 0), (3, 5), (7, 40_000)]


def test_files_of_the_audited_stream_grow_with_no_table(spark, scratch, monkeypatch):
    """The stream's files are as many as the scan's splits, each wave is a micro-batch, whatever the suppliers."""
    paths = {}
    monkeypatch.setattr(entry, "scratch_path", lambda s, name: paths.setdefault(name, os.path.join(scratch, name)))
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(0, 2400, 1, 8).select((F.col("id") % 2000 + 1).alias("l_orderkey"), (F.col("id") % 7).alias("l_suppkey"), F.lit(5).cast("bigint").alias("l_partkey"),
                                             F.lit(1).cast("bigint").alias("l_linenumber"), F.lit("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), day.alias("l_shipdate"))
    rows = rows.withColumn("l_suppkey", F.when(F.col("l_suppkey") > 0, F.col("l_suppkey")))
    rows.write.parquet(f"{scratch}/lineitem.parquet")
    for key, value in (("spark.sql.files.maxPartitionBytes", "4k"), ("spark.sql.files.openCostInBytes", "4k")):
        spark.conf.set(key, value)
    try:
        got = entry.q_stream_repeats(spark, scratch).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256m")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(r.repeats for r in got) == 400 and {r.offset for r in got} == {8 * k + 1 for k in range(1, 401)}
    files = spark.read.parquet(paths["repeating"]).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 2400 and len(files) > 8 and max(r["count"] for r in files) <= 300
    assert len([x for x in os.listdir(os.path.join(paths["audit"], "audit")) if x.startswith("batch=")]) in (3, 4)


def test_a_failure_is_no_stop(spark, scratch):
    src = os.path.join(scratch, "src")
    _arrive(messages(spark, "t", 0, range(5)).withColumn("key", F.lit(None).cast("binary")), src)
    with pytest.raises(Exception, match="null key"):
        incremental_backup(_stream(spark, src), os.path.join(scratch, "snap"), max_batches=5)
