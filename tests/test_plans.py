"""Plan shape checks: no products, narrow scans, bounded windows, checked broadcasts."""
import os

from pyspark.sql import functions as F

from builders import commits_df
from conftest import SF_SMALL
from tidemark import operators as ops
from tidemark.sinks.snapshot import write_increment
from tidemark.sources import tables as tv
from tidemark.sources.snapshot import read_messages


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")       # whole filters in the scan's line
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def _commits(spark, log):
    ends = ops.end_offsets(log)
    return ops.capture_commits(tv.nation_commits(spark, SF_SMALL, ends), ends)


def test_translation_has_no_product_and_bounded_windows(spark):
    log = tv.events_log(spark, SF_SMALL)
    plan = _plan(ops.translate_offsets(log, _commits(spark, log)))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    # every window over messages is partitioned by the bucket as well
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    message_windows = [w for w in windows if "offset" in w and "row_number" not in w]
    assert all("bucket" in w for w in message_windows)


def test_translation_reads_only_key_columns(spark):
    log = tv.events_log(spark, SF_SMALL)
    plan = _plan(ops.translate_offsets(log, _commits(spark, log)))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "events.parquet" in line]
    assert scans
    for s in scans:
        assert "props" not in s and "ts:" not in s  # payload and time never read


def test_positions_window_is_per_bucket(spark):
    log = tv.events_log(spark, SF_SMALL)
    plan = _plan(ops.with_target_offsets(log))
    assert "row_number()" in plan
    ex = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("bucket" in e and "offset" not in e for e in ex)
    assert not any(e.count(",") == 2 and "topic" in e and "bucket" not in e for e in ex)


def test_cut_broadcast_is_checked(spark):
    log = tv.events_log(spark, SF_SMALL)
    ends = ops.end_offsets(log)

    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    small = ops.cut(log, ends)
    assert hinted(small) and "BroadcastHashJoin" in _plan(small)
    # over the row bound there is no hint: a shuffle join, which AQE may still
    # turn into a broadcast from the sizes it measured at run time
    assert not hinted(ops.cut(log, ends, max_broadcast_rows=0))


def test_snapshot_topic_filter_reaches_the_scan(spark, scratch):
    log = tv.events_log(spark, SF_SMALL)
    path = os.path.join(scratch, "snap")
    write_increment(log, path, commits_df(spark, []))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = _plan(read_messages(spark, path, ["click"]).where(F.col("offset") > 100).select("offset"))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "/messages" in line)
    assert "PartitionFilters: [" in scan and "click" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "PushedFilters: [IsNotNull(offset), GreaterThan(offset,100)]" in plan
    assert "ReadSchema: struct<offset:bigint>" in plan


def test_registered_queries_have_no_products_and_stay_in_the_jvm(spark):
    import __spark_entry__ as E
    python_nodes = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                    "PythonDataSource", "PythonMapInArrow")
    for name, query in E.QUERIES.items():
        plan = query(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert not any(node in plan for node in python_nodes), name


def test_restore_plan_translation_reads_offsets_only(spark, scratch):
    from tidemark.plans import backup, restore_plan
    log = tv.events_log(spark, SF_SMALL)
    ends = ops.end_offsets(log)
    path = os.path.join(scratch, "snap")
    backup(log, tv.nation_commits(spark, SF_SMALL, ends), path)
    _, plan = restore_plan(spark, path, topics=["click"])
    text = _plan(plan)
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "/messages" in line]
    assert scans
    for s in scans:
        assert "ReadSchema: struct<offset:bigint>" in s and "PartitionFilters: [" in s and "click" in s


def test_latest_per_offset_shuffles_the_payload_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(ops.latest_per_offset(tv.lineitem_log(spark, SF_SMALL)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "Join" not in final


def test_a_lost_count_never_forces_a_broadcast(spark, monkeypatch):
    import tidemark.session as session

    class Lost:
        @property
        def get(self):
            raise RuntimeError("metrics lost")

    assert session.observed_count(Lost(), "n") is None
    monkeypatch.setattr(session, "observed_count", lambda obs, name: None)
    log = tv.events_log(spark, SF_SMALL)
    frame, n = session.materialize(ops.end_offsets(log))
    assert n == frame.count() == 20
    joined = ops.cut(log, ops.end_offsets(log), max_broadcast_rows=19)
    assert "strategy=broadcast" not in joined._jdf.queryExecution().analyzed().toString()


def test_known_rows_above_the_bound_are_not_counted_again(spark, monkeypatch):
    import tidemark.operators.joins as joins

    def counted(*_):
        raise AssertionError("counted again")

    monkeypatch.setattr(joins, "fits_broadcast", counted)
    ends = ops.end_offsets(tv.events_log(spark, SF_SMALL))
    joins.join_checked(ends, ends, ["topic", "partition"], max_rows=5, known_rows=6)
    joins.join_checked(ends, ends, ["topic", "partition"], max_rows=5, known_rows=5)
