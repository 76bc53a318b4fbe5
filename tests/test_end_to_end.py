"""Backup -> restore properties and a hot partition (one partition holding every row)."""
import bisect
import os

from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from tidemark import operators as ops
from tidemark.plans import backup, restore_plan, snapshot_complete
from tidemark.sources import tables as tv
from tidemark.sources.snapshot import read_messages


def test_backup_then_restore_is_identity_on_messages(spark, scratch):
    log = tv.events_log(spark, SF_SMALL)
    ends = ops.end_offsets(log)
    path = os.path.join(scratch, "snap")
    backup(log, tv.nation_commits(spark, SF_SMALL, ends), path)
    rows, plan = restore_plan(spark, path)
    back = rows.drop("target_offset")
    assert back.exceptAll(log).count() == 0 and log.exceptAll(back).count() == 0
    assert snapshot_complete(spark, path, ends).first().complete is True
    # the plan's offsets lie in [0, n] and grow with the committed offset
    n = {(r.topic, r.partition): r.messages for r in ops.partition_counts(log).collect()}
    seen = {}
    for r in plan.orderBy("topic", "partition", "committed").collect():
        assert 0 <= r.new_offset <= n[(r.topic, r.partition)]
        key = (r.topic, r.partition)
        assert seen.get(key, 0) <= r.new_offset
        seen[key] = r.new_offset


def _hot_log(spark):
    # every lineitem row in one partition: the skew the bucketed plans exist for
    li = ops.latest_per_offset(tv.lineitem_log(spark, SF_ORACLE))
    return li.withColumn("topic", F.lit("hot")).withColumn("partition", F.lit(0))


def test_hot_partition_positions_spread_and_are_exact(spark):
    log = _hot_log(spark)
    offsets = sorted(r.offset for r in log.select("offset").collect())
    ranked = ops.with_target_offsets(log, bucket_span=1024).select(
        "offset", "target_offset", F.spark_partition_id().alias("task"))
    # AQE would merge these small shuffle partitions into one; at scale it does not
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ranked.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r.task for r in rows}) > 1  # not one task for the partition
    assert sorted((r.offset, r.target_offset) for r in rows) == [(o, i) for i, o in enumerate(offsets)]


def test_hot_partition_translation_matches_brute_force(spark):
    log = _hot_log(spark)
    offsets = sorted(r.offset for r in log.select("offset").collect())
    top = offsets[-1]
    points = [0, 1, offsets[0], offsets[0] + 1, top // 7, top // 3, top // 2, top, top + 1, top + 5000]
    commits = spark.createDataFrame([(f"g{i % 4}", "hot", 0, c) for i, c in enumerate(points)],
                                    "consumer_group string, topic string, partition int, committed bigint")
    got = {(r.consumer_group, r.committed): r.new_offset
           for r in ops.translate_offsets(log, commits, bucket_span=1024).collect()}
    want = {(f"g{i % 4}", c): bisect.bisect_left(offsets, c) for i, c in enumerate(points)}
    assert got == want


def test_restore_publishes_then_returns_the_plan(spark, scratch):
    from tidemark.plans import restore
    log = tv.events_log(spark, SF_SMALL)
    ends = ops.end_offsets(log)
    path = os.path.join(scratch, "snap")
    backup(log, tv.nation_commits(spark, SF_SMALL, ends), path)
    sent = []

    def sink(frame):  # stands in for write_kafka
        out = os.path.join(scratch, f"sent-{len(sent)}")
        frame.write.parquet(out)
        sent.append(out)

    plan = restore(spark, path, sink, topics=["click"], wave_messages=20)
    assert len(sent) > 2 and spark.read.parquet(*sent).count() == log.where("topic = 'click'").count()
    assert plan.count() > 0 and {r.topic for r in plan.select("topic").distinct().collect()} == {"click"}


def test_restore_failure_gives_no_plan(spark, scratch):
    import pytest
    from tidemark.plans import restore
    log = tv.events_log(spark, SF_SMALL)
    path = os.path.join(scratch, "snap")
    backup(log, tv.nation_commits(spark, SF_SMALL, ops.end_offsets(log)), path)

    def failing(frame):
        raise RuntimeError("broker unavailable")

    with pytest.raises(RuntimeError):
        restore(spark, path, failing)


def test_target_that_does_not_match_gives_no_plan(spark, scratch):
    import pytest
    from tidemark.plans import TargetMismatchError, restore
    from tidemark.schemas import ENDS
    log = tv.events_log(spark, SF_SMALL).where("topic = 'click'")
    path = os.path.join(scratch, "snap")
    backup(log, tv.nation_commits(spark, SF_SMALL, ops.end_offsets(log)), path)
    counts = [(r.topic, r.partition, r.messages) for r in ops.partition_counts(log).collect()]

    def run(sent_twice):
        calls = []

        def target():       # 10 older messages a partition; after the sends, what was sent
            calls.append(1)
            grown = 0 if len(calls) == 1 else 1
            return spark.createDataFrame([(t, p, 3, 13 + grown * (n + (p == sent_twice))) for t, p, n in counts], ENDS)

        return restore(spark, path, lambda f: f.count(), target_ends=target)

    assert run(None).count() > 0
    with pytest.raises(TargetMismatchError) as e:
        run(2)
    assert [(r.partition, r.grown - r.published) for r in e.value.rows] == [(2, 1)]


def test_null_topics_and_partitions_keep_their_places(spark):
    rows = [(None, 0, 5), (None, 0, 3), ("t", None, 9), ("t", None, 1), ("t", 0, 4)]
    log = spark.createDataFrame(rows, "topic string, partition int, offset bigint").withColumns(
        {"key": F.lit(b"k"), "value": F.lit(b"v")})
    got = {(r.topic, r.partition, r.offset): r.target_offset for r in ops.with_target_offsets(log, 4).collect()}
    assert got == {(None, 0, 3): 0, (None, 0, 5): 1, ("t", None, 1): 0, ("t", None, 9): 1, ("t", 0, 4): 0}
