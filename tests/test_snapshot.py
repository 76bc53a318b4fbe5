import os

import pytest
from pyspark.sql import functions as F

from builders import commits_df, log_df, messages
from tidemark.plans import MissingTopicsError, backup, restore_plan
from tidemark.sinks.snapshot import SnapshotExistsError, held_ends, write_increment, write_messages
from tidemark.sources.snapshot import IncompleteSnapshotError, read_commits, read_messages, read_partition


def _fixture(spark):
    commits = commits_df(spark, [("group_1", "topic_1", 0, 10), ("group_1", "topic_2", 0, 1)])
    log = (log_df(spark, [("topic_1", 0, 0, "k", "payload", 1_600_000_000_123, None)])
           .unionByName(log_df(spark, [("topic_1", 1, 0, "k", "payload", 1_600_000_000_123, None)]))
           .unionByName(log_df(spark, [("topic_2", 0, 0, "k", "payload", 1_600_000_000_123, [("h", b"v")])])))
    return log, commits


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_round_trip_golden(spark, scratch):
    log, commits = _fixture(spark)
    path = os.path.join(scratch, "snap")
    write_increment(log, path, commits)
    increment, = [n for n in os.listdir(os.path.join(path, "messages")) if n.startswith("increment=")]
    folders = sorted(n for n in os.listdir(os.path.join(path, "messages", increment)) if n.startswith("topic="))
    assert folders == ["topic=topic_1", "topic=topic_2"]
    back_commits, back_log = read_commits(spark, path), read_messages(spark, path)
    assert _same(back_log, log) and _same(back_commits, commits)


def test_topic_read_prunes_folders(spark, scratch):
    log, commits = _fixture(spark)
    path = os.path.join(scratch, "snap")
    write_increment(log, path, commits)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = read_messages(spark, path, ["topic_2"])
    assert [r.topic for r in df.collect()] == ["topic_2"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "topic_2" in plan
    assert [r.topic for r in read_commits(spark, path, ["topic_2"]).collect()] == ["topic_2"]


def test_numeric_looking_topic_stays_text(spark, scratch):
    log = messages(spark, "007", 3, [1, 2])
    path = os.path.join(scratch, "snap")
    write_increment(log, path, commits_df(spark, []))
    assert {r.topic for r in read_messages(spark, path).collect()} == {"007"}


def test_backup_checks_topics_before_writing(spark, scratch):
    log, commits = _fixture(spark)
    path = os.path.join(scratch, "snap")
    with pytest.raises(MissingTopicsError):
        backup(log, commits, path, topics=["topic_1", "nope"])
    assert not os.path.exists(path)
    backup(log, commits, path, topics=["topic_1", "nope"], ignore_missing_topics=True)
    assert {r.topic for r in read_messages(spark, path).collect()} == {"topic_1"}
    assert [tuple(r) for r in read_commits(spark, path).collect()] == [("group_1", "topic_1", 0, 10)]
    with pytest.raises(SnapshotExistsError):
        backup(log, commits, path)  # a second backup into the same folder is refused


def test_backup_null_key_fails(spark, scratch):
    log = log_df(spark, [("t", 0, 0, None, "v", 1, None)])
    with pytest.raises(Exception):
        backup(log, commits_df(spark, []), os.path.join(scratch, "snap"))


def test_backup_cuts_at_given_ends_and_restores(spark, scratch):
    from tidemark.schemas import ENDS
    log = messages(spark, "t", 0, [0, 99, 100, 200, 499, 600])
    ends = spark.createDataFrame([("t", 0, 0, 500)], ENDS)
    commits = commits_df(spark, [("g", "t", 0, 100), ("g", "t", 1, 3), ("h", "t", 0, 600)])
    path = os.path.join(scratch, "snap")
    backup(log, commits, path, ends=ends)
    rows, plan = restore_plan(spark, path)
    assert [(r.offset, r.target_offset) for r in rows.orderBy("offset").collect()] == [
        (0, 0), (99, 1), (100, 2), (200, 3), (499, 4)]
    assert sorted((r.consumer_group, r.new_offset) for r in plan.collect()) == [("g", 2), ("h", 5)]


def test_append_writes_only_new_offsets(spark, scratch):
    from tidemark.schemas import ENDS
    log = messages(spark, "t", 0, [0, 1, 2, 3, 4, 5]).unionByName(messages(spark, "u", 0, [7, 8]))
    commits = commits_df(spark, [("g", "t", 0, 3)])
    path = os.path.join(scratch, "snap")
    backup(log, commits, path, ends=spark.createDataFrame([("t", 0, 0, 3)], ENDS))
    backup(log, commits, path, mode="append")
    backup(log, commits, path, mode="append")  # nothing new: nothing written
    got = sorted((r.topic, r.offset) for r in read_messages(spark, path).collect())
    assert got == [("t", 0), ("t", 1), ("t", 2), ("t", 3), ("t", 4), ("t", 5), ("u", 7), ("u", 8)]
    assert read_commits(spark, path).count() == 1


def test_backup_of_only_missing_topics_is_empty(spark, scratch):
    log, commits = _fixture(spark)
    path = os.path.join(scratch, "snap")
    result = backup(log, commits, path, topics=["nope"], ignore_missing_topics=True)
    assert result.topics == []
    assert read_messages(spark, path).count() == 0 and read_commits(spark, path).count() == 0
    rows, plan = restore_plan(spark, path)
    assert rows.count() == 0 and plan.count() == 0


def test_write_without_clustering_for_grouped_input(spark, scratch):
    from conftest import SF_SMALL
    from tidemark.sources import tables as tv
    first = os.path.join(scratch, "a")
    log = tv.events_log(spark, SF_SMALL)
    write_increment(log, first)
    # a snapshot is grouped by partition already: copy it without a shuffle
    copy = read_messages(spark, first)
    plan = copy.sortWithinPartitions("topic", "partition", "offset")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    second = os.path.join(scratch, "b")
    write_increment(copy, second, cluster=False)
    back = read_messages(spark, second)
    assert back.exceptAll(log).count() == 0 and log.exceptAll(back).count() == 0


def test_folders_without_a_complete_increment_are_refused(spark, scratch):
    path = os.path.join(scratch, "snap")
    with pytest.raises(IncompleteSnapshotError):
        read_messages(spark, path)
    write_messages(messages(spark, "t", 0, [1, 2]), path, "died-here")      # no commits, no state
    for read in (read_messages, read_commits):
        with pytest.raises(IncompleteSnapshotError):
            read(spark, path)


def test_a_failed_increment_leaves_the_snapshot_as_it_was(spark, scratch, monkeypatch):
    import tidemark.sinks.snapshot as sink
    path = os.path.join(scratch, "snap")
    backup(messages(spark, "t", 0, [0, 1]), commits_df(spark, [("g", "t", 0, 1)]), path)

    def fails(*_):
        raise RuntimeError("lost")

    more = messages(spark, "t", 0, [0, 1, 2])
    monkeypatch.setattr(sink, "write_commits", fails)
    with pytest.raises(RuntimeError):
        backup(more, commits_df(spark, [("g", "t", 0, 3)]), path, mode="append")
    monkeypatch.undo()
    assert read_messages(spark, path).count() == 2
    assert [r.committed for r in read_commits(spark, path).collect()] == [1]
    # an overwrite that dies leaves no snapshot, rather than new messages with old commits
    monkeypatch.setattr(sink, "write_commits", fails)
    with pytest.raises(RuntimeError):
        backup(more, commits_df(spark, []), path, mode="overwrite")
    monkeypatch.undo()
    with pytest.raises(IncompleteSnapshotError):
        read_commits(spark, path)
    backup(more, commits_df(spark, [("g", "t", 0, 3)]), path, mode="append")
    assert read_messages(spark, path).count() == 3


def test_writing_an_increment_again_replaces_it(spark, scratch):
    path = os.path.join(scratch, "snap")
    write_increment(messages(spark, "t", 0, [0, 1]), path, increment="a")
    write_increment(messages(spark, "t", 0, [2, 3]), path, mode="append", increment="b")
    write_increment(messages(spark, "t", 0, [2, 3, 4]), path, mode="append", increment="b")
    assert sorted(r.offset for r in read_messages(spark, path).collect()) == [0, 1, 2, 3, 4]
    assert [tuple(r) for r in held_ends(spark, path).collect()] == [("t", 0, 0, 5)]


def test_append_does_not_read_old_messages(spark, scratch):
    from tidemark.plans.backup import after_snapshot
    path = os.path.join(scratch, "snap")
    backup(messages(spark, "t", 0, [0, 1]), commits_df(spark, []), path)
    plan = after_snapshot(spark, messages(spark, "t", 0, [1, 2]), path)._jdf.queryExecution().executedPlan().toString()
    assert "/messages" not in plan


def test_partition_read_is_in_order_over_many_files(spark, scratch):
    path = os.path.join(scratch, "snap")
    offsets = [i * 7919 % 4001 for i in range(4000)]
    log = messages(spark, "t", 0, offsets).unionByName(messages(spark, "t", 1, [5]))
    write_increment(log.repartition(6), path, file_span=100, num_partitions=8)
    got = [r.offset for r in read_partition(spark, path, "t", 0).collect()]
    assert got == sorted(offsets)


def test_report_of_chosen_topics(spark, scratch):
    from tidemark.operators import end_offsets
    from tidemark.plans import snapshot_complete, snapshot_report
    log = messages(spark, "t", 0, [0, 1]).unionByName(messages(spark, "u", 0, [0, 5]))
    path = os.path.join(scratch, "snap")
    result = backup(log, commits_df(spark, []), path, topics=["t"])
    assert [(r.topic, r.status) for r in snapshot_report(spark, path, end_offsets(log), ["t"]).collect()] == [("t", "done")]
    assert snapshot_complete(spark, path, end_offsets(log), ["t"]).first().complete
    assert {(r.topic, r.status) for r in snapshot_report(spark, path, end_offsets(log)).collect()} == {("t", "done"), ("u", "not_consumed")}
    assert [(r.topic, r.status) for r in result.report().collect()] == [("t", "done")]


def test_restore_of_missing_topics(spark, scratch):
    path = os.path.join(scratch, "snap")
    backup(messages(spark, "t", 0, [0, 1]), commits_df(spark, [("g", "t", 0, 1)]), path)
    with pytest.raises(MissingTopicsError):
        restore_plan(spark, path, topics=["t", "nope"])
    rows, plan = restore_plan(spark, path, topics=["t", "nope"], ignore_missing_topics=True)
    assert rows.count() == 2 and plan.count() == 1
    rows, plan = restore_plan(spark, path, topics=["nope"], ignore_missing_topics=True)
    assert rows.count() == 0 and plan.count() == 0


def test_backup_reports_messages_written(spark, scratch):
    log = messages(spark, "t", 0, [0, 1, 2, 3, 4])
    result = backup(log, commits_df(spark, []), os.path.join(scratch, "snap"))
    assert result.messages == 5
