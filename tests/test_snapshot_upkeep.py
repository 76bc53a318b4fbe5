"""Merged increments, verified reads, counts from the state."""
import glob
import os

import pytest

from builders import commits_df, messages
from tidemark.plans import backup, snapshot_report
from tidemark.operators import end_offsets
from tidemark.sinks import snapshot as sink
from tidemark.sinks.snapshot import held_ends, merge_increments, remove_replaced, write_increment
from tidemark.sources.snapshot import (DamagedSnapshotError, damaged_partitions, read_commits, read_counts, read_messages,
                                       verified_messages)


def _many(spark, path, n=5):
    log = messages(spark, "t", 0, range(0, 10 * n, 2)).unionByName(messages(spark, "u", 1, range(10 * n)))
    for k in range(n):
        backup(log.where(f"offset < {10 * (k + 1)}"), commits_df(spark, [("g", "t", 0, k)]), path, mode="append")
    return log


def test_merge_keeps_rows_commits_and_coverage(spark, scratch):
    path = os.path.join(scratch, "snap")
    log = _many(spark, path)
    before = sorted(map(str, read_messages(spark, path).collect()))
    names = merge_increments(spark, path)
    assert len(names) == 5 and sink.read_state(spark, path).where("own").count() == 1
    assert sorted(map(str, read_messages(spark, path).collect())) == before
    assert [r.committed for r in read_commits(spark, path).collect()] == [4]
    assert {r.status for r in snapshot_report(spark, path, end_offsets(log)).collect()} == {"done"}
    assert damaged_partitions(spark, path).count() == 0
    assert remove_replaced(spark, path) == names
    assert len(glob.glob(f"{path}/messages/increment=*")) == 1
    assert sorted(map(str, verified_messages(spark, path).collect())) == before
    # later increments are merged again, and commits keep their order
    backup(log.unionByName(messages(spark, "t", 0, [999])), commits_df(spark, [("g", "t", 0, 9)]), path, mode="append")
    assert len(merge_increments(spark, path)) == 2
    assert [r.committed for r in read_commits(spark, path).collect()] == [9]
    assert read_messages(spark, path).count() == len(before) + 1 and merge_increments(spark, path) == []


def test_a_merge_that_dies_changes_nothing(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "snap")
    _many(spark, path, 3)
    before = sorted(map(str, read_messages(spark, path).collect()))

    def dies(*_, **__):
        raise RuntimeError("lost")

    for step in ("write_offsets", "write_commits", "write_state"):
        monkeypatch.setattr(sink, step, dies)
        with pytest.raises(RuntimeError):
            merge_increments(spark, path)
        monkeypatch.undo()
        assert sorted(map(str, read_messages(spark, path).collect())) == before
        assert sink.read_state(spark, path).where("own").count() == 3


def test_only_small_increments_are_merged(spark, scratch):
    path = os.path.join(scratch, "snap")
    write_increment(messages(spark, "t", 0, range(100)), path)
    for k in range(3):
        write_increment(messages(spark, "t", 0, [200 + k]), path, mode="append")
    assert len(merge_increments(spark, path, below=10)) == 3
    assert sink.read_state(spark, path).where("own").count() == 2
    assert [tuple(r) for r in held_ends(spark, path).collect()] == [("t", 0, 0, 203)]


def test_damage_is_named(spark, scratch):
    path = os.path.join(scratch, "snap")
    log = messages(spark, "t", 0, range(20)).unionByName(messages(spark, "t", 1, range(7, 27))).unionByName(messages(spark, "v", 2, range(5)))
    write_increment(log, path)
    assert verified_messages(spark, path).count() == 45
    a, b, c = (glob.glob(f"{path}/messages/*/{p}/*.parquet") for p in ("topic=t/partition=0", "topic=t/partition=1", "topic=v/partition=2"))
    # two partitions' files swapped (as many rows, other contents), a file lost
    with open(a[0], "rb") as f, open(b[0], "rb") as g:
        one, two = f.read(), g.read()
    for name, data in ((a[0], two), (b[0], one)):
        with open(name, "wb") as f:
            f.write(data)
    for crc in glob.glob(f"{path}/messages/*/*/*/.*.crc"):
        with open(crc.replace("/.", "/").removesuffix(".crc"), "rb"):
            os.unlink(crc)
    os.unlink(c[0])
    with pytest.raises(DamagedSnapshotError, match=r"t\[0\].*other content") as e:
        verified_messages(spark, path)
    assert sorted((r.topic, r.partition, r.found) for r in e.value.rows) == [("t", 0, 20), ("t", 1, 20), ("v", 2, 0)]
    # a file cut short cannot be read: the error names it
    with open(a[0], "wb") as f:
        f.write(two[: len(two) // 2])
    with pytest.raises(ValueError, match="cannot be read: .*partition=0"):
        verified_messages(spark, path)


def test_counts_come_from_the_state(spark, scratch):
    path = os.path.join(scratch, "snap")
    write_increment(messages(spark, "t", 0, [1, 1, 2]), path)
    write_increment(messages(spark, "t", 0, [5]), path, mode="append")
    counts = read_counts(spark, path)
    assert [tuple(r) for r in counts.collect()] == [("t", 0, 4, 3)]
    assert "/messages" not in counts._jdf.queryExecution().executedPlan().toString()


def test_two_increments_with_one_number_are_told_apart(spark, scratch):
    path = os.path.join(scratch, "snap")
    write_increment(messages(spark, "t", 0, [1]), path, commits_df(spark, [("g", "t", 0, 1)]), increment="b")
    sink.write_commits(commits_df(spark, [("g", "t", 0, 7)]), path, "a")
    sink.write_state(spark, path, "a", seq=0, has_commits=True)
    assert [r.committed for r in read_commits(spark, path).collect()] == [1]
