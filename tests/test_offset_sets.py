"""Offset sets against plain Python sets."""
import os
import random

from builders import commits_df, messages
from tidemark.operators.offset_sets import SPAN, merged_ranges, merged_sets, missing_ranges, offset_sets, outside, uncovered
from tidemark.plans import backup
from tidemark.plans.backup import after_snapshot
from tidemark.schemas import ENDS
from tidemark.sinks.snapshot import held_offsets, write_increment

RANGES = "topic string, partition int, low bigint, high bigint"


def _log(spark, rows):
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint")


def _runs(missing):
    out = []
    for o in sorted(missing):
        if out and out[-1][1] == o:
            out[-1][1] = o + 1
        else:
            out.append([o, o + 1])
    return [tuple(r) for r in out]


def test_sets_merge_test_and_count(spark):
    rnd = random.Random(5)
    held = {o for _ in range(300) for o in [rnd.randrange(-3 * SPAN, 3 * SPAN)]} | set(range(SPAN, 2 * SPAN)) | {-SPAN - 1, -1, 0, 9 * 10 ** 15}
    one, two = ([("t", 1, o) for o in held if (o % 3 == 0) == first] for first in (True, False))
    sets = merged_sets(offset_sets(_log(spark, one)).unionByName(offset_sets(_log(spark, two + two[:5])))).cache()
    assert sum(r.n for r in sets.collect()) == len(held)
    assert [r.n for r in sets.where("bits is null").collect()] == [SPAN]      # a full bucket keeps no bits
    asked = sorted({o + d for o in held for d in (-1, 0, 1)})
    for bound in (10 ** 6, 0):      # broadcast, and dealt by bucket
        got = outside(_log(spark, [("t", 1, o) for o in asked] + [("t", 2, 5)]), sets, bound)
        assert sorted(r.offset for r in got.where("partition = 1").collect()) == [o for o in asked if o not in held]
        assert got.where("partition = 2").count() == 1


def test_missing_ranges_match_plain_sets(spark):
    rnd = random.Random(8)
    held = set(range(SPAN - 20, SPAN + 20)) | {rnd.randrange(0, 5 * SPAN) for _ in range(200)} - {5, 6}
    low, high = -7, 5 * SPAN + 3
    covered = [(10, 40), (30, 900), (2 * SPAN, 4 * SPAN + 1), (4 * SPAN + 1, 4 * SPAN + 9)]
    ranges = spark.createDataFrame([("t", 0, a, b) for a, b in covered] + [("u", 0, 0, 9)], RANGES)
    expected = spark.createDataFrame([("t", 0, low, high), ("v", 3, 0, 2 * SPAN)], RANGES)
    left = uncovered(expected, ranges)
    got = missing_ranges(left, merged_sets(offset_sets(_log(spark, [("t", 0, o) for o in held])))).collect()
    inside = {o for a, b in covered for o in range(a, b)}
    want = _runs(o for o in range(low, high) if o not in held and o not in inside)
    # runs that a covered range parts are two
    assert sorted((r.low, r.high) for r in got if r.topic == "t") == want
    assert [(r.topic, r.low, r.high) for r in got if r.topic != "t"] == [("v", 0, 2 * SPAN)]


def test_ranges_join_where_they_meet(spark):
    rows = [("t", 0, 0, 5), ("t", 0, 5, 7), ("t", 0, 9, 12), ("t", 0, 10, 11), ("t", 1, 3, 3)]
    got = merged_ranges(spark.createDataFrame(rows, RANGES)).collect()
    assert sorted((r.low, r.high) for r in got) == [(0, 7), (9, 12)]


def test_append_to_a_gapped_log_reads_no_messages(spark, scratch):
    """Transactions leave a gap behind every message: the sets of the state tell all."""
    path = os.path.join(scratch, "snap")
    first = messages(spark, "t", 0, range(0, 2000, 2)).unionByName(messages(spark, "t", 1, range(50)))
    backup(first, commits_df(spark, []), path)
    ranges, sets = held_offsets(spark, path)
    assert ranges.count() == 1 and sets.count() == 1
    log = first.unionByName(messages(spark, "t", 0, [1, 7, 2000, 70_001])).unionByName(messages(spark, "u", 0, [4]))
    fresh = after_snapshot(spark, log, path)
    assert "/messages" not in fresh._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.topic, r.offset) for r in fresh.collect()) == [("t", 1), ("t", 7), ("t", 2000), ("t", 70_001), ("u", 4)]
    assert backup(log, commits_df(spark, []), path, mode="append").messages == 5
    assert backup(log, commits_df(spark, []), path, mode="append").messages == 0


def test_a_stopped_stream_is_not_done(spark, scratch):
    from tidemark.plans import snapshot_complete, snapshot_missing, snapshot_report
    path = os.path.join(scratch, "snap")
    write_increment(messages(spark, "t", 0, [*range(6), *range(100, 111)]), path)
    ends = spark.createDataFrame([("t", 0, 0, 111), ("t", 1, 0, 4)], ENDS)
    assert [(r.status, r.remaining) for r in snapshot_report(spark, path, ends).orderBy("partition").collect()] == [
        ("remaining", 94), ("not_consumed", None)]
    assert [(r.low, r.high) for r in snapshot_missing(spark, path, ends).collect()] == [(6, 100)]
    assert snapshot_complete(spark, path, ends).first().complete is False
    # a batch that reads the log up to its end vouches for the rest, gaps and all
    backup(messages(spark, "t", 0, [*range(6), 50, *range(100, 111)]), commits_df(spark, []), path, mode="append")
    assert [(r.status, r.remaining) for r in snapshot_report(spark, path, ends.where("partition = 0")).collect()] == [("done", 0)]
