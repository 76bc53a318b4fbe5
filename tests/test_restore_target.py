"""Waves of equal size, and plans in the offsets of a target that is read back."""
import os

import pytest
from pyspark.sql import functions as F

from builders import commits_df, messages
from tidemark.operators import end_offsets
from tidemark.plans import UndeliveredError, backup, delivered, publish_waves, restore, translate_to_target, undelivered, wave_plan
from tidemark.plans.publish import OFFSET_HEADER, publish_frame
from tidemark.schemas import ENDS, LOG


def test_waves_follow_the_messages_not_the_offsets(spark):
    far = 9 * 10 ** 11
    log = messages(spark, "t", 0, range(10)).unionByName(messages(spark, "t", 1, range(far, far + 10))).unionByName(
        messages(spark, "u", 0, [0, far, 2 * far])).cache()
    plan = wave_plan(log, 4).collect()
    assert max(r.wave for r in plan) <= 4 and sum(r.messages for r in plan) == 23
    frames = list(publish_waves(log, wave_messages=4, keep_offset=True))
    assert len(frames) <= 5
    rows = [(w, r.topic, r.partition, r.offset) for w, f in enumerate(frames) for r in f.collect()]
    assert len(rows) == 23
    last = {}
    for w, t, p, o in sorted(rows):
        assert last.get((t, p), -1) < o
        last[t, p] = o
    assert list(publish_waves(log.limit(0))) == []
    with pytest.raises(ValueError):
        wave_plan(log, 0)


def _as_target(spark, frame, places):
    """The published rows at given target offsets: {(topic, partition, source offset): [target offsets]}."""
    rows = [(r.topic, r.partition, at, r.key, r.value, None, r.headers) for r in frame.collect() for at in places[r.topic, r.partition, r.offset]]
    return spark.createDataFrame(rows, LOG)


def test_plan_in_a_target_with_a_base_and_repeats(spark):
    log = messages(spark, "t", 0, [5, 9, 12, 40]).unionByName(messages(spark, "t", 1, [3]))
    frame = publish_frame(log, keep_offset=True, offset_header=OFFSET_HEADER)
    # base 7; the task sent 5 and 9, was retried, and sent all four; an earlier restore left offset 9 at 2
    places = {("t", 0, 5): [7, 9], ("t", 0, 9): [2, 8, 10], ("t", 0, 12): [11], ("t", 0, 40): [12], ("t", 1, 3): [0]}
    target = _as_target(spark, frame, places)
    before = spark.createDataFrame([("t", 0, 0, 7)], ENDS)
    found = delivered(target, before)
    assert sorted((r.partition, r.offset, r.target_offset, r.copies) for r in found.collect()) == [
        (0, 5, 9, 2), (0, 9, 10, 2), (0, 12, 11, 1), (0, 40, 12, 1), (1, 3, 0, 1)]
    commits = commits_df(spark, [("g", "t", 0, c) for c in (0, 5, 6, 9, 10, 12, 40, 41, 99)] + [("h", "t", 1, 3), ("h", "gone", 0, 1)])
    plan = {(r.consumer_group, r.committed): r.new_offset for r in translate_to_target(found, commits, end_offsets(target)).collect()}
    assert plan == {("g", 0): 9, ("g", 5): 9, ("g", 6): 10, ("g", 9): 10, ("g", 10): 11, ("g", 12): 11, ("g", 40): 12, ("g", 41): 13,
                    ("g", 99): 13, ("h", 3): 0}
    assert undelivered(log, found).count() == 0
    assert [(r.partition, r.offset) for r in undelivered(log, delivered(target.where("offset <> 12"), before)).collect()] == [(0, 40)]


def test_restore_reads_the_target_back(spark, scratch):
    path = os.path.join(scratch, "snap")
    log = messages(spark, "t", 0, range(0, 60, 3))
    backup(log, commits_df(spark, [("g", "t", 0, 30), ("h", "t", 0, 60)]), path)

    def run(lose):
        sent = []

        def sink(frame):
            rows = frame.collect()
            sent.extend(rows[:3] + rows)        # every task is retried after three messages

        def target():
            rows = [(r.topic, r.partition, 100 + i, r.key, r.value, None, r.headers) for i, r in enumerate(sent) if i != lose]
            return spark.createDataFrame(rows, LOG)

        plan = restore(spark, path, sink, wave_messages=8, target_log=target, target_ends=lambda: spark.createDataFrame([("t", 0, 0, 100)], ENDS))
        return plan, sent

    plan, sent = run(None)
    value = {r.consumer_group: r.new_offset - 100 for r in plan.collect()}
    source = [int(bytes(h.value)) for r in sent for h in r.headers if h.key == OFFSET_HEADER]
    assert source[value["g"]] == 30 and sorted(set(source[value["g"]:])) == list(range(30, 60, 3)) and value["h"] == len(sent)
    with pytest.raises(UndeliveredError):
        run(len(sent) - 1)


def test_offset_header_does_not_double(spark):
    log = messages(spark, "t", 0, [4])
    twice = publish_frame(publish_frame(log, keep_offset=True, offset_header=OFFSET_HEADER).withColumn("timestamp", F.lit(None).cast("timestamp")),
                          offset_header=OFFSET_HEADER)
    assert [h.key for h in twice.first().headers].count(OFFSET_HEADER) == 1
