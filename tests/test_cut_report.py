from builders import log_df, messages
from tidemark.operators import consumption_complete, consumption_report, cut, end_offsets
from tidemark.schemas import ENDS


def _ends(spark, rows):
    return spark.createDataFrame(rows, ENDS)


def test_end_offsets(spark):
    log = messages(spark, "t", 0, [3, 5, 9]).unionByName(messages(spark, "t", 1, [0]))
    got = sorted(tuple(r) for r in end_offsets(log).collect())
    assert got == [("t", 0, 3, 10), ("t", 1, 0, 1)]


def test_cut_is_strict_and_drops_unknown_and_empty(spark):
    log = (messages(spark, "t", 0, [0, 1, 2, 3, 4]).unionByName(messages(spark, "t", 1, [0, 1]))
           .unionByName(messages(spark, "t", 2, [7])).unionByName(messages(spark, "u", 0, [0])))
    ends = _ends(spark, [("t", 0, 0, 3), ("t", 1, 0, 10), ("t", 2, 7, 7), ("u", 0, 0, None)])
    got = sorted((r.topic, r.partition, r.offset) for r in cut(log, ends).collect())
    assert got == [("t", 0, 0), ("t", 0, 1), ("t", 0, 2), ("t", 1, 0), ("t", 1, 1)]


def test_cut_without_broadcast_gives_same_rows(spark):
    log = messages(spark, "t", 0, list(range(20)))
    ends = _ends(spark, [("t", 0, 0, 12)])
    assert cut(log, ends, max_broadcast_rows=0).count() == 12


def test_report_statuses(spark):
    ends = _ends(spark, [("t", 0, 0, 10), ("t", 1, 0, 5), ("t", 2, 0, 4), ("t", 3, 4, 4)])
    consumed = messages(spark, "t", 0, [0, 1, 2, 3]).unionByName(messages(spark, "t", 1, [0, 2, 4]))
    rep = {r.partition: (r.status, r.remaining, r.last_read) for r in consumption_report(ends, consumed).collect()}
    assert rep == {0: ("remaining", 6, 3), 1: ("done", 0, 4), 2: ("not_consumed", None, None)}
    row = consumption_complete(consumption_report(ends, consumed)).first()
    assert (row.complete, row.partitions, row.done_partitions) == (False, 3, 1)


def test_complete_when_nothing_to_read(spark):
    ends = _ends(spark, [("t", 0, 4, 4)])
    row = consumption_complete(consumption_report(ends, messages(spark, "t", 0, []))).first()
    assert row.complete is True and row.partitions == 0
