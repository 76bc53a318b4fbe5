import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from builders import log_df
from tidemark.operators import duplicate_offsets, guard_null_keys, latest_per_offset, null_keys, null_topic_commits
from builders import commits_df


def _log(spark):
    return log_df(spark, [("t", 0, 1, "k", "a", 5, None), ("t", 0, 1, "k", "b", 9, None),
                          ("t", 0, 2, None, "c", 1, None), ("t", 1, 1, "k", "d", 1, None)])


def test_null_keys_and_guard(spark):
    log = _log(spark)
    assert [(r.partition, r.offset) for r in null_keys(log).collect()] == [(0, 2)]
    assert guard_null_keys(log, "keep").count() == 4
    with pytest.raises(Exception) as err:
        guard_null_keys(log, "error").collect()
    assert "null key" in str(err.value)


def test_duplicates_and_latest(spark):
    log = _log(spark)
    assert [tuple(r) for r in duplicate_offsets(log).collect()] == [("t", 0, 1, 2)]
    latest = {(r.partition, r.offset): bytes(r.value) for r in latest_per_offset(log).collect()}
    assert latest == {(0, 1): b"b", (0, 2): b"c", (1, 1): b"d"}


def test_null_topic_commits(spark):
    df = commits_df(spark, [("g", None, 0, 1), ("g", "t", 0, 1)])
    assert null_topic_commits(df).count() == 1
