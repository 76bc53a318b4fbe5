import json

import pytest
from pyspark.sql import functions as F

from builders import commits_df, messages
from tidemark.functions.groups import is_ignored_group
from tidemark.operators import capture_commits, group_commits, partitions, translate_offsets
from tidemark.plans import starting_offsets

GROUP_CASES = [
    ("x-123e4567-e89b-12d3-a456-426614174000-y", True),
    ("123E4567-E89B-12D3-A456-426614174000", False),
    ("CG1", False),
    ("123e4567-e89b-12d3-a456-42661417", False),
]


def test_group_name_filter_golden(spark):
    df = spark.createDataFrame([(n,) for n, _ in GROUP_CASES], "consumer_group string")
    got = dict(df.select("consumer_group", is_ignored_group().alias("i")).collect())
    assert got == dict(GROUP_CASES)


def test_capture_filters_groups_sentinel_topics_and_partitions(spark):
    log = messages(spark, "Topic1", 1, [0, 50, 150]).unionByName(messages(spark, "Other", 0, [1]))
    raw = commits_df(spark, [
        ("CG1", "Topic1", 1, 100),
        ("CG1", "Topic1", 2, 7),            # partition not in the log
        ("CG2", "Topic1", 1, -1001),        # no committed offset
        ("x-123e4567-e89b-12d3-a456-426614174000", "Topic1", 1, 3),
        ("CG1", "Other", 0, 1),             # topic not chosen
    ])
    got = [tuple(r) for r in capture_commits(raw, partitions(log), topics=["Topic1"]).collect()]
    assert got == [("CG1", "Topic1", 1, 100)]


def test_group_commits_and_starting_offsets(spark):
    log = messages(spark, "b", 1, [0, 1, 2]).unionByName(messages(spark, "b", 0, [5])).unionByName(
        messages(spark, "a", 10, [0, 1]))
    raw = commits_df(spark, [("g", "b", 1, 2), ("g", "b", 0, 9), ("g", "a", 10, 1), ("h", "a", 10, 0)])
    plan = translate_offsets(log, raw)
    js = {r.consumer_group: r.starting_offsets for r in starting_offsets(plan).collect()}
    assert js["g"] == '{"a":{"10":1},"b":{"0":1,"1":2}}'
    assert json.loads(js["h"]) == {"a": {"10": 0}}
    grouped = {r.consumer_group: [tuple(x) for x in r.offsets] for r in group_commits(plan, "new_offset").collect()}
    assert grouped["g"] == [("a", 10, 1), ("b", 0, 1), ("b", 1, 2)]


def test_union_and_group_catalog(spark):
    from tidemark.operators import consumer_groups, union_commits
    a = commits_df(spark, [("CG1", "t", 0, 1)])
    b = commits_df(spark, [("x-123e4567-e89b-12d3-a456-426614174000", "t", 0, 2)]).select(
        "committed", "partition", "topic", "consumer_group")
    both = union_commits(a, b)
    assert both.columns == ["consumer_group", "topic", "partition", "committed"] and both.count() == 2
    assert dict(consumer_groups(both).collect()) == {"CG1": False, "x-123e4567-e89b-12d3-a456-426614174000": True}


def test_commit_triples(spark):
    from tidemark.plans import commit_triples
    plan = spark.createDataFrame([("g", "t", 0, 10, 3)],
                                 "consumer_group string, topic string, partition int, committed bigint, new_offset bigint")
    assert [tuple(r) for r in commit_triples(plan).collect()] == [("g", "t", 0, 3)]
