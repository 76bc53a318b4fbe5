import random

import pytest
from pyspark.sql import functions as F

from builders import commits_df, log_df, messages
from tidemark.operators import translate_offsets, with_target_offsets

SPANS = [1, 2, 7, 64, 1 << 16]
# fixed values: offsets and the positions they must translate to
GOLDEN_OFFSETS = [0, 99, 100, 200, 499]


@pytest.mark.parametrize("span", SPANS)
def test_single_partition_golden(spark, span):
    log = messages(spark, "topic_1", 1, GOLDEN_OFFSETS)
    cases = {100: 2, 1: 1, 500: 5, 600: 5, 0: 0}
    commits = commits_df(spark, [(f"g{c}", "topic_1", 1, c) for c in cases])
    got = {r.committed: r.new_offset for r in translate_offsets(log, commits, bucket_span=span).collect()}
    assert got == cases


@pytest.mark.parametrize("span", SPANS)
def test_several_partitions_golden(spark, span):
    offsets = [1, 99, 101, 199, 499]
    log = messages(spark, "topic_1", 0, offsets)
    for p in (1, 2, 3):
        log = log.unionByName(messages(spark, "topic_1", p, offsets))
    commits = commits_df(spark, [("group_1", "topic_1", 0, 100), ("group_1", "topic_1", 1, 200),
                                 ("group_1", "topic_1", 2, 500), ("group_1", "topic_1", 3, 505),
                                 ("group_1", "topic_9", 0, 5)])
    got = sorted((r.partition, r.new_offset) for r in translate_offsets(log, commits, bucket_span=span).collect())
    assert got == [(0, 2), (1, 4), (2, 5), (3, 5)]


def _random_case(seed):
    rnd = random.Random(seed)
    rows, commits = [], []
    for t in ("a", "b"):
        for p in range(4):
            n = rnd.choice([0, 1, 5, 40, 200])
            offs = sorted(rnd.sample(range(0, 3000), n))
            rows += [(t, p, o, "k", "v", 1, None) for o in offs]
            for g in range(rnd.randint(0, 6)):
                commits.append((f"g{g}", t, p, rnd.choice([0, 1, 2999, 3000, 5000, rnd.randint(0, 3100)])))
    return rows, commits


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_translate_matches_brute_force(spark, seed):
    rows, commits = _random_case(seed)
    log, cdf = log_df(spark, rows), commits_df(spark, commits)
    by_part = {}
    for t, p, o, *_ in rows:
        by_part.setdefault((t, p), []).append(o)
    expected = sorted((g, t, p, c, sum(1 for o in by_part[(t, p)] if o < c))
                      for g, t, p, c in commits if (t, p) in by_part)
    for span in (3, 50, 1 << 16):
        got = sorted(tuple(r) for r in translate_offsets(log, cdf, bucket_span=span).collect())
        assert got == expected, span


@pytest.mark.parametrize("seed", [4, 5])
def test_target_offsets_are_ranks(spark, seed):
    rows, _ = _random_case(seed)
    log = log_df(spark, rows)
    expected = {}
    by_part = {}
    for t, p, o, *_ in rows:
        by_part.setdefault((t, p), []).append(o)
    for key, offs in by_part.items():
        for i, o in enumerate(sorted(offs)):
            expected[(*key, o)] = i
    for span in (1, 16, 1 << 16):
        got = {(r.topic, r.partition, r.offset): r.target_offset
               for r in with_target_offsets(log, span).select("topic", "partition", "offset", "target_offset").collect()}
        assert got == expected, span


def test_translation_is_min_target_at_or_after_commit(spark):
    # property: new offset = target offset of the first message at/after the commit, else n
    rows, commits = _random_case(7)
    log, cdf = log_df(spark, rows), commits_df(spark, commits)
    targets = with_target_offsets(log, 8)
    plan = translate_offsets(log, cdf, bucket_span=8)
    n = targets.groupBy("topic", "partition").agg(F.count("*").alias("n"))
    first = (plan.join(targets, ["topic", "partition"])
             .where(F.col("offset") >= F.col("committed"))
             .groupBy("consumer_group", "topic", "partition", "committed")
             .agg(F.min("target_offset").alias("first")))
    check = (plan.join(first, ["consumer_group", "topic", "partition", "committed"], "left").join(n, ["topic", "partition"])
             .select(F.coalesce("first", "n").alias("want"), "new_offset").collect())
    assert all(r.want == r.new_offset for r in check)


def test_empty_inputs(spark):
    log = messages(spark, "t", 0, [1, 2, 3])
    assert translate_offsets(log, commits_df(spark, [])).count() == 0
    assert translate_offsets(messages(spark, "t", 0, []), commits_df(spark, [("g", "t", 0, 5)])).count() == 0


def test_plain_forms_agree_with_bucketed(spark):
    """The two plain forms (join + count, union + running window), written here as
    small-fixture oracles only, agree with the bucketed operator."""
    from pyspark.sql import Window

    from conftest import SF_SMALL
    from tidemark import operators as ops
    from tidemark.sources import tables as tv

    log = tv.events_log(spark, SF_SMALL)
    ends = ops.end_offsets(log)
    commits = ops.capture_commits(tv.nation_commits(spark, SF_SMALL, ends), ends)
    keys = ["consumer_group", "topic", "partition", "committed"]
    form_a = (log.select("topic", "partition", "offset").join(commits, ["topic", "partition"])
              .groupBy(*keys).agg(F.count_if(F.col("offset") < F.col("committed")).alias("new_offset")))
    marks = (log.select("topic", "partition", "offset", F.lit(1).alias("is_msg"), F.lit(None).cast("string").alias("g"))
             .unionByName(commits.select("topic", "partition", F.col("committed").alias("offset"),
                                         F.lit(0).alias("is_msg"), F.col("consumer_group").alias("g"))))
    w = Window.partitionBy("topic", "partition").orderBy("offset", "is_msg").rowsBetween(Window.unboundedPreceding, 0)
    form_b = (marks.withColumn("new_offset", F.sum("is_msg").over(w)).where("is_msg = 0")
              .select(F.col("g").alias("consumer_group"), "topic", "partition", F.col("offset").alias("committed"),
                      "new_offset"))
    bucketed = ops.translate_offsets(log, commits, bucket_span=64)
    rows = [sorted(tuple(r) for r in df.select(*keys, "new_offset").collect()) for df in (form_a, form_b, bucketed)]
    assert rows[0] == rows[1] == rows[2] and rows[0]
