from collections import Counter

import pytest

from tidemark.llm import mixing


def docs_of(spark, n=400):
    rows = [(i, "x" * (10 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(n)]
    rows += [(None, "null id", "big"), (1, "again", "big"), (n + 1, None, "empty"), (n + 2, "", "empty"), (n + 3, "no source", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumnRenamed("source", "source")


def test_given_weights_are_met(spark):
    docs = docs_of(spark, 4000)
    weights = {"big": 1.0, "s0": 3.0, "s1": 1.0}
    out = mixing.mix(docs, weights).collect()
    size = Counter()
    for r in out:
        size[r.source] += len(r.text)
    total = sum(len(r.text or "") for r in docs.collect())
    assert set(size) == set(weights)
    for s, w in weights.items():
        assert abs(size[s] / total - w / 5) < 0.05
    assert max(r.rate for r in out) > 2     # a small source is repeated


def test_copies_are_numbered_and_repeatable(spark):
    docs = docs_of(spark)
    one = mixing.mix(docs).collect()
    two = mixing.mix(docs.repartition(7)).collect()
    assert Counter(one) == Counter(two)
    by_doc = Counter((r.doc_id, r.text) for r in one)
    assert all(by_doc[r.doc_id, r.text] == r.n_copies and 1 <= r.copy_no <= r.n_copies for r in one)


def test_large_rates_are_poisson(spark):
    rows = [(i, "a", "tiny") for i in range(300)] + [(1000 + i, "b" * 1000, "huge") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    counted = mixing.copies(docs, mixing.source_rates(docs, {"tiny": 1.0, "huge": 1.0})).where("source = 'tiny'").collect()
    rate = counted[0].rate
    assert rate > 3 * mixing.STEP
    mean = sum(r.n_copies for r in counted) / 300
    var = sum((r.n_copies - mean) ** 2 for r in counted) / 299
    assert abs(mean - rate) < 4 * (rate / 300) ** 0.5
    assert 0.7 < var / rate < 1.4


def test_odd_inputs(spark):
    docs = docs_of(spark).withColumnRenamed("doc_id", "doc_id")
    clash = docs.selectExpr("*", "'mine' as RATE", "1 as other")
    out = mixing.mix(clash)
    assert out.columns == ["doc_id", "text", "source", "other", "rate", "n_copies", "copy_no", "shuffle_key"]
    assert not [r for r in out.collect() if r.source == "empty"]
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": -1.0})


def test_rows_without_an_id_draw_for_themselves(spark):
    rows = [(None, "same text", "a")] * 2000 + [(None, f"text {i:05}", "b") for i in range(1000)] + [(7, f"text {i:05}", "b") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    size = sum(len(r[1]) for r in rows)
    out = mixing.mix(docs, {"a": 1.0, "b": 1.0})
    got = out.collect()
    for source in "ab":
        n = sum(len(t) for _, t, s in rows if s == source)
        rate = size / 2 / n
        kept = sum(r.source == source for r in got)
        rows_in = sum(s == source for _, _, s in rows)
        assert abs(kept / rows_in - rate) < 5 * (rate / rows_in) ** 0.5
    # copies of alike rows differ as Poisson numbers do
    from pyspark.sql import functions as F
    alike = mixing.copies(docs, mixing.source_rates(docs, {"a": 1.0, "b": 1.0})).where("source = 'a'").groupBy("n_copies").count().collect()
    assert len(alike) > 2 and sum(r["count"] for r in alike) == 2000
    assert len({r.shuffle_key for r in got}) == len(got)      # and none gather in one place
    assert Counter(got) == Counter(mixing.mix(docs.repartition(5), {"a": 1.0, "b": 1.0}).collect())
