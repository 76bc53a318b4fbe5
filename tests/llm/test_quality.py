import re
from collections import Counter

import numpy as np
import pytest

from conftest import SF_ORACLE
from tidemark.llm import gbt, quality
from tidemark.llm.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    three = Counter(zip(w, w[1:], w[2:]))
    inside = {k + j for k in range(len(w) - 2) if three[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_match_python(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_ORACLE, "documents").collect()]
    rows += [(None, None), (-1, ""), (-2, "\n\na b\n a b\na b\n"), (-3, "é é é é é\u00a0x"), (-4, "x" * 200_000), (-4, "a b c a b c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, *[r[c] for c in quality.COUNTS]) for r in quality.document_statistics(docs).collect())
    assert got == Counter((i, *brute(t)) for i, t in rows)


def test_held_out_accuracy(spark):
    """Trained on even ids, the verdict on odd ids agrees with their labels."""
    docs, labels = table(spark, SF_ORACLE, "documents"), table(spark, SF_ORACLE, "labels")
    stats = quality.with_base_rules(quality.document_statistics(docs))
    forest = quality.fit_quality(stats, labels.where("doc_id % 2 = 0"))
    held = quality.score_quality(stats, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    right = sum(r.kept == (r.quality > 0) for r in held) / len(held)
    good = [r for r in held if r.quality > 0]
    assert right > 0.95 and sum(r.kept for r in good) / len(good) > 0.98


def test_verdicts_and_odd_inputs(spark):
    text = " ".join(f"word{i}." for i in range(80))
    rows = [(1, text, "a"), (None, text, "b"), (3, "too short", "c"), (4, None, "d"), (5, "again and " * 60, "e"), (1, text, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, KEPT string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id bigint, quality int")
    for labels in (none, odd):
        out = quality.judge_quality(docs, labels).collect()
        assert Counter((r.base_failed, r.kept) for r in out) == {(False, True): 3, (True, False): 3}
        kept = quality.keep_good(docs, labels)
        assert kept.columns == docs.columns
        assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[1], rows[5]])
    assert quality.keep_good(docs.limit(0), none).count() == 0


def test_forest_is_monotone_and_flat_scoring_matches_a_walk():
    rnd = np.random.default_rng(1)
    x = rnd.random((800, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) - x[:, 1] + 0.2 * rnd.standard_normal(800)) > 0).astype(float)
    forest = gbt.fit(x, y, [1, -1, 0])
    p = forest.score(x)
    assert ((p > 0.5) == y).mean() > 0.8

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = (forest.left if row[forest.feature[node]] <= forest.threshold[node] else forest.right)[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(p[:50], [walk(r) for r in x[:50]])
    for f, sign in ((0, 1), (1, -1)):
        grid = np.repeat(x[:40], 25, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 25), 40)
        steps = np.diff(forest.score(grid).reshape(40, 25), axis=1) * sign
        assert steps.min() >= -1e-9


@pytest.mark.parametrize("y", [[], [1.0] * 40, [0.0] * 40])
def test_forest_without_two_classes_is_constant(y):
    p = gbt.fit(np.zeros((len(y), 2)), np.array(y), [0, 0]).score(np.ones((3, 2)))
    assert len(set(p.tolist())) == 1
