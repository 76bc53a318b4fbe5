"""Substring and suffix-array dedup against plain Python."""
import hashlib
import random
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tidemark.llm import substring_dedup, suffix_dedup

SCHEMA = "doc_id bigint, text string, N_WORDS string, spans int"


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "漢字"]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(15, 130))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages).split(" ")
            cut = rnd.randint(0, len(p) // 3)
            parts.append(" ".join(p[cut:len(p) - rnd.randint(0, len(p) // 3)]))
            parts.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))))
        texts.append(rnd.choice([" ", "\n", "  "]).join(parts))
    texts += ["ab " * 400, "z" * 1500, "z" * 399, "", None, texts[0], texts[0], "ab " * 150, "q " * 30]
    rnd.shuffle(texts)
    return texts


def ordered(rows):
    """Rows in the order of (id, text), null ids last; a position is a document."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


def brute_words(rows):
    seen, out = set(), []
    for i, text in ordered(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            if key in seen:
                gone |= set(range(k, k + 20))
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, b in data:
        for k in range(len(b) - 399):
            count[b[k:k + 400]] = count.get(b[k:k + 400], 0) + 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if count[b[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def order(rows):
    return sorted(tuple((x is None, x) if x is not None else (True, 0) for x in r) for r in rows)


@pytest.mark.parametrize("ids", ["unique", "repeated"])
def test_substring(spark, ids):
    texts = corpus(1)
    rows = [(i * 13 % 1000 if ids == "unique" else random.Random(i).choice([None, 1, 2, 3]), t) for i, t in enumerate(texts)]
    got = substring_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert order(map(tuple, got)) == order(brute_words(rows))
    assert sum(r[2] for r in got) > 500


def test_substring_ranges_are_what_is_removed(spark):
    rows = [(i, t) for i, t in enumerate(corpus(2, 20))]
    for r in substring_dedup.remove_repeats(frame(spark, rows)).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[r.doc_id] or "")
        for s in reversed(r.removed):
            del words[s.lo:s.hi]
        assert " ".join(words) == r.kept


@pytest.mark.parametrize("tasks", [1, 7])
def test_suffix(spark, tasks):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(corpus(3, 40))]
    # no coalescing: names and runs go on from task to task
    with settings(spark, {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = suffix_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert order(map(tuple, got)) == order(brute_bytes(rows))
    assert sum(r[2] for r in got) > 500


@pytest.mark.parametrize("tasks", [1, 5])
def test_suffix_of_one_name_with_many_surroundings(spark, tasks):
    rnd = random.Random(9)
    core = "".join(rnd.choice("abcdefgh") for _ in range(380))
    edges = ["".join(rnd.choice("xy") for _ in range(30)) for _ in range(3)]
    rows = [(i, "".join(rnd.choice("xy") for _ in range(rnd.randint(0, 6))) + rnd.choice(edges)[rnd.randint(0, 20):] + core
             + rnd.choice(edges)[:rnd.randint(0, 30)] + "".join(rnd.choice("xy") for _ in range(rnd.randint(0, 8)))) for i in range(300)]
    with settings(spark, {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = suffix_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert order(map(tuple, got)) == order(brute_bytes(rows))
    assert 0 < sum(r[2] > 0 for r in got) < len(rows)


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).where("doc_id = 2")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
