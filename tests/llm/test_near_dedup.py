"""Near-dedup against all pairs, with groups that a single bucket member does not link."""
import random
import re

import pytest

from tidemark.llm import near_dedup


def brute(rows):
    """{doc_id: (size, component)} of (doc_id, text) rows with unique ids."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_group(rnd, words, n, edits):
    base = [rnd.choice(words) for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [16, 2])
def test_components_match_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rnd = random.Random(small)
    words = [f"w{i}" for i in range(3000)]
    texts = near_group(rnd, words, 60, 8) + near_group(rnd, words, 30, 4)
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 90))) for _ in range(30)]
    texts += [texts[0], texts[0].upper(), texts[70], "a b", "A  b", "a b c", None, "", " \n", "one"]
    rnd.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_stage_keeps_one_row_of_each_group(spark):
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(3, long, "a"), (1, long + " more", "b"), (1, long + " more", "c"), (None, long, "d"), (None, "only nulls here now ok", "e"),
            (None, "only nulls here now ok", "f"), (9, "", "g"), (9, None, "h"), (8, "short text", "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, N_SHINGLES string")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in kept.collect())
    assert left == sorted([(False, 1, long + " more"), (True, 0, "only nulls here now ok"), (False, 9, ""), (False, 9, ""),
                           (False, 8, "short text")])
    assert near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_signature_distance_is_guaranteed():
    """Any two signatures within the distance share a key of the index."""
    import numpy as np

    rnd = np.random.default_rng(5)
    n = near_dedup.CHUNKS * near_dedup.CHUNK
    most = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    for _ in range(300):
        a = rnd.integers(0, 2**16, n)
        b = a.copy()
        b[rnd.choice(n, most, replace=False)] ^= 1
        equal = (a == b).reshape(near_dedup.CHUNKS, near_dedup.CHUNK)
        assert any(equal[c][list(m)].all() for c in range(near_dedup.CHUNKS) for m in near_dedup.MASKS)
