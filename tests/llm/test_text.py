"""Vectorised text helpers against plain Python."""
import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm.anchors import pack, unpack, window_anchors
from tidemark.llm.text import (ALNUM_WORD, SPACE_WORD, Words, blocks, minimizers, range_hash, segment_hash, text_column,
                               word_sums)


def _column(docs):
    return text_column(pa.RecordBatch.from_pydict({"text": pa.array(docs, pa.string())}))


def test_words_and_hashes():
    rnd = random.Random(2)
    docs = ["".join(rnd.choice("ab \n\tcé漢\x0b\x1f1A") for _ in range(rnd.randint(0, 60))) for _ in range(500)] + ["", None, " "]
    for table, pattern in ((SPACE_WORD, r"[^\x20\x09-\x0D]+"), (ALNUM_WORD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, seen = [], set()
        for _, data, off in blocks(_column(docs), 500):
            words, raw = Words(data, off, table), data.tobytes()
            each = [raw[s:e].decode() for s, e in zip(words.starts, words.ends)]
            got += [each[words.first[i]:words.first[i + 1]] for i in range(len(off) - 1)]
            seen |= set(zip(each, words.hashes().tolist()))
        assert got == [re.findall(pattern, t or "") for t in docs]
        assert len(seen) == len({w for w, _ in seen}) == len({h for _, h in seen})


def test_empty_column():
    assert list(blocks(_column([]))) == []
    (_, data, off), = blocks(_column([None, ""]))
    assert len(data) == 0 and off.tolist() == [0, 0, 0]
    assert len(Words(data, off).starts) == 0


def test_range_hash_does_not_depend_on_the_place():
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sums = word_sums(h)
    for lo, n in ((0, 3), (50, 20), (190, 9)):
        assert range_hash(sums, np.array([lo]), np.array([lo + n])) == range_hash(word_sums(h[lo:lo + n]), np.array([0]), np.array([n]))
    assert len(set(segment_hash(np.frombuffer(b"aaabbb", np.uint8), np.array([0, 3]), np.array([3, 6])).tolist())) == 2


def test_minimizers_cover_every_window():
    rnd = np.random.default_rng(3)
    order, doc = rnd.integers(0, 100, 2000).astype(np.uint64), np.sort(rnd.integers(0, 40, 2000))
    for w in (1, 2, 7):
        want = set()
        for i in range(len(order) - w + 1):
            if doc[i] == doc[i + w - 1]:
                half = order[i:i + w] >> np.uint64(1)
                want |= {i + int(j) for j in np.flatnonzero(half == half.min())}
        assert set(minimizers(order, doc, w).tolist()) == want


def test_window_anchors_take_every_window_once_and_by_its_content():
    rnd = np.random.default_rng(4)
    units = rnd.integers(0, 4, 800)
    first = np.array([0, 0, 5, 200, 201, 640, 800])
    k, length, reach = 3, 12, 10
    order = np.full(len(units), 2**64 - 1, np.uint64)
    grams = [hash(tuple(units[i:i + k].tolist())) & (2**64 - 1) for i in range(len(units) - k + 1)]
    order[: len(grams)] = np.array(grams, np.uint64)
    doc, anchor, s, e = window_anchors(order, first, length, reach)
    starts = [(int(d), x) for d, a, b in zip(doc, s, e) for x in range(a, b + 1)]
    assert starts == [(d, x) for d in range(len(first) - 1) for x in range(first[d], first[d + 1] - length + 1)]
    offset = {}
    for a, lo, hi in zip(anchor, s, e):
        for x in range(lo, hi + 1):
            assert offset.setdefault(tuple(units[x:x + length].tolist()), int(a) - x) == int(a) - x
    place = pack(s, e - s + 1, anchor - s)
    back = unpack(place)
    assert (back[0] == s).all() and (back[1] == e - s + 1).all() and (back[2] == anchor - s).all()


def thue_morse(n):
    """Two texts of n letters that collide in any polynomial modulo 2**64 from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_different_words_hash_differently():
    for n in (1024, 2048, 4096):
        x, y = thue_morse(n)
        data = np.frombuffer((x + y).encode(), np.uint8)
        assert len(set(segment_hash(data, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
        sums = word_sums(data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        assert len(set(range_hash(sums, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
        # runs of two different words in that order
        words = np.where(data == 97, np.uint64(3), np.uint64(2**63 + 5))
        assert len(set(range_hash(word_sums(words), np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2


def test_operators_tell_such_words_apart():
    from tidemark.llm.decontaminate import Matcher
    from tidemark.llm.near_dedup import shingle_sets
    from tidemark.llm.quality import block_statistics

    x, y = thue_morse(1024)

    def block(texts):
        (_, data, off), = blocks(_column(texts), 1 << 30)
        return data, off

    g, first = shingle_sets(*block([x, y]))
    assert first.tolist() == [0, 1, 2] and g[0] != g[1]
    stats = block_statistics(*block([f"{x}\n{y}", f"{x}\n{x}"]))
    assert stats["n_dup_lines"].tolist() == [0, 1]
    matcher = Matcher([(1, x)], 10)
    data, off = block([y, x])
    assert [(d, owners) for d, _, _, owners in matcher.scan(Words(data, off, ALNUM_WORD))] == [(1, (1,))]


def test_repeats_between_other_shingles_are_dropped():
    """Hashes that share their top bits and repeat as A B A are two, not three."""
    from tidemark.llm import near_dedup

    real = near_dedup.range_hash
    near_dedup.range_hash = lambda sums, lo, hi: np.array([2 << 22 | 1, 2 << 22 | 2, 2 << 22 | 1, 1 << 22], np.uint64)[: len(lo)]
    try:
        (_, data, off), = blocks(_column(["a b c d e f g"]))
        g, first = near_dedup.shingle_sets(data, off)
    finally:
        near_dedup.range_hash = real
    assert sorted(g.tolist()) == [2 << 22 | 1, 2 << 22 | 2] and first.tolist() == [0, 2]
