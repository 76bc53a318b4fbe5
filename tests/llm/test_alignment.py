"""Cross-tokenizer alignment against a plain version over the two libraries."""
import hashlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF_SMALL
from tidemark.llm import alignment, bpe


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(bpe.vocabulary_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path("piece_bpe_32k.model"))


def piece_bytes(model, i):
    p = model.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()


def plain(texts, libraries):
    """One tuple a text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    lib_a, lib_b = libraries
    alphabet = bpe.byte_alphabet()
    sequences = []
    for t in texts:
        a = lib_a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = lib_b.encode(t) if t else []
        bytes_a = [bytes(alphabet[c] for c in lib_a.id_to_token(i)) for i in a]
        bytes_b = [piece_bytes(lib_b, i) for i in b]
        want = (" " + t).encode() if t else b""
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            a, b, bytes_a, bytes_b = [], [], [], []
        sequences.append((a, b, bytes_a, bytes_b))
    links, groups, held = [], [], Counter()
    for a, b, bytes_a, bytes_b in sequences:
        spans = []
        for ids, parts in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for i, p in zip(ids, parts):
                out.append((at, at + len(p), i))
                at += len(p)
            spans.append(out)
        mine, lo = [], 0
        for s, e, i in spans[0]:
            while lo < len(spans[1]) and spans[1][lo][1] <= s:
                lo += 1
            k = lo
            while k < len(spans[1]) and spans[1][k][0] < e:
                mine.append((i, spans[1][k][2]))
                k += 1
        links.append(mine)
        held.update(set(mine))
        cuts = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        by = defaultdict(lambda: ([], []))
        for side in (0, 1):
            g = 0
            for _, e, i in spans[side]:
                by[g][side].append(i)
                g += e in cuts
        groups.append([by[g] for g in sorted(by)])
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(len(s[0]), len(s[1]), len(g), len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x),
             ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)) for s, x, g in zip(sequences, links, groups)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
ODD = ["", None, "a", "aaa aaaa aaaaa", "  a  b \n\n c\t ", " ", "\n", "▁x ▁", "<s>hi</s><|endoftext|><0x41>", "日本語 😀 é̈", "\x00\x01 x",
       "ab" * 3000, "word " * 900, "a", "aaa aaaa aaaaa", "x\n\n\ny \nz", "՘\x85\xa0　q"]


@pytest.mark.parametrize("sent", [alignment.MAX_PAIRS_SENT, 0])
def test_odd_rows_both_ways(spark, libraries, sent):
    df = spark.createDataFrame([(i // 2 if i % 5 else None, t, i) for i, t in enumerate(ODD)], "doc_id long, text string, N_A int")
    got = alignment.aligned(df, max_pairs_sent=sent).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(plain(ODD, libraries))
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i // 2 if i % 5 else None) for i in range(len(ODD)))


def test_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40) | st.text("ab ▁'\n\t\r\x85<0x41>", max_size=60), max_size=4))
def test_units_encode_like_whole_texts(texts):
    pair = bpe.loaded(_pair, b"pair")
    assert pair.b.splits
    (a, a_at), (b, b_at) = pair.encode(texts)
    lib = bpe.loaded(_library, b"library")
    for i, t in enumerate(texts):
        ids = pair.b.model.encode(t) if t else []
        right = pair.b.spelled(ids) == (" " + t).encode()
        assert b[b_at[i]: b_at[i + 1]].tolist() == (ids if right else [])
        assert a[a_at[i]: a_at[i + 1]].tolist() == (lib.encode(" " + t, add_special_tokens=False).ids if right and t else [])


def _pair(_):
    with open(bpe.vocabulary_path(), "rb") as a, open(bpe.vocabulary_path("piece_bpe_32k.model"), "rb") as b:
        return alignment.Pair(a.read(), b.read())


def _library(_):
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    lib.encode_special_tokens = True
    return lib


def test_small_memory_changes_nothing(monkeypatch):
    texts = [t for t in pq.read_table(f"{SF_SMALL}/documents.parquet")["text"].to_pylist() if t][:80]
    whole = bpe.loaded(_pair, b"pair").encode(texts)
    monkeypatch.setattr(bpe, "CACHE_UNITS", 300)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 200)
    small = _pair(None)
    parts = [small.encode(texts[i: i + 4]) for i in range(0, 80, 4)]
    for side in (0, 1):
        assert whole[side][0].tolist() == [i for p in parts for i in p[side][0].tolist()]
    assert len(small.wrong) < 4000


def test_identity_map_prefers_whole_pieces():
    assert alignment.identity_map([b"A", b"bc", None, b"zz"], [b"A", b"A", b"bc"], [True, False, False]).tolist() == [1, 2, -1, -1]


def test_query(spark, libraries):
    rows = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()
    want = {r["doc_id"]: p for r, p in zip(rows, plain([r["text"] for r in rows], libraries))}
    got = alignment.query(spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        p = want[r["doc_id"]]
        assert tuple(r[c] for c in COLUMNS[:-1]) == p[:-1]
        assert r["groups_sha256"] == (hashlib.sha256(p[-1].encode()).hexdigest() if p[0] else "")
