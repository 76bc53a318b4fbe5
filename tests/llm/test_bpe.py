"""BPE encoding and decoding against the tokenizers library, row by row."""
import hashlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF_SMALL
from tidemark.llm import bpe


def content():
    with open(bpe.vocabulary_path(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.make_encoder(content())


def ids_of(encoder, texts, **kw):
    ids, at = encoder.encode(texts, **kw)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


ODD = ["", " ", "\n", "a", "  a  b \n\n c\t", "it's we'll THEY'RE 'twas", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>c",
       "<|endof", "日本語 テキスト", "😀👩‍👩‍👧 emoji", "\x00\x1c\x1d\x1e\x1f\x85\xa0 　x", "é̈ ffi", "1234 56,789.0", "՘ \U0001df81a",
       "ab" * 4000, "a" * 3001, "x" * 64 + " " + "y" * 65, "é" * 200, " " * 500 + "z", "!?" * 100]


def test_odd_texts(library, encoder):
    assert ids_of(encoder, ODD) == [library.encode(t, add_special_tokens=False).ids for t in ODD]


def test_special_strings_as_plain_text(encoder):
    plain = Tokenizer.from_file(bpe.vocabulary_path())
    plain.encode_special_tokens = True
    assert ids_of(encoder, ODD, specials=False) == [plain.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab '\n<|endoftxsl>", max_size=80), max_size=5))
def test_any_text(texts):
    encoder = bpe.loaded(bpe.make_encoder, content())
    lib = bpe.loaded(_library, content())
    assert ids_of(encoder, texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def _library(data):
    return Tokenizer.from_buffer(data)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=64).map(bytes))
def test_rank_array_and_heap_agree(word):
    vocab = bpe.loaded(bpe.make_encoder, content()).vocab
    assert bpe.merge_short(vocab, [word, b"ab"])[0][0][: bpe.merge_short(vocab, [word, b"ab"])[1][0]].tolist() == bpe.merge_long(vocab, word).tolist()


def test_small_memory_and_chunks_change_nothing(library, monkeypatch):
    texts = [t for t in pq.read_table(f"{SF_SMALL}/documents.parquet")["text"].to_pylist() if t][:60]
    monkeypatch.setattr(bpe, "CACHE_UNITS", 50)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    encoder = bpe.make_encoder(content())
    assert ids_of(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder.known) <= 2000


def test_query(spark, library):
    rows = {r["doc_id"]: r for r in bpe.query(spark, SF_SMALL).collect()}
    given_rows = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()
    assert len(rows) == len(given_rows)
    for r in given_rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        out = rows[r["doc_id"]]
        assert out["n_tokens"] == len(ids)
        assert out["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert out["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, library):
    df = spark.createDataFrame([(1, None, "x"), (1, "", None), (None, "two words", "y"), (1, None, "x"), (2, "a\n" * 5000, "z")],
                               "doc_id long, text string, IDS string")
    rows = bpe.decode(bpe.encode(df)).collect()
    assert [c for c in bpe.encode(df).columns] == ["doc_id", "text", "ids"]
    assert sorted((r["text"] or "", len(r["ids"])) for r in rows) == sorted(
        (t or "", len(library.encode(t or "", add_special_tokens=False).ids)) for t in [None, "", "two words", None, "a\n" * 5000])
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0


def test_partial_utf8_and_unknown_ids(spark, library):
    some = library.encode("日本語😀", add_special_tokens=False).ids
    df = spark.createDataFrame([(some[:1],), (some[1:],), (some[::-1],), ([50256, 64],), (None,)], "ids array<int>")
    got = [r["decoded"] for r in bpe.decode(df).collect()]
    assert got == [library.decode(list(r["ids"] or []), skip_special_tokens=False) for r in df.collect()]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([99999],)], "ids array<int>")).collect()
