"""BPE encoding and decoding (12): byte-level merges by contiguous rank arrays.

A text is cut into words by the vocabulary's pattern.  Each distinct short word of a block of texts is
one row of two arrays: the parts between its boundaries, held by their ids without gaps, and the ranks of
adjacent parts.  Every round scans each row's ranks for the minimum (leftmost at ties), deletes the boundary behind that
place and refreshes the two ranks beside it; a row leaves when no rank is left.  All words of a block take a
round together, so the scan is a NumPy minimum.  Words above ``SHORT_BYTES`` would make the scans quadratic:
they take a heap of ranks over linked parts (same merges, same order).

Texts are encoded where they lie, without a shuffle: a worker keeps the ids of at most ``CACHE_UNITS`` words
and those of a chunk, and long texts are cut at spaces between printable ASCII characters, where the pattern always cuts, so a task's
memory is bounded by ``CHUNK_CHARS`` and its Arrow batch.  The vocabulary file is read on the driver and
broadcast (its size is checked against ``MAX_VOCABULARY_BYTES``); executors need no copy of the file.

Defined results.  A null or empty text has no ids and decodes to the empty text.  Repeated rows and ids are
encoded alone.  The strings of special tokens become their ids, or are plain text with ``specials=False``.
Decoding writes U+FFFD for bytes that are no UTF-8 and fails on an id that the vocabulary lacks; null ids decode to the
empty text.  Input columns named like the output give way to it.  Empty table: empty result.
"""
from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import map_arrow, table
from tidemark.llm.text import text_column

SHORT_BYTES = 64
CHUNK_CHARS = 1 << 19
CACHE_UNITS = 400_000
CACHED_CHARS = 64               # longer ones are encoded anew each time
MAX_VOCABULARY_BYTES = 64 << 20
NO_RANK = np.iinfo(np.int32).max

# fixed value: the pattern of the byte-level pre-tokenizer
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters for
    themselves, the others from U+0100 up in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


class Spelling:
    """Byte strings by id, as one buffer: ``spell`` writes a sequence of ids as bytes without a loop."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(s) for s in strings], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.buffer = np.frombuffer(b"".join(strings), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        if not len(length):
            return np.zeros(0, np.uint8)
        ends = np.cumsum(length)
        at = np.repeat(self.first[ids] - (ends - length), length)
        at += np.arange(ends[-1])
        return self.buffer[at]


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file (JSON)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
                or spec.get("normalizer"):
            raise ValueError("expected a byte-level BPE vocabulary without normalizer or prefix space")
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError("special tokens that strip or ask for whole words are not handled")
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *special.values()]) + 1
        tokens = [None] * self.size
        for name, i in {**special, **vocab}.items():
            known = all(c in alphabet for c in name)
            tokens[i] = bytes(alphabet[c] for c in name) if known else name.encode()
        self.tokens, self.special = tokens, special
        self.known = np.array([t is not None for t in tokens])
        self.spelling = Spelling([t or b"" for t in tokens])
        self.byte_id = np.full(256, -1, np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        pairs, merged = [], []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append(vocab[a] << 32 | vocab[b])
            merged.append(vocab[a + b])
        keys = np.array(pairs, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)      # sorted pairs, and their ranks
        self.key_rank = np.append(order, NO_RANK).astype(np.int32)
        self.merged = np.array(merged, np.int32)
        self.rank_of = dict(zip(pairs, range(len(pairs))))
        self.cut_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, ``NO_RANK`` where there is no merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_rank[at], NO_RANK)


def merge_short(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of about the same length by rank arrays, one row a word, and the number of ids in each row."""
    n, width = len(words), max(map(len, words))
    size = np.array([len(w) for w in words], np.int32)
    flat = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
    part = vocab.byte_id[flat]
    col = np.arange(width, dtype=np.int32)
    rank = np.full((n, width), NO_RANK, np.int32)
    rank[:, :-1] = vocab.ranks(part[:, :-1], part[:, 1:])
    rank[col[None, :] >= size[:, None] - 1] = NO_RANK
    row, ids, sizes = np.arange(n), np.empty_like(part), np.empty_like(size)
    while len(row):
        i = np.arange(len(row))
        at = rank.argmin(axis=1)
        low = rank[i, at]
        done = low == NO_RANK
        if done.any():
            ids[row[done]], sizes[row[done]] = part[done], size[done]
            live = ~done
            row, size, part, rank, at, low = (x[live] for x in (row, size, part, rank, at, low))
            i = i[: len(row)]
        part[i, at] = vocab.merged[low]
        # the boundary behind the place goes: what follows it moves up by one
        keep = i[:, None] * width + np.minimum(col[None, :] + (col[None, :] > at[:, None]), width - 1)
        part, rank = part.ravel()[keep], rank.ravel()[keep]
        size = size - 1
        rank[:, -1] = NO_RANK
        # refresh the ranks on both sides of the merged part
        right = np.minimum(at + 1, width - 1)
        rank[i, at] = np.where(at + 1 < size, vocab.ranks(part[i, at], part[i, right]), NO_RANK)
        left = np.flatnonzero(at > 0)
        rank[left, at[left] - 1] = vocab.ranks(part[left, at[left] - 1], part[left, at[left]])
    return ids, sizes


def merge_long(vocab: Vocabulary, word: bytes) -> np.ndarray:
    """Ids of one word by a heap of (rank, place) over linked parts."""
    part = vocab.byte_id[np.frombuffer(word, np.uint8)].tolist()
    n = len(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def push(i: int) -> None:
        if i >= 0 and after[i] < n:
            pair = part[i] << 32 | part[after[i]]
            rank = vocab.rank_of.get(pair)
            if rank is not None:
                heapq.heappush(heap, (rank, i, pair))

    for i in range(n):
        push(i)
    while heap:
        rank, i, pair = heapq.heappop(heap)
        if part[i] < 0 or after[i] >= n or part[i] << 32 | part[after[i]] != pair:
            continue        # one of the two has been merged since
        gone = after[i]
        part[i], part[gone] = int(vocab.merged[rank]), -1
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        push(before[i])
    return np.array([p for p in part if p >= 0], np.int32)


def merge_words(vocab: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids of each word as int32 bytes; short words go together by length, so that rows are hardly padded."""
    out: list = [b""] * len(words)
    by_width: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) > SHORT_BYTES:
            out[i] = merge_long(vocab, w).tobytes()
        elif w:
            by_width.setdefault((len(w) + 1) // 2, []).append(i)
    for members in by_width.values():
        for lo in range(0, len(members), 16384):
            some = members[lo: lo + 16384]
            ids, sizes = merge_short(vocab, [words[i] for i in some])
            data, step = ids.tobytes(), ids.shape[1] * 4
            for k, (i, n) in enumerate(zip(some, sizes.tolist())):
                out[i] = data[k * step: k * step + 4 * n]
    return out


@functools.lru_cache(1)
def _newer_characters() -> re.Pattern:
    """Characters that this Python's Unicode tables lack: pattern libraries of other versions class them differently."""
    free = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
    runs: list[list[int]] = []
    for c in free:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]")


_BEYOND = re.compile("[͸-\U0010ffff]")         # U+0378 is the first character without a class
_SAFE_CUT = re.compile("(?<=[!-~]) (?=[!-~])")
# fixed value: white space of the pattern
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall


def safe_pieces(text: str, start: int = 0, end: int | None = None):
    """A text cut at spaces between printable ASCII characters into pieces of about ``CHUNK_CHARS``."""
    end = len(text) if end is None else end
    while start < end:
        stop = end
        if end - start > CHUNK_CHARS:
            safe = _SAFE_CUT.search(text, start + CHUNK_CHARS, end)
            stop = safe.start() if safe else end
        yield text[start:stop]
        start = stop


class UnitEncoder:
    """Texts to ids through units that encode alike wherever they stand, with a bounded memory of units."""

    cut_special: re.Pattern | None = None
    special: dict[str, int] = {}

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        raise NotImplementedError

    def unit_ids(self, units: list[str]) -> list[bytes]:
        """The ids of each unit as int32 bytes."""
        raise NotImplementedError

    def segments(self, text: str, specials: bool):
        """Pieces of a text that encode independently: (text, id of a special token or None)."""
        cut = self.cut_special if specials else None
        at = 0
        for m in [*cut.finditer(text), None] if cut else [None]:
            end = m.start() if m else len(text)
            for piece in safe_pieces(text, at, end):
                yield piece, None
            if m:
                yield "", self.special[m.group()]
                at = m.end()

    def learn(self, units: set[str]) -> None:
        """Make the ids of ``units`` known; when too many are, all but these are forgotten."""
        if len(self.known) > CACHE_UNITS:
            self.known = {}
        new = [u for u in units if u not in self.known]
        self.known.update(zip(new, self.unit_ids(new)))

    def encode(self, texts: list[str], specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (and the last ones end)."""
        parts: list[bytes] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        waiting: list[tuple[int, object]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            units = set().union(*[u for _, u in waiting if isinstance(u, list)])
            self.learn(units)
            for i, u in waiting:
                piece = b"".join(map(self.known.__getitem__, u)) if isinstance(u, list) else np.int32(u).tobytes()
                parts.append(piece)
                ends[i + 1] += len(piece) // 4
            for u in units:
                if len(u) > CACHED_CHARS:
                    del self.known[u]
            waiting.clear()
            held = 0

        for i, text in enumerate(texts):
            for piece, special in self.segments(text, specials):
                waiting.append((i, self.units(piece) if special is None else special))
                held += len(piece)
                if held >= CHUNK_CHARS:
                    flush()
        flush()
        return np.frombuffer(b"".join(parts), np.int32), np.cumsum(ends)


class Encoder(UnitEncoder):
    """Byte-level BPE by rank arrays."""

    def __init__(self, vocab: Vocabulary):
        import regex

        super().__init__()
        self.vocab, self.special, self.cut_special = vocab, vocab.special, vocab.cut_special
        self.findall = regex.compile(PATTERN).findall

    def units(self, text: str) -> list[str]:
        """Runs of ``text`` in which the pattern cuts alike whatever stands around them: a run without white
        space and the space before it, or white space."""
        return self._cut_by_library(text) or _UNITS(text)

    def words(self, text: str) -> list[str]:
        """The words of a text."""
        return self._cut_by_library(text) or self.findall(text)

    def _cut_by_library(self, text: str) -> list[str] | None:
        """Words of a text with characters that are classed otherwise here than by the library's tables."""
        if text.isascii() or not _BEYOND.search(text) or not _newer_characters().search(text):
            return None
        from tokenizers import pre_tokenizers

        cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in cut]

    def unit_ids(self, units: list[str]) -> list[bytes]:
        return self.merged([self.words(u) for u in units], self.known)

    def merged(self, cut: list[list[str]], known: dict[str, bytes]) -> list[bytes]:
        """Ids of each list of words; those of ``known`` words are not merged again."""
        new = list({w for words in cut for w in words if w not in known})
        fresh = dict(zip(new, merge_words(self.vocab, [w.encode() for w in new])))
        return [(fresh.get(words[0]) or known[words[0]]) if len(words) == 1 else
                b"".join([fresh[w] if w in fresh else known[w] for w in words]) for words in cut]


_LOADED: dict[str, object] = {}


def loaded(make, content: bytes, *parts: bytes):
    """``make(content)`` or ``make(*parts)``, built once for each worker and content (the last one of a kind stays)."""
    key = hash(content)
    if _LOADED.get(make.__name__, (None, None))[0] != key:
        _LOADED[make.__name__] = (key, make(*parts or (content,)))
    return _LOADED[make.__name__][1]


def make_encoder(content: bytes) -> Encoder:
    return Encoder(Vocabulary(content))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabularies lie; any other path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def send_file(spark: SparkSession, path: str):
    """A vocabulary file's bytes as a broadcast, its size checked."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(content)


def text_runs(column: pa.Array, limit: int = CHUNK_CHARS):
    """Consecutive rows with about ``limit`` bytes of text: (first row, end)."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo = hi


def _without(df: DataFrame, name: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() == name])


def with_column(batch: pa.RecordBatch, lo: int, hi: int, column: pa.Array) -> pa.RecordBatch:
    part = batch.slice(lo, hi - lo)
    return pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "__out"])


def encode(docs: DataFrame, path: str | None = None, column: str = "text", out: str = "ids", specials: bool = True,
           keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``out`` array<int>, the ids of ``column``."""
    sent = send_file(docs.sparkSession, path or vocabulary_path())
    rest = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (out.lower(), "__text", "__out")]
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").cast("string").alias("__text"))

    def run(batches):
        encoder = loaded(make_encoder, sent.value)
        for batch in batches:
            text = text_column(batch, "__text")
            rows = batch.select([i for i, c in enumerate(batch.schema.names) if c != "__text"])
            for lo, hi in text_runs(text):
                ids, at = encoder.encode(text[lo:hi].to_pylist(), specials)
                yield with_column(rows, lo, hi, pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    fields = f"{schema}, `__out` array<int>" if schema else "`__out` array<int>"
    return map_arrow(source, run, fields).withColumnRenamed("__out", out)


def decode(df: DataFrame, path: str | None = None, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` and ``out`` string, the text of the ids in ``column`` (special tokens included)."""
    sent = send_file(df.sparkSession, path or vocabulary_path())
    df = _without(df, out.lower())

    def run(batches):
        vocab = loaded(make_encoder, sent.value).vocab
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(column))
            for lo in range(0, batch.num_rows, 256):
                hi = min(lo + 256, batch.num_rows)
                some = ids[lo:hi]
                flat = some.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(flat) and (flat.min() < 0 or flat.max() >= vocab.size or not vocab.known[flat].all()):
                    raise ValueError("an id is not in the vocabulary")
                count = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
                ends = np.append(0, np.cumsum(count))
                at = np.append(0, np.cumsum(vocab.spelling.length[flat]))[ends]
                data = vocab.spelling.spell(flat).tobytes()
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
                yield with_column(batch, lo, hi, pa.array(texts, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, run, f"{schema}, `__out` string").withColumnRenamed("__out", out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
