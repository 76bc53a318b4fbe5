"""Cross-tokenizer alignment (13): which tokens of two vocabularies stand for the same bytes.

A text is encoded by a byte-level vocabulary A and a piece vocabulary B.  Byte offsets where tokens of both end
cut the two sequences into groups; inside a group, tokens whose byte ranges overlap are linked.  The count of a
pair of ids is the number of documents that hold it linked.

* The identity map gives each A id the B id of the same bytes.  A group of one A token and one B token that are
  each other's image (exact one-to-one) is counted by its A id alone, in a vector as long as the vocabulary: one
  vector a task, summed by id.
* Only what irregular groups link enters the pair shuffle, as distinct pairs of a block of texts with their number
  of documents (partial sums before the exchange).  A pair of the identity map that an irregular group links, for
  example "a" and "a" at shifted places of "aaa", goes to the vector unless the document is counted there already.
* ``encoded`` writes both id sequences once; groups and links follow from them and the tokens' lengths, so the pass that
  counts and the pass that scores both read it without encoding again.
* The vectors (counts and each A id's best count) are bounded by the vocabulary and are sent to the tasks.  The table
  of irregular pairs is sent where it is proven to have at most ``MAX_PAIRS_SENT`` rows; beyond that the documents'
  pairs are joined with it by a shuffle (same results, tested), where a hot pair is one that Spark can split.

The vocabulary files are read on the driver and broadcast (``bpe.send_file``).  The piece encoder is the public
library's; where the vocabulary shows that no piece goes from a word into a space, texts go through it
by units that a worker remembers, else whole.

Defined results.  Null and empty texts have no tokens, nor have texts whose tokens do not spell space + text; their
numbers are 0 and their groups ''.  Rows with the same or a null doc_id are documents of their own.  Empty table: empty result.
"""
from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.tables import map_arrow, table, written
from tidemark.llm.text import text_column

KNOWN_WORDS = 100_000           # of A, beside the units
MAX_PAIRS_SENT = 4_000_000      # 16 bytes a row in a task
SPACE = "▁"                # fixed value: how a piece writes a space
# fixed values: letters of every Unicode version, and marks that A's pattern parts from letters
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
MARKS = ".,;:!?"


class PieceEncoder:
    """A sentencepiece model, by whole texts or by units that encode alike wherever they stand."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.strings = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.spelling = bpe.Spelling(self.strings)
        self.plain_space = self.model.piece_to_id(SPACE)
        whole = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        # white space that some piece has behind a word, like a carriage return: no cut before it
        glue = {p[m.start() + 1] for p in whole for m in re.finditer(f"[^{SPACE}{bpe.WHITE}](?=[{SPACE}{bpe.WHITE}])", p)}
        # the model adds one space, keeps the rest as it is and falls back to bytes
        probe = "  a\n \t b  "
        self.splits = (pieces[self.plain_space] == SPACE and SPACE not in glue
                       and b"".join(self.strings[i] for i in self.model.encode(probe)) == b" " + probe.encode())
        more = f"(?:[{re.escape(''.join(sorted(glue)))}][{bpe.WHITE}]*[^{bpe.WHITE}]*)*" if glue and self.splits else ""
        # marks that no piece joins to a letter before them: words and what follows them are units of their own
        marks = "".join(m for m in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(m)}", p) for p in whole))
        word = f"[{bpe.WHITE}]*[{LETTERS}]+(?=[{re.escape(marks)}])|" if marks and self.splits else ""
        # white space and the word behind it: both vocabularies cut between such units
        self.units = re.compile(f"{word}[{bpe.WHITE}]*[^{bpe.WHITE}]+{more}|[{bpe.WHITE}]+").findall
        self.apart = self.model.encode("\na")[:2]       # the added space, and a byte that no piece holds

    def whole_ids(self, text: str) -> list[int]:
        """Ids of " " + some text, given with that space."""
        return self.model.encode(text[1:])

    def unit_ids(self, units: list[str]) -> list[list[int] | None]:
        """Ids of units; None for a unit that needs its surroundings."""
        marked = [u.replace(" ", SPACE) for u in units]
        # the model puts a space in front: units that begin with one lose theirs, others are kept apart from it by a line feed
        found = self.model.encode([m[1:] if m[0] == SPACE else "\n" + m for m in marked], num_threads=1)
        out: list = []
        for m, ids in zip(marked, found):
            if m == SPACE:
                ids = [self.plain_space]
            elif m[0] != SPACE:
                ids = ids[2:] if ids[:2] == self.apart else None
            out.append(ids)
        return out

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join([self.strings[i] for i in ids])


class Ragged:
    """Lists of ids that are appended to, and gathered by their numbers without a loop."""

    def __init__(self):
        self.first, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def append(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids])

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the lists one after another, their lengths)."""
        length = self.length[at]
        ends = np.cumsum(length)
        place = np.repeat(self.first[at] - (ends - length), length)
        place += np.arange(len(place))
        return self.ids[place], length


def identity_map(a: list[bytes | None], b: list[bytes], bytes_of_b: list[bool]) -> np.ndarray:
    """For each A id the B id of the same bytes, or -1; a whole piece goes before a byte token."""
    image = {s: i for i, s in enumerate(b) if bytes_of_b[i]}
    image.update((s, i) for i, s in reversed(list(enumerate(b))) if not bytes_of_b[i])
    return np.array([image.get(s, -1) if s else -1 for s in a], np.int64)


class Pair:
    """Both encoders, the tokens' lengths and the identity map.  Texts are encoded by units (white space and the word behind
    it), each looked up once for both vocabularies; a worker remembers about ``bpe.CACHE_UNITS`` of them."""

    def __init__(self, content_a: bytes, content_b: bytes):
        self.a = bpe.make_encoder(content_a)
        self.b = PieceEncoder(content_b)
        vocab = self.a.vocab
        self.size_a, self.size_b = vocab.size, len(self.b.strings)
        self.length_a, self.length_b = vocab.spelling.length, self.b.spelling.length
        special = set(vocab.special.values())
        self.image = identity_map([None if i in special else t for i, t in enumerate(vocab.tokens)], self.b.strings,
                                  [self.b.model.is_byte(i) for i in range(self.size_b)])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.words: dict[str, bytes] = {}
        self.ids_a, self.ids_b = Ragged(), Ragged()
        self.wrong = np.zeros(0, np.int8)       # 1: B does not spell the unit, 2: it needs its surroundings
        self.used = np.zeros(0, np.int64)

    def _keep_used(self) -> None:
        """Forget the units that were met once, or all if few are left to forget."""
        names, numbers = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        again = self.used[numbers] > 1
        if 2 * again.sum() > len(self.wrong):
            self._forget()
            return
        at = numbers[again]
        a, b = self.ids_a.gather(at), self.ids_b.gather(at)
        wrong, words = self.wrong[at], self.words
        self._forget()
        self.ids_a.append(*a)
        self.ids_b.append(*b)
        self.wrong, self.used, self.words = wrong, np.ones(len(at), np.int64), words
        self.known = dict(zip([n for n, k in zip(names, again.tolist()) if k], range(len(at))))

    def _learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.known]
        if not new:
            return
        a = self.a.merged([self.a.words(u) for u in new], self.words)
        self.words.update((u, ids) for u, ids in zip(new, a) if len(u) <= bpe.CACHED_CHARS)
        if len(self.words) > KNOWN_WORDS:
            self.words = {}
        b = self.b.unit_ids(new)
        fault = np.array([2 * (ids is None) for ids in b], np.int8)
        self.ids_a.append(np.frombuffer(b"".join(a), np.int32), np.array([len(x) // 4 for x in a], np.int64))
        length = np.array([len(ids or ()) for ids in b], np.int64)
        flat = np.fromiter(chain.from_iterable(ids or () for ids in b), np.int32, int(length.sum()))
        self.ids_b.append(flat, length)
        if self.b.spelling.spell(flat).tobytes() != "".join(new).encode():
            fault = np.array([2 if ids is None else int(self.b.spelled(ids) != u.encode()) for u, ids in zip(new, b)], np.int8)
        self.known.update(zip(new, range(len(self.wrong), len(self.wrong) + len(new))))
        self.wrong = np.concatenate([self.wrong, fault])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])

    def _encode(self, pieces: list[tuple[int, str]]) -> tuple:
        """(ids of A, their texts), (ids of B, their texts), (texts of units with a fault, the fault)."""
        units = [self.b.units(p) if self.b.splits else [p] for _, p in pieces]
        count = np.array([len(u) for u in units], np.int64)
        if len(self.wrong) > bpe.CACHE_UNITS:
            self._keep_used()
        distinct = set().union(*units)
        self._learn(distinct)
        get = self.known.__getitem__
        at = np.fromiter((k for u in units for k in map(get, u)), np.int64, int(count.sum()))
        doc = np.repeat(np.array([i for i, _ in pieces], np.int64), count)
        self.used += np.bincount(at, minlength=len(self.used))
        sides = []
        for ids in (self.ids_a, self.ids_b):
            flat, length = ids.gather(at)
            sides.append((flat, np.repeat(doc, length)))
        for u in distinct:
            if len(u) > bpe.CACHED_CHARS:       # long ones are not kept: their number goes on holding their ids until all is forgotten
                del self.known[u]
        odd = self.wrong[at] > 0
        return *sides, (doc[odd], self.wrong[at[odd]])

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For A and B: ids of all texts in one array, and where each text's begin (and the last ones end); none where
        B's tokens do not spell space + text (A's always do: it has a token for each byte)."""
        parts, some, held = [], [], 0
        for i, t in enumerate(texts):
            for piece in bpe.safe_pieces(" " + t) if t and self.b.splits else [" " + t] if t else []:
                some.append((i, piece))
                held += len(piece)
                if held >= bpe.CHUNK_CHARS:
                    parts.append(self._encode(some))
                    some, held = [], 0
        parts.append(self._encode(some))
        sides = [[np.concatenate([p[k][j] for p in parts]) for j in (0, 1)] for k in (0, 1)]
        doc, fault = (np.concatenate([p[2][j] for p in parts]) for j in (0, 1))
        bad = np.zeros(len(texts), bool)
        whole: list[tuple[int, list[int]]] = []
        for i in np.unique(doc[fault > 0]).tolist():
            ids = self.b.whole_ids(" " + texts[i]) if (fault[doc == i] == 2).any() else None
            if ids is not None and self.b.spelled(ids) == (" " + texts[i]).encode():
                whole.append((i, ids))
            else:
                bad[i] = True
        if whole:
            again = np.isin(sides[1][1], [i for i, _ in whole])
            flat = np.concatenate([sides[1][0][~again], *[np.array(ids, np.int32) for _, ids in whole]])
            of = np.concatenate([sides[1][1][~again], *[np.full(len(ids), i) for i, ids in whole]])
            order = np.argsort(of, kind="stable")
            sides[1] = [flat[order], of[order]]
        out = []
        for flat, of in sides:
            if bad.any():
                flat, of = flat[~bad[of]], of[~bad[of]]
            out.append((flat, np.append(0, np.cumsum(np.bincount(of, minlength=len(texts))))))
        return out[0], out[1]


class Links:
    """Groups and links of a block of documents, from their ids and the tokens' lengths."""

    def __init__(self, pair: Pair, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray):
        self.pair, self.a, self.b, self.a_at, self.b_at = pair, a, b, a_at, b_at
        docs = len(a_at) - 1
        self.docs = docs
        len_a = pair.length_a[a]
        end_a, end_b = np.cumsum(len_a), np.cumsum(pair.length_b[b])
        total = int(end_a[-1]) if len(a) else 0
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[end_a], is_b[end_b] = True, True
        self.cut_a, self.cut_b = is_b[end_a], is_a[end_b]           # tokens that end a group
        self.group_a = np.cumsum(self.cut_a) - self.cut_a
        self.group_b = np.cumsum(self.cut_b) - self.cut_b
        groups = int(self.cut_a.sum())
        self.in_a = np.bincount(self.group_a, minlength=groups)
        self.in_b = np.bincount(self.group_b, minlength=groups)
        self.doc_a = np.repeat(np.arange(docs), np.diff(a_at))
        ended = np.cumsum(is_b, dtype=np.int32)                     # B tokens that have ended at a byte
        lo = ended[end_a - len_a]
        n = ended[end_a - 1] - lo + 1                               # links of each A token
        self.n_groups = np.bincount(self.doc_a[self.cut_a], minlength=docs)
        self.n_links = np.bincount(self.doc_a, weights=n, minlength=docs).astype(np.int64)
        # exact one-to-one groups
        single = (self.in_a[self.group_a] == 1) & (self.in_b[self.group_a] == 1)
        exact = single & (pair.image[a] == b[lo]) if len(a) else single
        regular, regular_n = np.unique(self.doc_a[exact] * pair.size_a + a[exact], return_counts=True)
        # all other links
        some = np.flatnonzero(~exact)
        times = n[some]
        first = np.cumsum(times) - times
        at_a = np.repeat(some, times)
        at_b = np.repeat(lo[some] - first, times) + np.arange(int(times.sum()))
        width = pair.size_a * pair.size_b
        key, key_n = np.unique(self.doc_a[at_a] * width + a[at_a].astype(np.int64) * pair.size_b + b[at_b], return_counts=True)
        of, ids = key // width, key % width
        same = pair.image[ids // pair.size_b] == ids % pair.size_b
        # pairs of the identity map inside irregular groups join the regular ones
        extra = of[same] * pair.size_a + ids[same] // pair.size_b
        keys = np.concatenate([regular, extra])
        ones, where = np.unique(keys, return_inverse=True)
        self.one_doc, self.one_id = ones // pair.size_a, ones % pair.size_a
        self.one_n = np.bincount(where, weights=np.concatenate([regular_n, key_n[same]]), minlength=len(ones)).astype(np.int64)
        self.pair_doc, self.pair_id, self.pair_n = of[~same], ids[~same], key_n[~same]

    def groups_text(self) -> list[str]:
        """``a1,a2|b1;a3|b2`` for each document."""
        a, b = self.a, self.b
        before_b = np.cumsum(self.in_b) - self.in_b                 # B tokens in earlier groups
        after_a = np.cumsum(self.in_a)                              # A tokens up to a group's end
        ids = np.empty(len(a) + len(b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        place_a = np.arange(len(a)) + before_b[self.group_a]
        place_b = np.arange(len(b)) + after_a[self.group_b]
        ids[place_a], ids[place_b] = a, b
        mark[place_a[self.cut_a]], mark[place_b[self.cut_b]] = ord("|"), ord(";")
        digits = _digits(max(self.pair.size_a, self.pair.size_b))
        data = digits.spell(ids).copy()
        ends = np.cumsum(digits.length[ids])
        data[ends - 1] = mark
        at = np.append(0, ends)[self.a_at + self.b_at]
        text = data.tobytes()
        return [text[lo: max(lo, hi - 1)].decode() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]


_DIGITS: dict[int, bpe.Spelling] = {}


def _digits(n: int) -> bpe.Spelling:
    if n not in _DIGITS:
        _DIGITS[n] = bpe.Spelling([b"%d," % i for i in range(n)])
    return _DIGITS[n]


class Sent:
    """Both files as broadcasts, and the encoders built once for each worker."""

    def __init__(self, spark: SparkSession, path_a: str | None, path_b: str | None):
        self.a = bpe.send_file(spark, path_a or bpe.vocabulary_path())
        self.b = bpe.send_file(spark, path_b or bpe.vocabulary_path("piece_bpe_32k.model"))

    def pair(self) -> Pair:
        return bpe.loaded(make_pair, self.a.value + b"\0" + self.b.value, self.a.value, self.b.value)


def make_pair(a: bytes, b: bytes) -> Pair:
    return Pair(a, b)


def encoded(docs: DataFrame, sent: Sent, column: str = "text") -> DataFrame:
    """row (a number of the document's own), doc_id, a and b (array<int>), written once."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(f"`{column}`").cast("string").alias("__text"))

    def run(batches):
        pair = sent.pair()
        for batch in batches:
            text = text_column(batch, "__text")
            for lo, hi in bpe.text_runs(text):
                columns = [*batch.slice(lo, hi - lo).columns[:2]]
                columns += [pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids)) for ids, at in pair.encode(text[lo:hi].to_pylist())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(map_arrow(source, run, f"row bigint, doc_id {kind}, a array<int>, b array<int>"), "alignment-ids")


def link_blocks(batch: pa.RecordBatch, pair: Pair, limit: int = 1 << 16):
    """(first row, end, links) of consecutive documents with about ``limit`` tokens of A."""
    def side(name):
        col = batch.column(batch.schema.get_field_index(name))
        flat, off = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
        return flat, off.astype(np.int64)

    a, a_off = side("a")
    b, b_off = side("b")
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(a_off, a_off[lo] + limit, side="right")) - 1)
        yield lo, hi, Links(pair, a[a_off[lo]: a_off[hi]], a_off[lo: hi + 1] - a_off[lo],
                            b[b_off[lo]: b_off[hi]], b_off[lo: hi + 1] - b_off[lo])
        lo = hi


def pair_counts(ids: DataFrame, sent: Sent) -> DataFrame:
    """one (whether the pair is the identity map's), id, n: the number of documents that hold a pair linked. ``id`` is the
    A id for pairs of the identity map, else A id * size of B + B id."""
    def run(batches):
        pair = sent.pair()
        vector = np.zeros(pair.size_a, np.int64)
        for batch in batches:
            for _, _, links in link_blocks(batch, pair):
                vector += np.bincount(links.one_id, minlength=pair.size_a)
                key, n = np.unique(links.pair_id, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), bool)), pa.array(key), pa.array(n)], ["one", "id", "n"])
        key = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), bool)), pa.array(key), pa.array(vector[key])], ["one", "id", "n"])

    parts = map_arrow(ids.select("a", "b"), run, "one boolean, id bigint, n bigint")
    return written(parts.groupBy("one", "id").agg(F.sum("n").alias("n")), "alignment-counts")


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, column: str = "text",
            max_pairs_sent: int = MAX_PAIRS_SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (bigint) and groups, the ids of each group as text."""
    spark = docs.sparkSession
    sent = Sent(spark, path_a, path_b)
    pair = sent.pair()                                  # the driver needs the sizes only
    ids = encoded(docs, sent, column)
    counts = pair_counts(ids, sent)
    size_a, size_b = pair.size_a, pair.size_b

    # each A id's best count over both kinds: at most one row for each id of the vocabulary
    a_id = F.when(F.col("one"), F.col("id")).otherwise(F.floor(F.col("id") / size_b))
    best_rows = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("best"), F.max(F.when(F.col("one"), F.col("n"))).alias("one")).collect()
    best, one = np.zeros(size_a, np.int64), np.zeros(size_a, np.int64)
    for r in best_rows:
        best[r["a"]], one[r["a"]] = r["best"], r["one"] or 0
    vectors = spark.sparkContext.broadcast((best, one))
    irregular = counts.where("NOT one").select(F.col("id").alias("pair"), "n")
    table_sent = None
    if irregular.limit(max_pairs_sent + 1).count() <= max_pairs_sent:
        found = irregular.toArrow()
        key, n = found["pair"].to_numpy(), found["n"].to_numpy()
        order = np.argsort(key)
        table_sent = spark.sparkContext.broadcast((key[order], n[order]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = f"row bigint, doc_id {kind}, {', '.join(f'{c} bigint' for c in numbers)}, groups string"

    def score(batches):
        both = sent.pair()
        best, one = vectors.value
        for batch in batches:
            for lo, hi, links in link_blocks(batch, both):
                known = one[links.one_id]
                total = np.bincount(links.one_doc, weights=links.one_n * known, minlength=links.docs)
                top = np.bincount(links.one_doc, weights=links.one_n * (known == best[links.one_id]), minlength=links.docs)
                if table_sent is not None and len(links.pair_id):
                    key, n = table_sent.value
                    n = n[np.searchsorted(key, links.pair_id)]
                    total += np.bincount(links.pair_doc, weights=links.pair_n * n, minlength=links.docs)
                    top += np.bincount(links.pair_doc, weights=links.pair_n * (n == best[links.pair_id // both.size_b]), minlength=links.docs)
                sums = [np.diff(links.a_at), np.diff(links.b_at), links.n_groups, links.n_links, top, total]
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), *[pa.array(x.astype(np.int64)) for x in sums], pa.array(links.groups_text(), pa.string())],
                    ["row", "doc_id", *numbers, "groups"])

    scored = map_arrow(ids, score, schema)
    if table_sent is None:
        scored = scored.join(_joined(ids, irregular, vectors, sent), "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("pair_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("pair_sum", F.lit(0))})
    return scored.select("doc_id", *numbers, "groups")


def _joined(ids: DataFrame, irregular: DataFrame, vectors, sent: Sent) -> DataFrame:
    """row, pair_best, pair_sum: the documents' irregular pairs joined with the pairs' counts."""
    def pairs(batches):
        both = sent.pair()
        for batch in batches:
            row = batch.column(0).to_numpy()
            for lo, _, links in link_blocks(batch, both):
                best = vectors.value[0][links.pair_id // both.size_b]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row[lo + links.pair_doc], links.pair_id, links.pair_n, best)],
                                                 ["row", "pair", "times", "best"])

    held = map_arrow(ids.select("row", "a", "b"), pairs, "row bigint, pair bigint, times bigint, best bigint")
    both = held.join(irregular, "pair")
    return both.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("pair_best"),
                                   F.sum(F.col("times") * F.col("n")).alias("pair_sum"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aligned(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
