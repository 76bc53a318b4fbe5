"""Benchmark decontamination (10): one Aho-Corasick automaton over the word
windows of the test items, run once over every whole text.

Texts are normalised by lower-casing A-Z and taking words of letters, digits and
non-ASCII characters.  The automaton's alphabet is the items' words (by 64-bit
hash), its patterns are all windows of ``WINDOW`` consecutive item words (a
shorter item is one window).  A text word outside the alphabet resets the
automaton, so only runs of known words as long as the shortest pattern are fed to
it.  Matches are word ranges and come back as character spans of the original text.

The items are sent to the executors only up to ``MAX_ITEM_WORDS`` words in all.
Beyond it they are dealt by a hash of their id to several automata of at most
about that size; one after another is sent, scans the texts, and is given up before the next, and the
hits are written between.

Defined results.  Null or empty text, or a text without words: no hits.  Items
without words: no window.  A repeated item id counts once a document; items with a
null id mark words but are not listed.  Repeated documents are judged alone.
Empty tables: no rows, or no hits.  Input columns named like an output column give
way to it.
"""
from __future__ import annotations

import uuid
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.tables import map_arrow, restored, shielded, table, written
from tidemark.llm.text import ALNUM_WORD, LOWER, Words, blocks, text_column

WINDOW = 10
MAX_ITEM_WORDS = 1_000_000

OUTPUT = ["n_words", "n_hit", "items", "spans"]
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Matcher:
    """The automaton of a bounded set of (item id, text)."""

    def __init__(self, items: list[tuple], window: int):
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        per_item: list[np.ndarray] = []
        for _, data, off in blocks(texts):
            words = Words(LOWER[data], off, ALNUM_WORD)
            per_item += np.split(words.hashes(), words.first[1:-1])
        self.alphabet = np.unique(np.concatenate(per_item)) if per_item else np.zeros(0, np.uint64)
        self.window = window
        patterns: dict[tuple, set] = {}
        for (item, _), hashes in zip(items, per_item):
            ids = tuple(np.searchsorted(self.alphabet, hashes).tolist())
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners = patterns.setdefault(ids[k: k + window], set())
                if item is not None:
                    owners.add(item)
        self.shortest = min(map(len, patterns), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, owners in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(owners)))
        if patterns:
            self.automaton.make_automaton()

    def scan(self, words: Words):
        """(document, first word, last word, item ids) of every occurrence in the block."""
        if not self.shortest or not len(words.starts):
            return
        h = words.hashes()
        code = np.minimum(np.searchsorted(self.alphabet, h), len(self.alphabet) - 1)
        known = self.alphabet[code] == h
        new_doc = np.zeros(len(h), bool)
        new_doc[words.first[:-1][words.count > 0]] = True
        opens = known & (new_doc | ~np.concatenate([[False], known[:-1]]))
        start = np.flatnonzero(opens)
        if not len(start):
            return
        run = np.cumsum(opens) - 1                       # of known words
        length = np.bincount(run[known], minlength=len(start))
        at = np.flatnonzero(known & (length[np.maximum(run, 0)] >= self.shortest))
        if not len(at):
            return
        # a letter outside the alphabet before each run keeps matches inside runs
        first = np.flatnonzero(opens[at])
        fed = np.insert(code[at], first, len(self.alphabet))
        place = np.insert(at, first, -1)
        for end, (size, owners) in self.automaton.iter(tuple(fed.tolist())):
            last = int(place[end])
            yield int(words.doc[last]), last - size + 1, last, owners


_MATCHER: tuple = (None, None)


def _matcher(job: str, items, window: int) -> Matcher:
    """Built once in a worker; it holds one automaton at a time."""
    global _MATCHER
    if _MATCHER[0] != job:
        _MATCHER = (None, None)
        _MATCHER = (job, Matcher(items.value, window))
    return _MATCHER[1]


def _shards(benchmark: DataFrame, max_words: int) -> list[DataFrame]:
    size = F.size(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                       F.lit(f"({WORD_PATTERN})"), F.lit(1)))
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    parts = -(-total // max_words) or 1
    if parts == 1:
        return [items]
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [items.where(shard == k) for k in range(parts)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
               max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence), items (distinct ids
    found) and spans (character ranges of the hit words, merged, end exclusive)."""
    drop = [c for c in docs.columns if c.lower() in OUTPUT]
    docs = docs.drop(*drop)
    id_type = benchmark.schema["item_id"].dataType
    shards = _shards(benchmark, max_item_words)
    if len(shards) == 1:
        return _scanned(docs, shards[0], window, id_type)
    # rows get numbers that stay; each scan leaves its hits
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "leak-texts")
    hits = [written(_hits(numbered.select("__row", "text"), shard, window, id_type), "leak-hits") for shard in shards]
    every = reduce(DataFrame.unionByName, hits).groupBy("__row").agg(
        F.flatten(F.collect_list("ranges")).alias("__ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"))
    joined = numbered.join(every, "__row", "left").drop("__row")

    def run(batches):
        for batch in batches:
            ranges, items = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__ranges", "__items"))
            rest = batch.select([c for c in batch.schema.names if c not in ("__ranges", "__items")])

            def found(lo: int, words: Words, d: int):
                for doc in range(d):
                    for r in ranges[lo + doc] or []:
                        yield doc, int(words.first[doc]) + r["lo"], int(words.first[doc]) + r["hi"], ()
                    yield doc, 0, -1, items[lo + doc] or []

            yield from _judged(rest, found, id_type)

    return map_arrow(joined, run, _schema(docs, id_type))


def _schema(docs: DataFrame, id_type):
    return docs.limit(0).select("*", F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"),
                                F.array(F.lit(None).cast(id_type)).alias("items"),
                                F.expr("array(named_struct('start', 0, 'end', 0))").alias("spans")).schema


def _sent(shard: DataFrame):
    """The items of a shard, which holds about ``MAX_ITEM_WORDS`` words, as a broadcast."""
    return shard.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in shard.collect()])


def _scanned(docs: DataFrame, shard: DataFrame, window: int, id_type) -> DataFrame:
    items, job = _sent(shard), uuid.uuid4().hex

    def run(batches):
        for batch in batches:
            yield from _judged(batch, lambda lo, words, d: _matcher(job, items, window).scan(words), id_type)

    return map_arrow(docs, run, _schema(docs, id_type))


def _hits(rows: DataFrame, shard: DataFrame, window: int, id_type) -> DataFrame:
    """(__row, ranges of words, item ids) of the texts that one shard's automaton finds anything in."""
    sent, job = _sent(shard), uuid.uuid4().hex
    item_list = pa.list_(to_arrow_type(id_type))
    range_list = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches):
        for batch in batches:
            for lo, data, off in blocks(text_column(batch)):
                words = Words(LOWER[data], off, ALNUM_WORD)
                ranges: dict[int, list] = {}
                items: dict[int, set] = {}
                for doc, first, last, owners in _matcher(job, sent, window).scan(words):
                    start = int(words.first[doc])
                    ranges.setdefault(doc, []).append({"lo": first - start, "hi": last - start})
                    items.setdefault(doc, set()).update(owners)
                at = sorted(ranges)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + d for d in at], pa.int64())),
                                                  pa.array([ranges[d] for d in at], range_list), pa.array([sorted(items[d]) for d in at], item_list)],
                                                 names=["__row", "ranges", "items"])

    return map_arrow(rows, run, f"__row bigint, ranges array<struct<lo:bigint,hi:bigint>>, items array<{id_type.simpleString()}>")


def _judged(batch: pa.RecordBatch, find, id_type):
    """The batch with ``OUTPUT``; ``find`` gives (document, first word, last word, item ids) of a block of texts."""
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    n_words, n_hit, items, spans = [], [], [], []
    for row, data, off in blocks(text_column(batch)):
        words = Words(LOWER[data], off, ALNUM_WORD)
        d = len(off) - 1
        change = np.zeros(len(words.starts) + 1, np.int64)
        found: list[set] = [set() for _ in range(d)]
        for doc, lo, hi, owners in find(row, words, d):
            change[lo] += 1
            change[hi + 1] -= 1
            found[doc].update(owners)
        hit = np.cumsum(change[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        n_words.append(words.count)
        n_hit.append(total[words.first[1:]] - total[words.first[:-1]])
        items += [sorted(f) for f in found]
        spans += _spans(words, hit, data, off)
    if n_words:
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.concatenate(n_words).astype(np.int64)),
             pa.array(np.concatenate(n_hit).astype(np.int64)), pa.array(items, pa.list_(to_arrow_type(id_type))),
             pa.array(spans, span_type)], names=[*batch.schema.names, *OUTPUT])


def _spans(words: Words, hit: np.ndarray, data: np.ndarray, off: np.ndarray) -> list[list[dict]]:
    """Character ranges of runs of hit words, per document."""
    out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
    if hit.any():
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        same = np.concatenate([[False], hit[:-1] & (words.doc[:-1] == words.doc[1:])])
        first = np.flatnonzero(hit & ~same)
        last = np.flatnonzero(hit & ~np.concatenate([same[1:] & hit[1:], [False]]))
        for a, b in zip(first.tolist(), last.tolist()):
            doc = int(words.doc[a])
            base = chars[off[doc]]
            out[doc].append({"start": int(chars[words.starts[a]] - base), "end": int(chars[words.ends[b]] - base)})
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, unchanged."""
    inner, moved = shielded(docs, OUTPUT)
    return restored(find_leaks(inner, benchmark).where("n_hit = 0"), docs.columns, moved)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    listed = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS pattern, least(len(w), 10) AS size
  FROM item_words, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS pattern
  FROM lowered, sizes, unnest(generate_series(1, len(w) - size + 1)) AS g(k)),
hits AS (SELECT g.doc_id, g.k, g.size, w.item_id FROM grams g JOIN windows w USING (pattern, size)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT l.doc_id, len(l.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
