"""Substring dedup (2): words in long spans that an earlier place of the corpus has too.

A sparse de Bruijn graph over token k-mers.  Its edges are the word runs around
anchors (``anchors.py``): each holds 1 to ``REACH`` consecutive windows of ``WINDOW`` words, and
every window of every document lies in exactly one.

1. ``edges`` reads each text once and emits (node, edge, coordinate) for each anchor:
   the hash of the anchor's k-mer and of the whole run.  Repeats inside a block of texts
   are resolved there (their source is the block's first), so a passage that a third of all
   documents hold is a row a block.
2. Rows meet by node.  All occurrences of an edge but the first of the corpus point to
   that first one: their source coordinate.  A node with one edge does not branch.
   Where a node branches, the first occurrences of its edges are looked into again,
   window by window, in step 4.
3. Compaction: consecutive edges of a document whose sources are consecutive too are one
   path (a maximal span with one source).  Paths are verified by their source coordinates: the
   texts are joined once, and a second hash of the span's words at either place must agree.
4. The same join yields the windows of branching edges; equal windows meet, and all but the
   first point back.
5. The spans are joined to the texts, and covered words are removed.

Windows are judged on the input, so removals don't influence each other.

Defined results.  Null text: no words.  Texts under 20 words: no windows, kept whole.
Repeated or null ids: see ``anchors.identified``.  Empty table: empty result.  Extra
columns are left alone.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.anchors import count_of, identified, pack, start_of, unpack, window_anchors
from tidemark.llm.tables import map_arrow, table, written
from tidemark.llm.text import Words, blocks, mix64, range_hash, text_column, word_sums

WINDOW = 20
K = 6
REACH = WINDOW - K + 1


def _gram_order(sums: np.ndarray, n: int, k: int) -> np.ndarray:
    """Hash of the k units from each position (the last positions have none, and lose)."""
    out = np.full(n, 2**64 - 1, np.uint64)
    if n >= k:
        lo = np.arange(n - k + 1)
        out[: n - k + 1] = range_hash(sums, lo, lo + k)
    return out


def _local_sources(node, edge, d, place):
    """For each row the index of the block's first row of the same edge (itself for the first)."""
    order = np.lexsort((place, d, edge, node))
    same = (node[order][1:] == node[order][:-1]) & (edge[order][1:] == edge[order][:-1])
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    source = np.empty(len(order), np.int64)
    source[order] = order[heads][np.cumsum(np.concatenate([[True], ~same])) - 1]
    return source


def edges(docs: DataFrame) -> DataFrame:
    """(node, edge, d, place, src_d, src_place) of each anchor; sources only where the block has one."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, data, off in blocks(text_column(batch)):
                words = Words(data, off)
                sums = word_sums(words.hashes())
                doc, anchor, s, e = window_anchors(_gram_order(sums, len(words.starts), K), words.first, WINDOW, REACH)
                if not len(doc):
                    continue
                node = range_hash(sums, anchor, anchor + K)
                edge = mix64(range_hash(sums, s, e + WINDOW) + (anchor - s).astype(np.uint64))
                d, place = ids[lo + doc], pack(s - words.first[doc], e - s + 1, anchor - s)
                source = _local_sources(node, edge, d, place)
                known = source != np.arange(len(source))
                # settled rows meet nobody: their node is their own coordinate
                node = np.where(known, mix64(mix64(d.astype(np.uint64)) + place.astype(np.uint64)), node)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), pa.array(edge.view(np.int64)), pa.array(d), pa.array(place),
                     pa.array(d[source], mask=~known), pa.array(place[source], mask=~known)],
                    names=["node", "edge", "d", "place", "src_d", "src_place"])

    return map_arrow(docs.select("d", "text"), run,
                     "node bigint, edge bigint, d bigint, place bigint, src_d bigint, src_place bigint")


def _meet(rows: DataFrame) -> DataFrame:
    """Rows whose node is repeated, with their edge's first coordinate, and whether the node branches."""
    at_node, at_edge = Window.partitionBy("node"), Window.partitionBy("node", "edge").orderBy("d", "place")
    met = rows.select("*", F.count("*").over(at_node).alias("n"),
                      (F.min("edge").over(at_node) != F.max("edge").over(at_node)).alias("branch"))
    met = met.where("n > 1 or src_d is not null")
    return met.select("d", "place", "branch", F.coalesce("src_d", F.first("d").over(at_edge)).alias("src_d"),
                      F.coalesce("src_place", F.first("place").over(at_edge)).alias("src_place"))


def _paths(repeats: DataFrame) -> DataFrame:
    """Compacted spans of windows: (d, lo, n, src_d, src_lo); lo is the first window, n their number."""
    s, src = start_of("place"), start_of("src_place")
    w = Window.partitionBy("d").orderBy("s")
    rows = repeats.select("d", s.alias("s"), count_of("place").alias("c"), "src_d", src.alias("src_s"))
    joins = ((F.lag(F.col("s") + F.col("c")).over(w) == F.col("s")) & (F.lag("src_d").over(w) == F.col("src_d"))
             & (F.lag(F.col("src_s") - F.col("s")).over(w) == F.col("src_s") - F.col("s")))
    rows = rows.withColumn("path", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    return rows.groupBy("d", "path").agg(F.min("s").alias("lo"), F.sum("c").alias("n"), F.first("src_d").alias("src_d"),
                                         F.min("src_s").alias("src_lo")).drop("path")


def _lookups(docs: DataFrame, paths: DataFrame, branches: DataFrame) -> DataFrame:
    """One pass over the texts that anything is asked of: (kind, d, lo, h).

    kind 0: the words of a path's target (d, lo); kind 1: the words at its source;
    kind 2: a window (d, lo) of a branching edge."""
    ask = "struct<kind:int,lo:bigint,n:bigint,to_d:bigint,to_lo:bigint>"
    asked = (paths.select("d", F.struct(F.lit(0), "lo", "n", "d", "lo").cast(ask).alias("ask"))
             .unionByName(paths.select(F.col("src_d").alias("d"), F.struct(F.lit(1), "src_lo", "n", "d", "lo").cast(ask).alias("ask")))
             .unionByName(branches.select("d", F.struct(F.lit(2), start_of("place"), count_of("place"), "d", F.lit(0)).cast(ask).alias("ask"))))
    by_doc = asked.groupBy("d").agg(F.collect_list("ask").alias("asks"))       # bounded by the document's length

    def run(batches):
        for batch in batches:
            asks = batch.column(1)
            for first, data, off in blocks(text_column(batch)):
                words = Words(data, off)
                h = words.hashes()
                sums, again = word_sums(h), word_sums(mix64(h ^ np.uint64(0x2545F4914F6CDD1D)))
                part = asks.slice(first, len(off) - 1)
                flat = part.flatten()
                doc = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                kind, lo, n, to_d, to_lo = (flat.field(k).to_numpy() for k in range(5))
                at = words.first[doc] + lo
                span = kind < 2
                hashed = range_hash(again, at[span], at[span] + n[span] + WINDOW - 1)
                yield _lookup_batch(kind[span], to_d[span], to_lo[span], hashed)
                w = ~span
                each = np.repeat(np.flatnonzero(w), n[w])
                step = np.arange(len(each)) - np.repeat(np.cumsum(n[w]) - n[w], n[w])
                begin = at[each] + step
                yield _lookup_batch(kind[each], to_d[each], lo[each] + step, range_hash(sums, begin, begin + WINDOW))

    joined = docs.select("d", "text").join(by_doc, "d")
    return map_arrow(joined.select("d", "asks", "text"), run, "kind int, d bigint, lo bigint, h bigint")


def _lookup_batch(kind, d, lo, h) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(d), pa.array(lo), pa.array(h.view(np.int64))],
                                      names=["kind", "d", "lo", "h"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, lo, n): runs of n windows from word lo that an earlier place has too. ``docs`` as from ``identified``."""
    met = written(_meet(edges(docs)), "repeats-met")
    first = (F.col("d") == F.col("src_d")) & (F.col("place") == F.col("src_place"))
    paths = written(_paths(met.where(~first)), "repeats-paths")
    found = written(_lookups(docs, paths, met.where(first & F.col("branch"))), "repeats-lookups")
    sides = found.where("kind < 2").groupBy("d", "lo").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("c"))
    agreed = paths.join(sides.where("a = b and c = 2"), ["d", "lo"], "left_semi").select("d", "lo", "n")
    meet = Window.partitionBy("h").orderBy("d", "lo")
    windows = found.where("kind = 2").select("d", "lo", F.row_number().over(meet).alias("r")).where("r > 1")
    return agreed.unionByName(windows.select("d", "lo", F.lit(1).cast("bigint").alias("n")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and removed
    (word ranges, end exclusive) of every row of ``docs``."""
    docs = identified(docs)
    spans = (repeated_spans(docs).groupBy("d")
             .agg(F.collect_list(F.struct("lo", (F.col("lo") + F.col("n") + WINDOW - 1).alias("hi"))).alias("spans")))
    kind = dict(docs.dtypes)["doc_id"]
    span_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches):
        for batch in batches:
            col = text_column(batch)
            asked = batch.column(1)
            n_words, removed, kept, ranges = [], [], [], []
            for first, data, off in blocks(col):
                words = Words(data, off)
                n = len(off) - 1
                part = asked.slice(first, n)
                change = np.zeros(len(words.starts) + 1, np.int64)
                flat = part.flatten()
                doc = np.repeat(np.arange(n), np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
                lo, hi = (words.first[doc] + flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                np.add.at(change, lo, 1)
                np.add.at(change, hi, -1)
                gone = np.cumsum(change[:-1]) > 0
                raw = data.tobytes()
                for i in range(n):
                    a, b = words.first[i], words.first[i + 1]
                    cut = gone[a:b]
                    if not cut.any():
                        kept.append(b" ".join(raw[off[i]:off[i + 1]].split()))
                        ranges.append([])
                    else:
                        left = np.flatnonzero(~cut) + a
                        kept.append(b" ".join([raw[x:y] for x, y in zip(words.starts[left].tolist(), words.ends[left].tolist())]))
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
                        ranges.append([{"lo": int(x), "hi": int(y)} for x, y in zip(turn[::2], turn[1::2])])
                    removed.append(int(cut.sum()))
                n_words.append(words.count)
            if n_words:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(n_words).astype(np.int64)), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()), pa.array(ranges, span_type)],
                    names=["doc_id", "n_words", "n_removed", "kept", "removed"])

    joined = docs.join(spans, "d", "left").select("doc_id", "spans", "text")
    return map_arrow(joined, run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, "
                                  "removed array<struct<lo:bigint,hi:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, k, array_to_string(w[k : k + 19], ' ') AS s FROM words, unnest(generate_series(1, len(w) - 19)) AS g(k)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 19)) AS p FROM later),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM each e ANTI JOIN gone USING (doc_id, p) GROUP BY e.doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
