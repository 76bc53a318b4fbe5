"""Suffix-array dedup (3): bytes covered by a ``LENGTH``-byte string that also starts elsewhere.

Prefix-free parsing, cut to what a fixed length needs:

1. Parsing.  A rolling hash over ``GRAM`` bytes triggers phrase starts: the smallest hash among
   the first ``REACH`` places of each ``LENGTH``-byte string (``anchors.py``).  The trigger looks at
   the string alone, so equal strings are cut at equal places, and every string is
   a phrase suffix (its bytes before the trigger, fewer than ``REACH``) followed by a parse suffix
   (from the trigger on, at least ``CORE`` bytes).
2. Names.  Parse suffixes meet by the name (hash) of their first ``CORE`` bytes, with the
   address of everything their strings can hold.  Equal addresses are repeats at once; in
   highly repetitive text that settles nearly all.  Repeats inside a block of texts
   are settled there, so a passage that a third of all documents hold is a row a block.
3. Suffix arrays.  Where a name has different surroundings (the ends of repeats), the bytes are
   fetched, and two tables are put in order by Spark's range sort: the dictionary, the phrase suffixes read
   from the trigger to the left, and the parse, the parse suffixes read from the core to the right
   (``_ranked``).  Each row gets the common prefix with its neighbour, and from these its ranks: for
   every length the place in the order at which the run of rows that share so many bytes begins.
   A run may go on over many tasks; only the first and last row of each task meet on the
   driver (``_head_ranks``), to say where it began.
   Combined, the two ranks order the corpus: two strings with o bytes before the trigger are equal exactly
   if their dictionary ranks at o and their parse ranks at LENGTH - CORE - o are (``_strings``).
   A name with any number of surroundings is spread over as many tasks as its rows need.
4. The covered bytes are removed from the texts.

Strings are judged on the input; matches never cross documents.

Defined results.  Null text: the empty string of bytes.  Repeated or null ids: each row is
a document of its own.  Texts under 400 bytes are kept whole.  Empty table: empty result.
Extra columns are left alone.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.anchors import count_of, identified, pack, start_of, unpack, window_anchors
from tidemark.llm.tables import map_arrow, table, written
from tidemark.llm.text import BYTE_TABLE, blocks, mix64, range_hash, raw, text_column, word_sums

LENGTH = 400
REACH = 128
GRAM = 16
CORE = LENGTH - REACH + 1
# rows ranked at a time in a task; their ranks take about 1 KB a row
RANKED = 4096
PLACES = 1 << 32        # a rank is the task's number times this and the place in the task
O_BITS = 7              # below it, the length of the shared prefix: REACH values
NO_BYTE = 0xFF          # never in UTF-8


def parse(docs: DataFrame) -> DataFrame:
    """(name, address, d, place, twice) of each trigger; twice: its strings are known to be repeated."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first_row, data, off in blocks(text_column(batch)):
                n = len(data)
                if n < LENGTH:
                    continue
                sums = word_sums(BYTE_TABLE[data])
                order = np.full(n, 2**64 - 1, np.uint64)
                at = np.arange(n - GRAM + 1)
                order[: n - GRAM + 1] = range_hash(sums, at, at + GRAM)
                doc, anchor, s, e = window_anchors(order, off, LENGTH, REACH)
                if not len(doc):
                    continue
                name = range_hash(sums, anchor, anchor + CORE)
                address = mix64(range_hash(sums, s, e + LENGTH) + (anchor - s).astype(np.uint64))
                d, place = ids[first_row + doc], pack(s - off[doc], e - s + 1, anchor - s)
                _, first, inverse, count = np.unique(mix64(name) + address, return_index=True, return_inverse=True, return_counts=True)
                twice = count[inverse] > 1
                settled = twice & (first[inverse] != np.arange(len(name)))
                # settled rows meet nobody: their name is their own coordinate
                name = np.where(settled, mix64(mix64(d.astype(np.uint64)) + place.astype(np.uint64)), name)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(address.view(np.int64)), pa.array(d),
                                                  pa.array(place), pa.array(twice)], names=["name", "address", "d", "place", "twice"])

    return map_arrow(docs.select("d", "text"), run, "name bigint, address bigint, d bigint, place bigint, twice boolean")


def _meet(rows: DataFrame) -> DataFrame:
    """Rows whose strings are repeated, or may be: (name, d, place, repeated, ask).

    ask: the row takes part in the sorting, as a single row or for all rows of its address."""
    at_name, at_address = Window.partitionBy("name"), Window.partitionBy("name", "address")
    met = rows.select("*", (F.min("address").over(at_name) != F.max("address").over(at_name)).alias("branch"),
                      (F.max("twice").over(at_address) | (F.count("*").over(at_address) > 1)).alias("repeated"),
                      F.row_number().over(at_address.orderBy("d", "place")).alias("r"))
    return (met.where("branch or repeated")
            .select("name", "d", "place", "repeated", (F.col("branch") & (F.col("r") == 1)).alias("ask")))


def _surroundings(docs: DataFrame, asks: DataFrame) -> DataFrame:
    """(name, d, place, single, left, right): the bytes before the trigger (the nearest first) and after the core,
    as far as the trigger's strings reach."""
    by_doc = asks.groupBy("d").agg(F.collect_list(F.struct("name", "place", (~F.col("repeated")).alias("single"))).alias("asks"))

    def run(batches):
        for batch in batches:
            asks, ids, texts = batch.column(1), batch.column(0).to_numpy(), batch.column(2)
            for i in range(batch.num_rows):
                data = texts[i].as_py().encode()
                part = asks.slice(i, 1).flatten()
                name, place, single = part.field(0), part.field(1).to_numpy(), part.field(2)
                start, count, offset = unpack(place)
                anchor = (start + offset).tolist()
                left = [data[s:a][::-1] for s, a in zip(start.tolist(), anchor)]
                right = [data[a + CORE:e] for a, e in zip(anchor, (start + count - 1 + LENGTH).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [name, pa.array(np.full(len(place), ids[i])), part.field(1), single, pa.array(left, pa.binary()),
                     pa.array(right, pa.binary())], names=["name", "d", "place", "single", "left", "right"])

    joined = docs.select("d", "text").join(by_doc, "d").select("d", "asks", "text")
    return map_arrow(joined, run, "name bigint, d bigint, place bigint, single boolean, left binary, right binary")


def _matrix(values: pa.Array) -> np.ndarray:
    """One padded row of REACH - 1 bytes for each value."""
    data, off = raw(values.cast(pa.large_binary()))
    length = np.diff(off)
    out = np.full((len(length), REACH - 1), NO_BYTE, np.uint8)
    out[np.repeat(np.arange(len(length)), length), np.arange(len(data)) - np.repeat(off[:-1], length)] = data
    return out


def _common(rows: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the one before."""
    same = rows == before
    return np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))


def _steps(ranks: np.ndarray) -> pa.Array:
    """Ranks of each row at 0 to REACH - 1 shared bytes, as a list of (rank, from which length on)."""
    opens = np.ones(ranks.shape, bool)
    opens[:, 1:] = ranks[:, 1:] != ranks[:, :-1]
    row, o = np.nonzero(opens)
    off = np.concatenate([[0], np.cumsum(opens.sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array((ranks[row, o] << O_BITS) | o))


def _ranks(steps: pa.ListArray) -> np.ndarray:
    """The inverse of ``_steps``."""
    n = len(steps)
    values = steps.flatten().to_numpy()
    row = np.repeat(np.arange(n), steps.value_lengths().to_numpy())
    o = values & ((1 << O_BITS) - 1)
    out, at = np.zeros((n, REACH), np.int64), np.zeros((n, REACH), np.int64)
    out[row, o], at[row, o] = values >> O_BITS, o
    return np.take_along_axis(out, np.maximum.accumulate(at, axis=1), axis=1)


def _ranked(rows: DataFrame, side: str) -> DataFrame:
    """``rows`` in the order of (name, side), with ``side`` replaced by ``side``_ranks (see ``_steps``) and
    ``side``_shared, the longest prefix that a neighbour may share.

    Each task adds a row without ``name``: its number as ``side``_shared, the ranks of its last row, and
    as ``edge`` its first and last rows' names and bytes."""
    others = [c for c in rows.columns if c not in ("name", side)]
    schema = ", ".join(["name bigint", *[f"`{c}` {t}" for c, t in rows.dtypes if c in others], f"{side}_ranks array<bigint>",
                        f"{side}_shared bigint", "edge binary"])
    names = ["name", *others, f"{side}_ranks", f"{side}_shared", "edge"]

    def run(batches):
        task = TaskContext.get().partitionId()
        at, head, name_before, row_before, ranks_before, kinds = task * PLACES, None, None, None, None, None
        for whole in batches:
            for i in range(0, whole.num_rows, RANKED):
                batch = whole.slice(i, RANKED)
                n, name, data = batch.num_rows, batch.column(0).to_numpy(), _matrix(batch.column(1))
                if head is None:
                    head, name_before, row_before, ranks_before = (name[0].tobytes() + data[0].tobytes(), name[0], data[0],
                                                                   np.full(REACH, at))
                    kinds = [c.type for c in batch.columns[2:]]
                same_name = name == np.concatenate([[name_before], name[:-1]])
                common = np.where(same_name, _common(data, np.concatenate([row_before[None], data[:-1]])), -1)
                place = at + np.arange(n)
                ranks = np.where(common[:, None] < np.arange(REACH), place[:, None], -1)
                ranks[0] = np.where(ranks[0] < 0, ranks_before, ranks[0])
                ranks = np.maximum.accumulate(ranks, axis=0)
                # what lies beyond the chunk may share everything
                shared = np.maximum(np.where(np.arange(n) == 0, REACH - 1, common), np.append(common[1:], REACH - 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], _steps(ranks), pa.array(shared), pa.nulls(n, pa.binary())],
                                                 names=names)
                at, name_before, row_before, ranks_before = at + n, name[-1], data[-1], ranks[-1]
        if head is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), *[pa.nulls(1, t) for t in kinds], _steps(ranks_before[None]), pa.array([task]),
                 pa.array([head + name_before.tobytes() + row_before.tobytes()], pa.binary())], names=names)

    keys = ["name", side, "d", "place"]
    ordered = rows.select("name", side, *others).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(map_arrow(ordered, run, schema), f"suffix-{side}")


def _head_ranks(ranked: DataFrame, side: str) -> tuple[np.ndarray, np.ndarray]:
    """(tasks, ranks): for each task the true ranks of the runs that its first row is in, which may have begun
    in an earlier task.  One row a task comes to the driver."""
    edges = ranked.where("edge is not null").select(f"{side}_shared", "edge", f"{side}_ranks").collect()
    tasks, heads, before, ranks_before = [], [], None, None
    for task, edge, steps in sorted((r[0], bytes(r[1]), r[2]) for r in edges):
        head, tail = (np.frombuffer(part, np.uint8) for part in (edge[:len(edge) // 2], edge[len(edge) // 2:]))
        ranks = np.full(REACH, task * PLACES)
        if before is not None and (before[:8] == head[:8]).all():
            shared = int(_common(head[None, 8:], before[None, 8:])[0])
            ranks[:shared + 1] = ranks_before[:shared + 1]
        last = _ranks(pa.array([steps], pa.list_(pa.int64())))[0]
        before, ranks_before = tail, np.where(last == task * PLACES, ranks, last)
        tasks.append(task)
        heads.append(ranks)
    return np.array(tasks, np.int64), np.array(heads, np.int64).reshape(-1, REACH)


def _true(ranks: np.ndarray, o: np.ndarray, heads: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ranks at ``o`` shared bytes, those of a task's first run replaced by where the run began."""
    first = np.flatnonzero(ranks % PLACES == 0)
    tasks, known = heads
    out = ranks.copy()
    out[first] = known[np.searchsorted(tasks, ranks[first] // PLACES), o[first]]
    return out


def _strings(order: DataFrame, left_heads, right_heads) -> DataFrame:
    """(dictionary, parse, d, lo, single) of every string that shares its bytes on either side with
    some neighbour: the ranks of its two halves, equal for equal strings alone."""
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, RANKED):
                batch = whole.slice(i, RANKED)
                d, place, left_shared, right_shared = (batch.column(k).to_numpy() for k in (0, 1, 4, 6))
                start, count, offset = unpack(place)
                low = np.maximum(offset - count + 1, REACH - 1 - right_shared)
                high = np.minimum(offset, left_shared)
                n = np.maximum(high - low + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                o = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                dictionary = _true(_ranks(batch.column(3))[row, o], o, left_heads)
                parsed = _true(_ranks(batch.column(5))[row, REACH - 1 - o], REACH - 1 - o, right_heads)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((dictionary << O_BITS) | o), pa.array(parsed), pa.array(d[row]),
                     pa.array((start + offset)[row] - o), batch.column(2).take(pa.array(row))],
                    names=["dictionary", "parse", "d", "lo", "single"])

    columns = ["d", "place", "single", "left_ranks", "left_shared", "right_ranks", "right_shared"]
    return map_arrow(order.where("edge is null").select(*columns), run,
                     "dictionary bigint, parse bigint, d bigint, lo bigint, single boolean")


def ranked_spans(around: DataFrame) -> DataFrame:
    """(d, lo, hi) of the strings of single rows that have an equal one, by their ranks in dictionary and parse."""
    dictionary = _ranked(around, "left")
    order = _ranked(dictionary.where("edge is null").drop("edge"), "right")
    strings = _strings(order, _head_ranks(dictionary, "left"), _head_ranks(order, "right"))
    often = strings.groupBy("dictionary", "parse").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    found = strings.where("single").join(often, ["dictionary", "parse"], "left_semi")
    return found.select("d", "lo", (F.col("lo") + LENGTH).alias("hi"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, lo, hi): byte ranges covered by repeated strings. ``docs`` as from ``identified``."""
    met = written(_meet(parse(docs)), "suffix-met")
    plain = met.where("repeated").select("d", start_of("place").alias("lo"),
                                         (start_of("place") + count_of("place") - 1 + LENGTH).alias("hi"))
    around = written(_surroundings(docs, met.where("ask")), "suffix-around")
    return plain.unionByName(ranked_spans(around))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) and removed (byte ranges) of every row."""
    docs = identified(docs)
    spans = repeated_spans(docs).groupBy("d").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    kind = dict(docs.dtypes)["doc_id"]
    span_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches):
        for batch in batches:
            asked = batch.column(1)
            n_bytes, n_removed, kept, ranges = [], [], [], []
            for first, data, off in blocks(text_column(batch)):
                n = len(off) - 1
                part = asked.slice(first, n)
                doc = np.repeat(np.arange(n), np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
                flat = part.flatten()
                lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                at = np.searchsorted(doc, np.arange(n + 1))
                text = data.tobytes()
                for i in range(n):
                    own = text[off[i]:off[i + 1]]
                    n_bytes.append(len(own))
                    runs = _merged(lo[at[i]:at[i + 1]], hi[at[i]:at[i + 1]])
                    n_removed.append(sum(b - a for a, b in runs))
                    if runs:
                        edge = [0, *[x for r in runs for x in r], len(own)]
                        own = b"".join([own[a:b] for a, b in zip(edge[::2], edge[1::2])])
                    kept.append(own)
                    ranges.append([{"lo": a, "hi": b} for a, b in runs])
            if n_bytes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array([len(r) for r in ranges], pa.int64()), pa.array(kept, pa.binary()), pa.array(ranges, span_type)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])

    joined = docs.join(spans, "d", "left").select("doc_id", "spans", "text")
    return map_arrow(joined, run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, "
                                  "removed array<struct<lo:bigint,hi:bigint>>")


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    opens = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
    return list(zip(lo[opens].tolist(), reach[np.append(opens[1:], len(lo)) - 1].tolist()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
strings AS (SELECT doc_id, k, md5(t[k : k + {LENGTH - 1}]) AS h
            FROM (SELECT doc_id, t, unnest(generate_series(1, octet_length(t) - {LENGTH - 1})) AS k FROM texts)),
often AS (SELECT doc_id, k FROM strings WHERE h IN (SELECT h FROM strings GROUP BY h HAVING count(*) > 1)),
opened AS (SELECT doc_id, k, coalesce(k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + {LENGTH}, true) AS opens FROM often),
runs AS (SELECT doc_id, k, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM opened),
spans AS (SELECT doc_id, run, min(k) AS lo, max(k) + {LENGTH} AS hi FROM runs GROUP BY doc_id, run),
pieces AS (SELECT doc_id, run, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY run), 1) AS a, lo - 1 AS b, hi FROM spans),
kept AS (
  SELECT p.doc_id, string_agg(CASE WHEN b >= a THEN hex(t[a : b]) ELSE '' END, '' ORDER BY run)
                   || CASE WHEN max(hi) <= any_value(octet_length(t)) THEN hex(any_value(t)[max(hi) : octet_length(any_value(t))]) ELSE '' END AS kept
  FROM pieces p JOIN texts USING (doc_id) GROUP BY p.doc_id),
sums AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN kept IS NULL THEN sha256(t) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
