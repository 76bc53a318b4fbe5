"""MinHash near-dedup (1): a multi-index Hamming join over b-bit signatures.

Documents are sets of five-word shingles.  Two are linked if the Jaccard similarity
of their sets is at least 0.75; a component of linked documents is one group.

1. ``sketch`` reads each text once: size and 128-bit address of the shingle set, and
   ``SYMBOLS`` min-hashes.  Documents with equal sets form one class, a graph node.
2. Multi-index: the first ``CHUNKS * CHUNK`` symbols (16 bits each) are split into
   ``CHUNKS`` chunks.  By the pigeonhole principle a pair within
   ``CHUNKS * (ERRORS + 1) - 1`` differing symbols has a chunk with at most ``ERRORS``
   differing symbols, so every chunk is indexed under each way to leave ``ERRORS``
   symbols out.  The guarantee holds up to 23 differing symbols of 48; a pair with similarity 0.75 is beyond
   that with a probability of 1.7e-4, and then still found unless each chunk has two errors or more: it is missed with about 1e-7.
3. Links, without all pairs of a bucket:
   a. each bucket's members are checked against one of them, the one whose buckets hold most, and
      components are built;
   b. buckets that still hold several components: up to ``SMALL`` members, all pairs of
      different components; more members, the pairs that share a rare shingle.  For a
      pair of sets with similarity 0.75 the rarest 1/7 of the smaller and 1/4 of the larger set
      must meet (prefix filter), with position and size bounds, so no link is lost; the component
      that holds most rows of a shingle is not paired with itself.
   Pairs are first compared by ``SYMBOLS`` 8-bit symbols (at most ``MAX_DIFFERENT`` may
   differ), then confirmed on their full sets, recomputed from the texts.

Defined results.  Null or empty text, or no word: empty set, linked with nothing; its
component is its own id.  Fewer than five words: one shingle.  Repeated ids are rows of their
own.  A component of rows with null ids only has a null id.  Empty table: empty result.
Extra columns are left alone.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.components import connected
from tidemark.llm.tables import map_arrow, restored, shielded, table, written
from tidemark.llm.text import LOWER, Words, blocks, mix64, range_hash, text_column, word_sums

SHINGLE = 5
# similarity at least SHARE / WHOLE
SHARE, WHOLE = 75, 100
SYMBOLS = 128
CHUNKS, CHUNK, ERRORS = 12, 4, 1
# of SYMBOLS symbols: at similarity 0.75 the mean is 32 and the deviation 4.9
MAX_DIFFERENT = 60
SMALL = 16

_rng = np.random.default_rng(7)
FACTORS = _rng.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
MASKS = list(combinations(range(CHUNK), CHUNK - ERRORS))
CLASS = ["n_shingles", "f1", "f2"]


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first index of each document and the total) of the distinct shingles."""
    words = Words(LOWER[data], off)
    lo = np.arange(len(words.starts))
    left = words.first[1:][words.doc] - lo                      # words from here to the document's end
    whole = (left >= SHINGLE) | (lo == words.first[:-1][words.doc])
    lo = lo[whole]
    g = range_hash(word_sums(words.hashes()), lo, lo + np.minimum(left[whole], SHINGLE))
    doc = words.doc[whole]
    key = (doc.astype(np.uint64) << np.uint64(42)) | (g >> np.uint64(22))
    order = np.argsort(key, kind="stable")
    if (np.diff(key[order]) == 0).any():        # repeats, or hashes that differ in their last bits only
        order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[fresh], doc[fresh]
    return g, np.searchsorted(doc, np.arange(len(off)))


def _folded(ufunc, values: np.ndarray, first: np.ndarray, empty):
    """``ufunc.reduceat`` per document, ``empty`` for documents without values."""
    out = np.full(len(first) - 1, empty, values.dtype)
    has = first[1:] > first[:-1]
    if has.any():
        out[has] = ufunc.reduceat(values, first[:-1][has])
    return out


def _address(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = _folded(np.add, mix64(g), first, 0)
    two = _folded(np.add, mix64(g ^ np.uint64(0x5851F42D4C957F2D)), first, 0)
    return one.view(np.int64), two.view(np.int64)


def _signature(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, SYMBOLS) 16-bit symbols."""
    h = (mix64(g) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, SYMBOLS), np.uint16)
    for j in range(SYMBOLS):
        low = _folded(np.minimum, h * FACTORS[j] + SHIFTS[j], first, 0)
        out[:, j] = mix64(low.astype(np.uint64) + np.uint64(j << 40)) >> np.uint64(48)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a 2-d array as one binary value."""
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize
    off = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32) if n else np.zeros(1, np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, off, pa.py_buffer(np.ascontiguousarray(rows))])


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (address of the set), index symbols and 8-bit symbols."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, data, off in blocks(text_column(batch)):
                g, first = shingle_sets(data, off)
                sig = _signature(g, first)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(off) - 1), pa.array(np.diff(first).astype(np.int64)),
                     *map(pa.array, _address(g, first)), _binary(sig[:, :CHUNKS * CHUNK]), _binary(sig.astype(np.uint8))],
                    names=["doc_id", *CLASS, "symbols", "bytes"])

    return map_arrow(docs.select("doc_id", "text"), run,
                     f"doc_id {kind}, n_shingles bigint, f1 bigint, f2 bigint, symbols binary, bytes binary")


def _index(classes: DataFrame) -> DataFrame:
    """(key, node): every chunk under every choice of its symbols, packed into one number."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, CHUNKS, CHUNK).astype(np.int64)
            keys = []
            for m, mask in enumerate(MASKS):
                packed = np.zeros((n, CHUNKS), np.int64)
                for s in mask:
                    packed = (packed << 16) | sig[:, :, s]
                keys.append(packed | ((np.arange(CHUNKS) * len(MASKS) + m) << (16 * len(mask))))
            nodes = np.tile(batch.column(0).to_numpy(), CHUNKS * len(MASKS))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k.T.ravel() for k in keys])), pa.array(nodes)],
                                             names=["key", "node"])

    return map_arrow(classes.select("node", "symbols"), run, "key bigint, node bigint")


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose 8-bit symbols differ in at most MAX_DIFFERENT places and whose sizes allow the similarity."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SYMBOLS) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x != y).sum(axis=1) <= MAX_DIFFERENT))

    side = lambda c: classes.select(F.col("node").alias(c), F.col("bytes").alias(f"{c}_bytes"),      # noqa: E731
                                    F.col("n_shingles").alias(f"{c}_n"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = f"{WHOLE} * least(a_n, b_n) >= {SHARE} * greatest(a_n, b_n)"
    return map_arrow(both.where(fits).select("a", "b", "a_bytes", "b_bytes"), run, "a bigint, b bigint")


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed): one compressed text of each wanted class."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            col = text_column(batch)
            for lo, data, off in blocks(col):
                g, first = shingle_sets(data, off)
                has = np.diff(first) > 0
                raw = data.tobytes()
                packed = [pack.compress(raw[a:b]) for a, b in zip(off[:-1][has].tolist(), off[1:][has].tolist())]
                f1, f2 = _address(g, first)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(first)[has].astype(np.int64)), pa.array(f1[has]),
                                                  pa.array(f2[has]), pa.array(packed, pa.binary())], names=[*CLASS, "packed"])

    texts = map_arrow(docs.select("text"), run, "n_shingles bigint, f1 bigint, f2 bigint, packed binary")
    wanted = classes.select("node", *CLASS).join(nodes, "node", "left_semi")
    return texts.join(wanted, CLASS).groupBy("node").agg(F.first("packed").alias("packed"))


def _unpacked(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    parts = [unpack.decompress(v) for v in values]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), off


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                node = part.column(1).to_numpy()
                run_no = np.cumsum(np.concatenate([[0], node[1:] != node[:-1]]))        # rows come sorted by b
                packed = part.column(3)
                g, first = shingle_sets(*_unpacked([packed[int(i)].as_py() for i in np.searchsorted(run_no, range(run_no[-1] + 1))]))
                h, begin = shingle_sets(*_unpacked(part.column(2).to_pylist()))
                keep = []
                for i, r in enumerate(run_no):
                    x, y = g[first[r]:first[r + 1]], h[begin[i]:begin[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(WHOLE * both >= SHARE * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(keep))

    side = lambda c: texts.select(F.col("node").alias(c), F.col("packed").alias(f"{c}_packed"))      # noqa: E731
    both = pairs.join(side("a"), "a").join(side("b"), "b").sortWithinPartitions("b")
    return map_arrow(both.select("a", "b", "a_packed", "b_packed"), run, "a bigint, b bigint")


def _shared_rare(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components among ``texts`` (node, packed) that share a shingle of their prefixes."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                g, first = shingle_sets(*_unpacked(part.column(1).to_pylist()))
                size = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), size)), pa.array(np.repeat(size, size)),
                     pa.array(g.view(np.int64))], names=["node", "n", "g"])

    sets = map_arrow(texts.select("node", "packed"), run, "node bigint, n bigint, g bigint")
    often = sets.groupBy("g").agg(F.count("*").alias("f")).where("f > 1")
    mine = Window.partitionBy("node")
    # place of a shingle in its set, rarest first; shingles of one set only come before all others
    place = (F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("f", "g")))
    placed = sets.join(often, "g").withColumn("place", place).withColumn("room", F.col("n") - F.col("place") + 1)
    # a pair with similarity >= 3/4 shares at least 3/7 of its summed sizes; the partner's size is bounded by the room left
    most = F.floor(F.col("room") * 7 / 3) - F.col("n")
    rows = written(placed.withColumn("most", most).where("4 * most >= 3 * n").join(labels, "node")
                   .select("g", "node", "n", "most", "label"), "near-prefix")
    by_label = rows.groupBy("g", "label").agg(F.count("*").alias("c"))
    mixed = (by_label.groupBy("g").agg(F.max(F.struct("c", "label")).alias("main"), F.count("*").alias("kinds"))
             .where("kinds > 1").select("g", F.col("main.label").alias("main")))
    open_rows = rows.join(mixed, "g")
    x, y = open_rows.where("label <> main").alias("x"), open_rows.alias("y")
    near = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.label") != F.col("y.label"))
                  & (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most")))
    return near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def group(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (n_shingles, f1, f2: the address of a shingle set; label: its component;
    component_id: the smallest doc_id in it) and the sketches of all rows, with their addresses."""
    sketches = written(sketch(docs), "near-sketch")
    classes = (sketches.where("n_shingles > 0").groupBy(*CLASS)
               .agg(F.min("doc_id").alias("rep"), F.first("symbols").alias("symbols"), F.first("bytes").alias("bytes"))
               .withColumn("node", F.monotonically_increasing_id()))
    classes = written(classes, "near-classes")
    index = _index(classes)
    buckets = index.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = written(index.join(buckets, "key"), "near-buckets")
    # a bucket's lead is the member whose buckets hold most: in a group of edited copies, one close to the original
    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    leads = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("lead"))
    members = written(members.join(leads, "key"), "near-members")

    stars = (members.where("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
             .distinct())
    stars = written(_close(stars, classes), "near-stars")
    nodes = lambda p: p.select(F.col("a").alias("node")).unionByName(p.select(F.col("b").alias("node"))).distinct()     # noqa: E731
    first = written(_confirmed(stars, _texts(docs, classes, nodes(stars))), "near-links")
    labels = connected(first)

    # buckets that still hold more than one component
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    left = written(labelled.join(split.select("key"), "key", "left_semi"), "near-open")
    few = left.where((F.col("members") <= SMALL) & (F.col("node") != F.col("lead")))
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))
                   & (F.col("x.label") != F.col("y.label"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    many = left.where(F.col("members") > SMALL).select("node", "label").distinct()
    pairs = written(_close(pairs, classes), "near-pairs")
    texts = written(_texts(docs, classes, nodes(pairs).unionByName(many.select("node")).distinct()), "near-texts")
    rare = _shared_rare(texts.join(many.select("node"), "node", "left_semi"), many)
    pairs = pairs.unionByName(written(_close(rare, classes), "near-rare")).distinct()
    second = _confirmed(pairs, texts)
    labels = connected(first.unionByName(second))

    all_nodes = classes.select("node", "rep", *CLASS).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    reps = all_nodes.groupBy("label").agg(F.min("rep").alias("component_id"))
    return written(all_nodes.drop("rep").join(reps, "label"), "near-groups"), sketches


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    groups, sketches = group(docs)
    found = sketches.select("doc_id", *CLASS).join(groups.select(*CLASS, "component_id", "label"), CLASS, "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"),
                        F.col("doc_id").eqNullSafe(own).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id. Rows without a word all stay."""
    inner, moved = shielded(docs, [*CLASS, "label", "component_id"])
    groups, _ = group(inner)
    names = inner.columns

    def run(batches):
        for batch in batches:
            sizes, one, two = [], [], []
            for _, data, off in blocks(text_column(batch)):
                g, first = shingle_sets(data, off)
                sizes.append(np.diff(first).astype(np.int64))
                f1, f2 = _address(g, first)
                one.append(f1), two.append(f2)
            if sizes:
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.concatenate(v)) for v in (sizes, one, two)]],
                                                 names=[*batch.schema.names, *CLASS])

    addressed = map_arrow(inner, run, inner.selectExpr("*", "0L as n_shingles", "0L as f1", "0L as f2").schema)
    rows = addressed.join(groups.select(*CLASS, "label", "component_id"), CLASS, "left")
    smallest = rows.where((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id")))
    # labels are not negative; rows without a word are groups of their own
    own = F.when(F.col("n_shingles") == 0, -1 - F.monotonically_increasing_id()).otherwise(F.col("label"))
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    once = smallest.select(own.alias("label"), row.alias("row")).groupBy("label").agg(F.first("row").alias("row"))
    return restored(once.select("row.*"), docs.columns, moved)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_SETS = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s
  FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS g(k) WHERE len(w) > 0),
sizes AS (SELECT w.doc_id, count(s) AS n FROM words w LEFT JOIN shingles USING (doc_id) GROUP BY w.doc_id)"""

ORACLE_SQL = f"""{_SETS.replace('WITH words', 'WITH RECURSIVE words')},
numbered AS (SELECT s.doc_id, s.s, n FROM shingles s JOIN sizes USING (doc_id)),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 75 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sizes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a)
SELECT s.doc_id, s.n AS n_shingles, min(seen) AS component_id, s.doc_id = min(seen) AS kept
FROM sizes s JOIN reach r ON s.doc_id = r.node GROUP BY s.doc_id, s.n
"""
