"""Mixing sources to target weights (9): hash-seeded Poisson replication.

A source of size ``s`` (characters) with target weight ``w`` in a mix as large as
the input ``T`` has the mean repetition rate ``w * T / s``.  Each document's number of
copies is the inverse Poisson distribution at a uniform number hashed from the seed
and its id, so every retry and every partitioning gives the same copies.  The copies
are exploded and dealt out by a second hash, then ordered by it: a global shuffle.

* Sizes are one aggregation by source with partial sums; a hot source is one row a task.
* Each source's cumulative distribution is computed once, in the table of rates, and
  joined by source (broadcast if its rows are proven few, else a join that Spark can
  split); a document only counts the entries up to its number.
* A rate above ``STEP`` is the sum of independent draws of at most ``STEP`` each.

Defined results.  A null source is a source of its own.  Rows without an id of their own (null or repeated)
draw and are dealt by their id, contents and number among alike rows, so each draws for itself and none of them
gathers in a partition.  Null texts have size 0; a source of size 0
or without a weight has rate 0 and no copies.  Weights must not be negative and are
scaled to sum to 1.  Empty table: empty result.  Input columns named like an output
column give way to it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import table, written
from tidemark.operators.joins import join_checked

SEED = "mix-1"
TEMPERATURE = 0.5
STEP = 16.0
ENTRIES = 120       # of a distribution with mean <= STEP: what is beyond has a probability below 1e-40
OUTPUT = ["rate", "n_copies", "copy_no", "shuffle_key"]
MAX_SOURCES_SENT = 20_000       # rows of the rates table, about 1 KB each


def _hash48(*parts) -> F.Column:
    """An integer in [0, 2**48) from the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("bigint")


BLOCK = 4096        # alike rows are counted out in blocks of this many


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __key, what a row draws by: its id, or for a null or repeated one also its contents and its
    number among alike rows.

    Alike rows are one row with a count (partial sums absorb a hot one) and are counted out again, so no task
    sorts or numbers a group."""
    ids = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "mix-ids")
    own = F.col("doc_id").cast("string")
    if ids.isEmpty():
        return docs.withColumn("__key", own)
    some = docs.join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    alike = some.groupBy(*[F.col(f"`{c}`") for c in docs.columns]).agg(F.count("*").alias("__n"))
    block = alike.withColumn("__b", F.explode(F.expr(f"sequence(0, (__n - 1) div {BLOCK})")))
    each = block.withColumn("__i", F.explode(F.expr(f"sequence(__b * {BLOCK}, least(__n - 1, __b * {BLOCK} + {BLOCK - 1}))")))
    told = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"}))
    again = each.withColumn("__key", F.concat_ws(":", F.coalesce(own, F.lit("null")), told, F.col("__i").cast("string")))
    alone = docs.where("doc_id IS NOT NULL").join(ids, "doc_id", "left_anti").withColumn("__key", own)
    return alone.select(*[F.col(f"`{c}`") for c in docs.columns], "__key").unionByName(again.drop("__n", "__b", "__i"))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None,
                 temperature: float = TEMPERATURE) -> DataFrame:
    """source, size, rate, draws and the distribution of one draw. Without ``weights``
    the target weight of a source goes as its size to the power ``temperature``."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).cast("double").alias("size"))
    sizes = written(sizes, "mix-sizes")
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "key string, weight double")
        sizes = sizes.join(given, F.col("source").cast("string").eqNullSafe(F.col("key")), "left").drop("key")
    totals = sizes.agg(F.sum("size").alias("size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("weight")).first()
    all_size, all_weight = F.lit(totals["size"] or 0.0), F.lit(totals["weight"] or 0.0)      # two numbers
    rate = F.coalesce("weight", F.lit(0.0)) / all_weight * all_size / F.col("size")
    rates = (sizes.withColumn("rate", F.when((F.col("size") > 0) & (all_weight > 0), rate).otherwise(0.0))
             .withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP).cast("int"))))
    mean = F.col("rate") / F.col("draws")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(ENTRIES)), start, lambda s, k: F.struct(
        (s["p"] * mean / k).alias("p"),
        F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf")), lambda s: s["cdf"])
    return rates.select("source", "size", "rate", "draws", cdf.alias("cdf"))


def copies(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with rate and n_copies (not yet exploded)."""
    return _drawn(docs, rates, seed).drop("__key")


def _drawn(docs: DataFrame, rates: DataFrame, seed: str) -> DataFrame:
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUTPUT])
    keyed = _keyed(docs).withColumns({"__s": F.coalesce(F.col("source").cast("string"), F.lit("")), "__n": F.col("source").isNull()})
    small = rates.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__s"),
                         F.col("source").isNull().alias("__n"), "rate", "draws", "cdf")
    both = join_checked(keyed, small, ["__s", "__n"], "left", MAX_SOURCES_SENT)

    def draw(j):
        u = (_hash48(F.lit(seed), F.col("__key"), j.cast("string")) + 0.5) / float(2**48)
        return F.size(F.filter("cdf", lambda c: c <= u))

    n = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda a, j: a + draw(j))
    return both.withColumn("n_copies", n).drop("__s", "__n", "draws", "cdf")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE,
        seed: str = SEED) -> DataFrame:
    """Replicated and globally shuffled rows of ``docs``: their columns, rate, n_copies,
    copy_no (from 1) and shuffle_key, the order inside each partition."""
    counted = _drawn(docs, source_rates(docs, weights, temperature), seed).where("n_copies > 0")
    out = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = _hash48(F.lit(seed), F.lit("order"), F.col("__key"), F.col("copy_no").cast("string"))
    return out.withColumn("shuffle_key", key).drop("__key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.round("rate", 9))


ORACLE_SQL = f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN pow(size, {TEMPERATURE}) / sum(CASE WHEN size > 0 THEN pow(size, {TEMPERATURE}) END) OVER ()
                                         * sum(size) OVER () / size ELSE 0 END AS rate
  FROM sizes),
parts AS (SELECT source, rate, greatest(1, ceil(rate / {STEP}))::INTEGER AS draws FROM rates),
draw AS (
  SELECT d.doc_id, d.source, j,
         (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || j), 1, 12))::BIGINT + 0.5) / pow(2, 48) AS u,
         rate / draws AS mean
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(generate_series(1, draws)) AS g(j)),
terms AS (SELECT source, mean, k, exp(-mean + k * ln(greatest(mean, 1e-300)) - lgamma(k + 1)) AS p
          FROM (SELECT DISTINCT source, mean FROM draw), unnest(generate_series(0, {ENTRIES})) AS g(k)),
cdf AS (SELECT source, mean, k, sum(p) OVER (PARTITION BY source, mean ORDER BY k) AS c FROM terms),
counts AS (
  SELECT doc_id, sum(n)::INTEGER AS n_copies
  FROM (SELECT w.doc_id, w.j, count(*) FILTER (c.c <= w.u) AS n
        FROM draw w JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND w.mean = c.mean GROUP BY w.doc_id, w.j)
  GROUP BY doc_id)
SELECT d.*, round(p.rate, 9) AS rate, n_copies, copy_no::INTEGER AS copy_no,
       ('0x' || substr(md5('{SEED}:order:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || copy_no), 1, 12))::BIGINT AS shuffle_key
FROM documents d JOIN counts USING (doc_id) JOIN parts p ON d.source IS NOT DISTINCT FROM p.source,
     unnest(generate_series(1, n_copies)) AS g(copy_no)
"""
