"""Secret scans (4): an incremental ledger of blobs, in DataFrame functions only.

Every text is content-addressed by its SHA-256.  The ledger is a parquet table of
(rule_version, blob, findings), one row for every blob a rule version has scanned,
clean blobs included.  ``scan`` finds the blobs that the ledger lacks for the given
rule version, scans each of them once, appends them, and joins the findings back to
all rows (paths, versions) that carry the blob.

* Copies cost one scan: equal texts meet by their address after a partial
  aggregation in every task, so a text that a third of all rows carry is one row a task.
* With entries in the ledger, a narrow distinct of addresses picks the unseen ones,
  and only their texts are moved (a checked broadcast of the addresses, else a join).
* Positions come from the lengths of the pieces between matches (``split``) and of
  the matches (``regexp_extract_all``), summed by a window inside each blob.

Rules find leftmost non-overlapping matches of a pattern, then drop those whose
measured group is too short.  Offsets are code points, end exclusive.

Defined results.  Null text is the empty text, without findings.  Null or repeated
ids: each row gets its text's findings.  Empty table: empty result, nothing appended.
Input columns named like an output column give way to it.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import restored, shielded, table
from tidemark.operators.joins import join_checked
from tidemark.session import scratch_path

RULE_VERSION = "2024-1"
FINDING = "array<struct<start:int,kind_no:int,end:int>>"
# a blob address is 32 bytes; a hash table entry of it about 100
MAX_BROADCAST_BLOBS = 100_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` with at most two groups; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _any_case(words: list[str]) -> str:
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


# fixed values: the base rules, in their order; then the added ones.  A maximal run of at least n characters
# is what dropping the short matches of "+" leaves, so those two carry their length in the pattern.
RULES = (
    Rule("assign", "(" + _any_case(["password", "passwd", "secret", "token", "api_?key"])
         + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE_KINDS = 3


def blob_id(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _match_lengths(text, rule: Rule, no: int) -> F.Column:
    """struct(kind_no, gaps, sizes, groups): lengths before, of, and inside each match."""
    whole = F.lit(f"({rule.pattern})")
    lengths = lambda c: F.transform(c, lambda x: F.char_length(x))      # noqa: E731
    none = F.array().cast("array<int>")
    found = text.rlike(rule.pattern)
    sizes = F.when(found, lengths(F.regexp_extract_all(text, whole, F.lit(1)))).otherwise(none)
    gaps = F.when(found, lengths(F.split(text, rule.pattern, -1))).otherwise(none)
    groups = (F.when(found, lengths(F.regexp_extract_all(text, whole, F.lit(rule.group + 1)))).otherwise(none)
              if rule.group else sizes)
    return F.struct(F.lit(no).alias("kind_no"), gaps.alias("gaps"), sizes.alias("sizes"), groups.alias("groups"))


def find_in_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of each (blob, text); findings by start, then kind."""
    text = F.col("text")
    runs = F.array(*[_match_lengths(text, r, no) for no, r in enumerate(rules)])
    runs = F.filter(runs, lambda x: F.size(x["sizes"]) > 0)
    kinds = blobs.select("blob", F.explode_outer(runs).alias("run"))
    one = kinds.select("blob", "run.kind_no", F.posexplode_outer(
        F.arrays_zip(F.slice("run.gaps", F.lit(1), F.size("run.sizes")).alias("gap"),
                     F.col("run.sizes").alias("size"), F.col("run.groups").alias("inner"))).alias("i", "m"))
    upto = Window.partitionBy("blob", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(upto)
    spans = one.select("blob", "kind_no", (end - F.col("m.size")).cast("int").alias("start"), end.cast("int").alias("end"),
                       F.col("m.inner").alias("inner"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind_no") + 1)
    kept = F.when(F.col("kind_no").isNotNull() & (F.col("inner") >= least), F.struct("start", "kind_no", "end"))
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(kept)).cast(FINDING).alias("findings"))


def read_ledger(spark: SparkSession, path: str, rule_version: str) -> DataFrame | None:
    """The ledger's entries for one rule version, or None where the ledger is new."""
    try:
        return (spark.read.schema(f"blob binary, findings {FINDING}, rule_version string").parquet(path)
                .where(F.col("rule_version") == rule_version).select("blob", "findings"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of ``docs.text`` that the ledger lacks, append them, return the ledger.

    One writer at a time; a failed append leaves no entry, so its blobs are scanned again."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    known = read_ledger(spark, path, rule_version)
    if known is not None:
        unseen = texts.select("blob").distinct().join(known.select("blob"), "blob", "left_anti")
        texts = join_checked(texts, unseen, ["blob"], "left_semi", MAX_BROADCAST_BLOBS)
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    (find_in_blobs(blobs, rules).withColumn("rule_version", F.lit(rule_version))
     .write.mode("append").partitionBy("rule_version").option("compression", "zstd").parquet(path))
    return read_ledger(spark, path, rule_version)


def scan(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """``docs`` with ``findings``, through the ledger at ``path`` (a shared folder)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("blob", "findings")])
    ledger = update_ledger(docs, path, rules, rule_version)
    return docs.withColumn("blob", blob_id(F.col("text"))).join(ledger, "blob", "left").drop("blob")


def redacted(text, findings) -> F.Column:
    """The text with every finding (overlaps merged) replaced by ``[secret]``."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(s, f):
        fresh = f["start"] >= s["pos"]
        out = F.when(fresh, F.concat(s["out"], F.substring(text, s["pos"] + 1, f["start"] - s["pos"]), F.lit("[secret]")))
        return F.struct(F.greatest(s["pos"], f["end"]).alias("pos"), out.otherwise(s["out"]).alias("out"))

    done = F.aggregate(findings, start, step,
                       lambda s: F.concat(s["out"], F.substring(text, s["pos"] + 1, F.lit(2147483647))))
    return F.when(F.size(findings) > 0, done).otherwise(text)


def redact(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with secrets redacted; ``n_chars``, if there, follows a changed text."""
    inner, moved = shielded(docs, ["blob", "findings"])
    found = scan(inner, path).withColumn("findings", F.coalesce("findings", F.array().cast(FINDING)))
    clean = found.withColumn("text", redacted(F.col("text"), F.col("findings")))
    if "n_chars" in docs.columns:
        n = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
        clean = clean.withColumn("n_chars", F.when(F.size("findings") > 0, n).otherwise(F.col("n_chars")))
    return restored(clean, docs.columns, moved)


def _listed(findings, rules: tuple[Rule, ...]) -> F.Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(
        ":", F.element_at(names, f["kind_no"] + 1), f["start"].cast("string"), f["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "secret-ledger"))
    count = lambda no: F.size(F.filter("findings", lambda f: f["kind_no"] == no)).cast("long")      # noqa: E731
    base = F.filter("findings", lambda f: f["kind_no"] < BASE_KINDS)
    return found.select("doc_id", *[count(no).alias(f"n_{r.kind}") for no, r in enumerate(RULES[:BASE_KINDS])],
                        F.sha2(_listed(base, RULES), 256).alias("base_sha256"),
                        _listed(F.col("findings"), RULES).alias("spans"))


def _oracle_rule(no: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    inner = f"regexp_extract_all(t, '{p}', {rule.group})"
    return f"""
  SELECT doc_id, {no} AS kind_no, '{rule.kind}' AS kind, ends[i] - length(m[i]) AS start, ends[i] AS stop
  FROM (SELECT *, [list_sum([length(y) for y in gaps[1:x]]) + list_sum([length(y) for y in m[1:x]])
                    for x in generate_series(1, len(m))] AS ends
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, {inner} AS inside, string_split_regex(t, '{p}') AS gaps FROM texts)),
       unnest(generate_series(1, len(m))) AS g(i)
  WHERE length(inside[i]) >= {rule.least}"""


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_oracle_rule(no, r) for no, r in enumerate(RULES))}),
rolled AS (
  SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
         count(*) FILTER (kind_no = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no < {BASE_KINDS}) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS spans
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN rolled USING (doc_id)
"""
