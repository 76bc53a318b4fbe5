"""URL filters (6): rules first, then a naive Bayes verdict over segmented host words.

1. Host and path are cut from the url; the longest fitting rule decides.
2. Unigram model: counts of all words of all page texts.
3. Host word segmentation: each distinct run of letters of a host is cut into words by
   Viterbi.  All its substrings of up to ``LONGEST`` letters are joined with the word counts (the model is
   never sent anywhere whole), and the best path through the found ones is computed for each run by
   itself.  A substring that is no word costs more with each letter.
4. Multinomial naive Bayes with add-one smoothing over the words of the host, the words of the path
   and the shapes of its numbers.  Labels: the verdicts of the rules, over all urls that a rule
   fits, each page counted.  Log odds of tokens are joined to the tokens of the distinct urls, summed, and
   joined back to the pages; equal odds allow.

A url that a third of all pages carry is one row after the distinct count of urls.

Defined results.  Null url or no ``://``: empty host and path, no tokens, judged by the prior
alone.  No labelled url: allow.  Null or repeated ids: each row is judged.  Empty table: empty result.
Input columns named like an output column give way to it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import map_arrow, table, written

# fixed values: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LONGEST = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# probability of an unseen word: one tenth for each letter
UNSEEN = 10.0
OUTPUT = ["host", "path", "rule", "verdict", "words", "log_odds"]


def split_url(url) -> tuple[F.Column, F.Column]:
    """(host, path) of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(raw) + 1, F.lit(2147483647)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host, path) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):       # the longest is put on top last
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): lower-case words of a-z in the texts of all pages."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    return words.where(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count("*").alias("n"))


def segment(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) for each distinct ``run`` of letters: its most probable cut into words."""
    total = counts.agg(F.sum("n").alias("t")).first()["t"] or 1        # one number
    size = F.char_length("run")
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    parts = starts.select("run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - F.col("start") + 1))).alias("length"))
    parts = parts.withColumn("word", F.substring("run", F.col("start"), F.col("length")))
    known = (parts.join(counts, "word").groupBy("run")
             .agg(F.collect_list(F.struct((F.col("start") - 1).alias("start"), "length", "n")).alias("found")))     # at most LONGEST a letter

    def run(batches):
        for batch in batches:
            runs, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([best_cut(r, f or (), total) for r, f in zip(runs, found)], pa.list_(pa.string()))],
                names=["run", "words"])

    return map_arrow(runs.join(known, "run", "left").select("run", "found"), run, "run string, words array<string>")


def best_cut(run: str, found, total: int) -> list[str]:
    """Viterbi: the cut of ``run`` with the largest sum of log probabilities (the first of equals)."""
    n = len(run)
    by_end: dict[int, list[tuple[int, float]]] = {}
    for f in found:
        by_end.setdefault(f["start"] + f["length"], []).append((f["start"], np.log(f["n"] / total)))
    best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        options = {start: np.log(1.0 / total) - (end - start) * np.log(UNSEEN) for start in range(max(0, end - LONGEST), end)}
        options.update(by_end.get(end, ()))
        for start in sorted(options):
            score = best[start] + options[start]
            if score > best[end] + 1e-12:
                best[end], back[end] = score, start
    words, end = [], n
    while end:
        words.append(run[back[end]:end])
        end = back[end]
    return words[::-1]


def _tokens(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, path, words, tokens) of distinct (host, path)."""
    runs_of = lambda c: F.filter(F.split(c, "[^a-z]+"), lambda x: x != "")      # noqa: E731
    hosts = urls.select("host").distinct()
    runs = hosts.select("host", F.posexplode(runs_of(F.col("host"))).alias("i", "run"))
    cut = segment(runs.select("run").distinct(), counts)
    by_host = (runs.join(cut, "run").groupBy("host")
               .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x["words"])).alias("words")))
    path = F.filter(F.split(F.regexp_replace(F.lower("path"), "[0-9]", "0"), r"[^\p{L}0-9]+"), lambda x: x != "")
    both = urls.join(by_host, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    tokens = F.concat(F.transform("words", lambda w: F.concat(F.lit("h:"), w)), F.transform(path, lambda w: F.concat(F.lit("p:"), w)))
    return both.withColumn("tokens", tokens)


def judge(pages: DataFrame) -> DataFrame:
    """``pages`` (url and html; html only feeds the word counts) without html, with host, path, rule, verdict,
    words (of the host) and log_odds (of allow; also where a rule decides)."""
    kept = [c for c in pages.columns if c.lower() not in OUTPUT and c != "html"]
    host, path = split_url(F.col("url"))
    cut = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"))
    urls = cut.groupBy("host", "path").agg(F.count("*").alias("pages")).withColumns({"rule": rule, "given": verdict})
    urls = written(_tokens(written(urls, "url-distinct"), written(word_counts(pages), "url-words")), "url-tokens")

    weigh = lambda v: F.sum(F.when(F.col("given") == v, F.col("pages")).otherwise(0))       # noqa: E731
    each = urls.where("given is not null").select("given", "pages", F.explode("tokens").alias("token"))
    model = written(each.groupBy("token").agg(weigh("allow").alias("good"), weigh("block").alias("bad")), "url-model")
    prior = urls.agg(weigh("allow").alias("good"), weigh("block").alias("bad")).first()
    sums = model.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("*").alias("v")).first()
    good, bad, v = sums["good"] or 0, sums["bad"] or 0, sums["v"]       # a few numbers
    base = float(np.log(((prior["good"] or 0) + 1) / ((prior["bad"] or 0) + 1)))
    odds = model.select("token", (F.log((F.col("good") + 1) / (good + v + 1)) - F.log((F.col("bad") + 1) / (bad + v + 1))).alias("odds"))
    none = float(np.log((bad + v + 1) / (good + v + 1)))              # of a token that no labelled url has
    scored = (urls.select("host", "path", F.explode("tokens").alias("token")).join(odds, "token", "left")
              .groupBy("host", "path").agg(F.sum(F.coalesce("odds", F.lit(none))).alias("sum")))
    judged = urls.select("host", "path", "rule", "given", "words").join(scored, ["host", "path"], "left")
    judged = judged.withColumn("log_odds", F.coalesce("sum", F.lit(0.0)) + base)
    judged = judged.withColumn("verdict", F.coalesce("given", F.when(F.col("log_odds") >= -1e-9, "allow").otherwise("block")))
    return cut.join(judged.select("host", "path", "rule", "verdict", "words", "log_odds"), ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in kept], *OUTPUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "words", "log_odds")
