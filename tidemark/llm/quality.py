"""Quality rules (8): statistics of every whole text, two base rules, and a
gradient-boosted forest with monotonic constraints.

1. ``document_statistics`` reads each text once and computes counts and ratios
   with NumPy over Arrow batches; the narrow result is written once.
2. ``fit_quality`` trains on a bounded sample: about ``max_train_rows`` labelled
   documents, chosen by a hash of their id.
3. ``score_quality`` scores every row with the flat node arrays.

Defined results.  Null or empty text: zero words, so the base rules reject it.
Null ``doc_id``: scored like any row, never a training row.  Repeated rows: each
row is judged alone.  Labels that are null, missing or of one class only: the
forest is a constant, and only the base rules reject.  Empty table: empty result.
Input columns named like an output column give way to the output column.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import gbt
from tidemark.llm.tables import map_arrow, restored, shielded, table, written
from tidemark.llm.text import LOWER, Words, blocks, mix64, segment_hash, text_column

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_TRAIN_ROWS = 20_000
KEEP_PROBABILITY = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# feature -> monotone direction of P(good): more repetition or symbols never raises the score
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1,
            "upper_ratio": -1, "digit_ratio": 0, "punct_ratio": 0, "wide_ratio": 0, "distinct_ratio": 0,
            "words_per_line": 0, "longest_word": 0, "stop_ratio": 0, "mark_ratio": 0}
MONOTONE = list(FEATURES.values())

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
PUNCT = np.zeros(256, dtype=bool)
PUNCT[[ord(c) for c in ".,;:"]] = True
MARKS = np.zeros(256, dtype=bool)
MARKS[[ord(c) for c in "!?{}[]()=_~^@/\\"]] = True
# fixed values: frequent short words of the four languages
STOP_WORDS = "the of and to in a is that for it de la le les et un en que y el los las der die und das ist zu".split()


def _per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each document's range."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _first_seen(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the first of its (doc, key), occurrences of its (doc, key)) for each item."""
    both = mix64(key + mix64(doc.astype(np.uint64)))
    _, first, inverse, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    mask = np.zeros(len(both), bool)
    mask[first] = True
    return mask, count[inverse]


_STOP = None


def _stop_hashes() -> np.ndarray:
    global _STOP
    if _STOP is None:
        data = np.frombuffer(" ".join(STOP_WORDS).encode(), np.uint8)
        _STOP = np.unique(Words(data, np.array([0, len(data)])).hashes())
    return _STOP


def block_statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and features of the documents of one block."""
    words = Words(data, off)
    d = len(off) - 1
    n = words.count
    lead = (data & 0xC0) != 0x80
    in_word = np.zeros(len(data) + 1, np.int64)
    in_word[words.starts] += 1
    in_word[words.ends] -= 1
    in_word = np.cumsum(in_word[:-1]) > 0
    word_chars = _per_doc(lead & in_word, off)
    symbols = _per_doc(SYMBOLS[data], off)

    # lines: pieces between \n inside each document
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([off[:-1], breaks + 1]))
    line_doc = np.searchsorted(off[1:-1], line_start, side="right") if d > 1 else np.zeros(len(line_start), np.int64)
    # an empty document shares its offset with the next one; its only line is empty and holds no word
    line_end = np.append(line_start[1:], len(data))
    stop = np.append(breaks, len(data))
    line_end = np.minimum(line_end, stop[np.searchsorted(stop, line_start)])
    has_word = np.searchsorted(words.starts, line_end) > np.searchsorted(words.starts, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    n_lines = np.bincount(line_doc, minlength=d)
    first, _ = _first_seen(line_doc, segment_hash(data, line_start, line_end))
    dup_lines = np.bincount(line_doc[~first], minlength=d)

    h = words.hashes()
    repeated = np.zeros(len(h), bool)
    if len(h) >= 3:
        at = np.flatnonzero(words.doc[:-2] == words.doc[2:])
        tri = mix64(h[at] * np.uint64(3) + mix64(h[at + 1]) * np.uint64(5) + mix64(mix64(h[at + 2])) * np.uint64(7))
        _, count = _first_seen(words.doc[at], tri)
        twice = at[count > 1]
        for k in range(3):
            repeated[twice + k] = True
    repeat_words = _per_doc(repeated, words.first)

    low = Words(LOWER[data], off).hashes()
    seen, _ = _first_seen(words.doc, low)
    one = np.maximum(n, 1)
    chars = np.maximum(_per_doc(lead, off), 1)
    bytes_ = np.maximum(np.diff(off), 1)
    longest = np.zeros(d)
    np.maximum.at(longest, words.doc, words.ends - words.starts)
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "log_words": np.log1p(n), "mean_word": word_chars / one, "symbol_ratio": symbols / chars,
        "dup_line_ratio": dup_lines / np.maximum(n_lines, 1), "repeat_ratio": repeat_words / one,
        "upper_ratio": _per_doc(UPPER[data], off) / chars, "digit_ratio": _per_doc(DIGIT[data], off) / chars,
        "punct_ratio": _per_doc(PUNCT[data], off) / chars, "wide_ratio": _per_doc(data >= 0x80, off) / bytes_,
        "distinct_ratio": _per_doc(seen, words.first) / one, "words_per_line": n / np.maximum(n_lines, 1),
        "longest_word": np.minimum(longest, 1000), "stop_ratio": _per_doc(np.isin(low, _stop_hashes()), words.first) / one,
        "mark_ratio": _per_doc(MARKS[data], off) / chars,
    }


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts (long) and the forest's features (double) of every row."""
    names = COUNTS + list(FEATURES)

    def run(batches):
        for batch in batches:
            col = text_column(batch)
            ids = batch.column(0)
            for lo, data, off in blocks(col):
                stats = block_statistics(data, off)
                out = [pa.array(stats[c].astype(np.int64 if c in COUNTS else np.float64)) for c in names]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(off) - 1), *out], names=["doc_id", *names])

    kind = dict(docs.dtypes)["doc_id"]
    schema = ", ".join([f"doc_id {kind}", *[f"{c} bigint" for c in COUNTS], *[f"{c} double" for c in FEATURES]])
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def with_base_rules(stats: DataFrame, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> DataFrame:
    return stats.withColumn("base_failed", (F.col("n_words") < min_words)
                            | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))


def training_labels(labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality) of about ``max_train_rows`` labelled documents: all, or those whose hashed id is in the
    share that gives so many (the rows are chosen in the tasks, so no more than the sample reaches the driver)."""
    one = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    labelled = one.count()
    if labelled > max_train_rows:
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * max_train_rows / labelled)))
    return one


def fit_quality(stats: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> gbt.Forest:
    """Train on the rows of ``stats`` whose labels ``training_labels`` chooses."""
    one = training_labels(labels, max_train_rows)
    sample = stats.join(one, "doc_id").select("doc_id", "quality", *COUNTS, *FEATURES).toPandas()
    sample = sample.sort_values(["doc_id", *COUNTS])        # the forest does not depend on the order of arrival
    return gbt.fit(sample[list(FEATURES)].to_numpy(float), (sample["quality"] > 0).to_numpy(float), MONOTONE)


def score_quality(stats: DataFrame, forest: gbt.Forest, keep: float = KEEP_PROBABILITY) -> DataFrame:
    """``stats`` with ``p_good`` and ``kept`` (base rules passed and p_good >= keep)."""
    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                                 for c in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            p = forest.score(x)
            good = p >= keep if forest.decides else np.ones(len(p), bool)
            failed = batch.column(batch.schema.get_field_index("base_failed")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(good & ~failed.astype(bool))],
                                             names=[*batch.schema.names, "p_good", "kept"])

    schema = stats.schema.simpleString()[7:-1].replace(":", " ")
    return map_arrow(stats, run, f"{schema}, p_good double, kept boolean")


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, features, base_failed, p_good, kept."""
    stats = with_base_rules(written(document_statistics(docs), "quality-stats"))
    return score_quality(stats, fit_quality(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged.  Statistics and text stay in one
    row, so nothing is joined back on an id that may be null or repeated."""
    columns = docs.columns
    inner, moved = shielded(docs, ["kept", "p_good", "base_failed", *COUNTS, *FEATURES])
    chosen = F.broadcast(training_labels(labels).select("doc_id"))
    # the sample's size is bounded, so its ids can be sent; only its texts are looked at twice
    model = fit_quality(document_statistics(inner.join(chosen, "doc_id", "left_semi")), labels)
    names = inner.columns

    def run(batches):
        for batch in batches:
            keep = []
            for _, data, off in blocks(text_column(batch)):
                s = block_statistics(data, off)
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
                x = np.column_stack([s[c].astype(float) for c in FEATURES])
                keep.append(~failed & (model.score(x) >= KEEP_PROBABILITY if model.decides else True))
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return restored(map_arrow(inner.select(*names), run, inner.schema), columns, moved)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "p_good")
