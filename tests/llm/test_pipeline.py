"""The pipeline's rows against its stages in plain Python (the forest's verdict is taken from the operator)."""
import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
from conftest import SF_SMALL
from test_decontaminate import brute as leaks
from test_near_dedup import brute as groups
from tidemark.llm import mixing, quality, secret_ledger
from tidemark.llm.tables import table


def redacted(text):
    spans = sorted((m.start(), m.end()) for r in secret_ledger.RULES for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)
    out, pos = "", 0
    for a, b in spans:
        if a >= pos:
            out += text[pos:a] + "[secret]"
        pos = max(pos, b)
    return out + text[pos:]


def test_pipeline(spark):
    docs = table(spark, SF_SMALL, "documents")
    verdict = {r.doc_id: r.kept for r in quality.judge_quality(docs, table(spark, SF_SMALL, "labels")).collect()}
    rows = [r for r in docs.collect() if verdict[r.doc_id]]
    component = groups([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if component[r.doc_id][1] == r.doc_id]
    hits = leaks([(r.doc_id, r.text) for r in rows], [tuple(r) for r in table(spark, SF_SMALL, "benchmark").collect()])
    rows = [r for r in rows if not hits[r.doc_id][1]]
    clean = spark.createDataFrame([(r.doc_id, redacted(r.text), r.lang, r.source, r.n_chars if redacted(r.text) == r.text
                                    else len(redacted(r.text))) for r in rows], docs.schema)
    want = Counter((r.doc_id, r.text, r.n_chars, r.n_copies, r.copy_no) for r in mixing.mix(clean).collect())
    got = Counter((r.doc_id, r.text, r.n_chars, r.n_copies, r.copy_no) for r in corpus_pipeline.run(spark, SF_SMALL).collect())
    assert got == want
    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.ORACLE_SQL is None


def test_stages_with_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1, "p", "q"), (1, text, "en", "a", 1, "p", "q"), (None, text + " end", None, None, None, None, None),
            (3, None, "en", "a", 0, "p", "q"), (4, "", "en", "b", 0, "p", "q"), (5, text.replace("w", "v") + " é " * 50, "en", "b", 9, "p", "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, label string")
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF_SMALL)
            assert now.columns == docs.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, now, SF_SMALL)
        assert set(docs.columns) <= set(last.columns)
        assert last.count() >= 0
        if frame is docs:
            assert sorted(str(r.doc_id) for r in now.collect()) == ["1", "5"]
