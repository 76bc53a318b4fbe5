import re

from pyspark.sql import functions as F

from tidemark.llm import secret_ledger as S
from tidemark.session import scratch_path

KEY = "password = 'hunter2hunter2'"
HEX = "0123456789abcdef01234567"


def test_spans_match_python(spark):
    texts = [f"é {KEY}; AKIA{'A1' * 8} and {HEX} Token:{HEX}", "token: abc, secret=token: abcdefgh", "AKIA123 abc", "", None,
             "漢" * 50 + f" API_KEY='x/y+z=' {HEX}0 PASSWD=abcde", f"api-key={HEX}", "-----BEGIN RSA PRIVATE KEY-----"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: [(f.start, f.kind_no, f.end) for f in r.findings] for r in S.scan(docs, scratch_path(spark, "ledger")).collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), no, m.end()) for no, r in enumerate(S.RULES) for m in re.finditer(r.pattern, t or "")
                if len(m[r.group]) >= r.least]
        assert got[i] == sorted(want), i


def test_ledger_scans_only_unseen_blobs(spark):
    path = scratch_path(spark, "ledger")
    one = spark.createDataFrame([(1, KEY), (2, KEY), (3, "clean")], "doc_id int, text string")
    two = spark.createDataFrame([(4, KEY), (5, "new " + KEY), (6, "clean"), (None, None)], "doc_id int, text string")
    S.scan(one, path)
    again = {r.doc_id: len(r.findings) for r in S.scan(two, path).collect()}
    assert again == {4: 1, 5: 1, 6: 0, None: 0}
    entries = S.read_ledger(spark, path, S.RULE_VERSION)
    assert entries.count() == entries.select("blob").distinct().count() == 4
    # another rule version scans everything anew, and the old entries stay
    S.scan(two, path, (S.Rule("n", "new"),), "v2")
    assert S.read_ledger(spark, path, "v2").count() == 4
    assert S.read_ledger(spark, path, S.RULE_VERSION).count() == 4


def test_redaction(spark):
    rows = [(1, f"a {KEY} b", 9, "x"), (2, "clean", 5, None), (3, None, None, "y"), (4, f"{HEX}{KEY}", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars bigint, FINDINGS string")
    out = S.redact(docs, scratch_path(spark, "ledger"))
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars, r.FINDINGS) for r in out.collect()}
    assert got[2] == ("clean", 5, None) and got[3] == (None, None, "y")
    assert got[1][0].startswith("a [secret]") and KEY not in got[1][0] and got[1][1] == len(got[1][0])
    assert "hunter" not in got[4][0] and HEX not in got[4][0]
    assert S.redact(docs.limit(0), scratch_path(spark, "ledger")).count() == 0


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, KEY)], "doc_id int, text string")
    plan = S.redact(docs, scratch_path(spark, "ledger"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
