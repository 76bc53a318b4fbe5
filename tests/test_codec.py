import base64
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import decode_headers, encode_headers
from tidemark.schemas import HEADERS

# golden value of the stored form (spaced JSON as another writer produces it)
GOLDEN_TEXT = '[{"key": "origin", "val": "cmFkaW8="}, {"key": "retries", "val": null}]'
GOLDEN_HEADERS = [("origin", b"radio"), ("retries", None)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, h) for i, h in enumerate(rows)], f"id int, headers {HEADERS.simpleString()}")


def test_encode_golden(spark):
    out = _frame(spark, [GOLDEN_HEADERS]).select(encode_headers("headers").alias("j")).first().j
    assert json.loads(out) == json.loads(GOLDEN_TEXT)


def test_encode_null_and_empty_become_null(spark):
    rows = _frame(spark, [None, []]).orderBy("id").select(encode_headers("headers").alias("j")).collect()
    assert [r.j for r in rows] == [None, None]


def test_decode_golden_spaced_and_null(spark):
    df = spark.createDataFrame([(GOLDEN_TEXT,), (None,)], "t string")
    rows = df.select(decode_headers("t").alias("h")).collect()
    assert [(h.key, None if h.value is None else bytes(h.value)) for h in rows[0].h] == GOLDEN_HEADERS
    assert rows[1].h is None


def test_long_value_has_no_line_breaks_and_round_trips(spark):
    payload = bytes(range(200))
    df = _frame(spark, [[("blob", payload)]]).select(encode_headers("headers").alias("j"))
    text = df.first().j
    assert "\n" not in text and "\r" not in text
    assert base64.b64decode(json.loads(text)[0]["val"]) == payload
    back = df.select(decode_headers("j").alias("h")).first().h
    assert bytes(back[0].value) == payload


def test_repeated_keys_keep_order(spark):
    hs = [("a", b"1"), ("b", b"2"), ("a", b"3")]
    back = (_frame(spark, [hs]).select(encode_headers("headers").alias("j"))
            .select(decode_headers("j").alias("h")).first().h)
    assert [(h.key, bytes(h.value)) for h in back] == hs


@pytest.mark.parametrize("text", ["{bad", '{"key": "a"}', '[{"key": "a", "val": "***"}]', "[1]"])
def test_corrupt_text_fails(spark, text):
    df = spark.createDataFrame([(GOLDEN_TEXT,), (text,)], "t string")
    with pytest.raises(Exception, match="corrupt headers"):
        df.select(decode_headers("t").alias("h")).collect()
