import json

import pytest

from tidemark.schemas import ENDS
from tidemark.sinks.kafka import write_options
from tidemark.sources.kafka import (KafkaUnavailableError, offsets_json, read_kafka_log, read_options,
                                    stream_options)


def test_ending_offsets_json_is_exclusive_high(spark):
    ends = spark.createDataFrame([("b", 1, 0, 7), ("b", 0, 2, 4), ("a", 10, 0, 1), ("a", 3, 5, 5)], ENDS)
    text = offsets_json(ends, "high")
    # every partition is named, the empty one (a/3) too
    assert text == '{"a":{"3":5,"10":1},"b":{"0":4,"1":7}}'
    assert json.loads(text)["b"]["1"] == 7


def test_option_builders():
    opts = read_options(["h1:9092", "h2:9092"], ["t1", "t2"], ending_offsets='{"t1":{"0":5}}')
    assert opts["kafka.bootstrap.servers"] == "h1:9092,h2:9092"
    assert opts["subscribe"] == "t1,t2" and opts["startingOffsets"] == "earliest"
    assert opts["includeHeaders"] == "true" and opts["endingOffsets"] == '{"t1":{"0":5}}'
    assert "endingOffsets" not in stream_options("h:1", ["t"])
    assert write_options("h:1")["kafka.max.in.flight.requests.per.connection"] == "1"


def test_missing_connector_is_reported(spark):
    with pytest.raises(KafkaUnavailableError):
        read_kafka_log(spark, "localhost:1", ["t"])


def test_stream_batches_are_bounded_by_default():
    assert int(stream_options("h:1", ["t"])["maxOffsetsPerTrigger"]) > 0
    assert stream_options("h:1", ["t"], maxOffsetsPerTrigger="7")["maxOffsetsPerTrigger"] == "7"


def test_timestamps_survive_two_restores(spark):
    """What one restore published, read from Kafka and published again, has one header and the first timestamp."""
    from builders import log_df
    from pyspark.sql import functions as F
    from tidemark.plans import publish_frame
    from tidemark.sources.kafka import as_log
    first = log_df(spark, [("t", 0, 0, "k", "v", 1234567, [("a", b"1")]), ("t", 0, 1, "k", "v", 7654321, None)])
    log = first
    for broker_time in (10**12, 2 * 10**12):
        sent = publish_frame(log, keep_offset=True)
        assert all(sum(h.key == "source-timestamp-ms" for h in r.headers) == 1 for r in sent.collect())
        log = as_log(sent.withColumn("timestamp", F.timestamp_millis(F.lit(broker_time))))
    assert log.exceptAll(first).count() == 0 and first.exceptAll(log).count() == 0
