from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidemark.functions import epoch_millis
from tidemark.operators import with_target_offsets
from tidemark.plans import publish_frame
from tidemark.sources import tables as tv


def test_publish_frame_is_clustered_and_ordered(spark):
    log = tv.events_log(spark, SF_SMALL)
    frame = publish_frame(with_target_offsets(log), num_partitions=6)
    assert frame.columns == ["topic", "partition", "key", "value", "headers"]
    kept = publish_frame(with_target_offsets(log), num_partitions=6, keep_offset=True)
    rows = kept.select("topic", "partition", "offset", F.spark_partition_id().alias("pid"),
                       F.monotonically_increasing_id().alias("seq")).collect()
    tasks, last = {}, {}
    for r in sorted(rows, key=lambda r: r.seq):
        key = (r.topic, r.partition)
        tasks.setdefault(key, set()).add(r.pid)
        assert last.get(key, -1) < r.offset  # ascending offsets within each partition
        last[key] = r.offset
    assert all(len(p) == 1 for p in tasks.values())  # one task per (topic, partition)
    assert len(rows) == log.count()


def test_timestamp_travels_as_header(spark):
    log = tv.events_log(spark, SF_SMALL)
    frame = publish_frame(log, keep_offset=True)
    want = {r.offset: r.ms for r in log.select("offset", epoch_millis("timestamp").alias("ms")).collect()}
    got = {r.offset: int(bytes(r.headers[-1].value)) for r in frame.collect()}
    assert got == want


def test_delivery_report_numbers_from_zero(spark):
    from tidemark.plans import delivery_report
    log = tv.events_log(spark, SF_SMALL)
    report = delivery_report(with_target_offsets(log))
    assert report.columns == ["topic", "partition", "offset", "key", "value", "timestamp"]
    per = report.groupBy("topic", "partition").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"),
                                                   F.count("*").alias("n")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in per)
