"""

Every query reads the driver's tables through the log views of
``tidemark.sources.tables`` and runs over whole tables.  Binary columns
are shown as text and timestamps as epoch milliseconds so that the Spark
result and the DuckDB oracle compare value by value.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import operators as ops
from tidemark.functions import decode_headers, encode_headers, epoch_millis, ntz_to_instant
from tidemark.functions.groups import IGNORE_GROUP_PATTERN
from tidemark.operators.offset_sets import missing_ranges
from tidemark.plans import backup, publish, restore_plan, snapshot_missing, snapshot_report, target, target_mismatches
from tidemark.session import materialize, scratch_path
from tidemark.sinks.snapshot import messages_path, remove_replaced
from tidemark.sources import snapshot as snap
from tidemark.streaming import incremental_backup, repeats_of, run_audit, seen_sets
from tidemark.sources import tables as tv

try:        # the training-data operators are an optional subpackage
    import corpus_pipeline
    from tidemark.llm import registry as llm
except ImportError as why:
    logging.getLogger(__name__).warning("the training-data queries are left out: %s", why)
    corpus_pipeline = llm = None

SMOKE_DIR = "/root/testdata/sf0.001"

# fixed parameters of the registered queries (the oracle SQL repeats them)
CUT_TIME = "2024-01-16 00:00:00"
FILTER_TOPICS = ["click", "purchase"]
REQUESTED_TOPICS = ["click", "purchase", "refund", "signup", "audit"]
CONSUMED_TURNS = 4
UNREACHED_TOPIC = "system"
SNAPSHOT_TOPICS = ["click", "view"]
BACKUP_TOPICS = ["click", "view", "audit"]
STOP_AFTER_SECONDS = 2.0
WAVES = 4           # of the largest partition
PART_FILES = 4      # files of each third of the events


# ---------------------------------------------------------------- helpers

def _show(log: DataFrame, *extra: str) -> DataFrame:
    """A log as comparable columns: text key/value, epoch-ms timestamp."""
    return log.select("topic", "partition", "offset",
                      F.col("key").cast("string").alias("key"),
                      F.col("value").cast("string").alias("value"),
                      epoch_millis("timestamp").alias("timestamp_ms"), *extra)


def _shown_headers() -> tuple[F.Column, F.Column]:
    """Headers as text, and their number (which tells an empty list from none)."""
    return encode_headers("headers").alias("headers_json"), _header_count().alias("header_count")


def _header_count() -> F.Column:
    return F.when(F.col("headers").isNull(), F.lit(None).cast("int")).otherwise(F.size("headers"))


def _events(spark, d):
    return tv.events_log(spark, d)


def _captured(spark, d, log):
    ends, _ = materialize(ops.end_offsets(log))      # small, and used four times
    return ops.capture_commits(tv.nation_commits(spark, d, ends), ends)


def _consumed_report(spark, d):
    log = tv.conversations_log(spark, d)
    consumed = log.where((F.col("offset") < CONSUMED_TURNS) & (F.col("topic") != UNREACHED_TOPIC))
    return ops.consumption_report(ops.end_offsets(log), consumed)


def _unique_lineitem(spark, d):
    return ops.latest_per_offset(tv.lineitem_log(spark, d))


# ---------------------------------------------------------------- queries

def q_log_rows(spark, d):
    return _show(_events(spark, d), *_shown_headers())


def q_topic_catalog(spark, d):
    return ops.topics(_events(spark, d))


def q_partition_catalog(spark, d):
    return ops.partitions(_events(spark, d))


def q_end_offsets(spark, d):
    ends = ops.end_offsets(_events(spark, d))
    return ends.select("*", ops.last_offset("high").alias("last_offset"))


def q_topic_filter(spark, d):
    return ops.select_topics(_events(spark, d), FILTER_TOPICS).select("topic", "partition", "offset")


def q_requested_present(spark, d):
    req = ops.requested_frame(spark, REQUESTED_TOPICS)
    return ops.requested_present(req, ops.topics(_events(spark, d)))


def q_requested_missing(spark, d):
    req = ops.requested_frame(spark, REQUESTED_TOPICS)
    return ops.requested_missing(req, ops.topics(_events(spark, d)))


def q_point_in_time_cut(spark, d):
    log = _events(spark, d)
    early = log.where(F.col("timestamp") < ntz_to_instant(F.lit(CUT_TIME).cast("timestamp_ntz")))
    return _show(ops.cut(log, ops.end_offsets(early)))


def q_consumption_report(spark, d):
    return _consumed_report(spark, d)


def q_consumption_complete(spark, d):
    return ops.consumption_complete(_consumed_report(spark, d))


def q_headers_encode(spark, d):
    return _events(spark, d).select("topic", "partition", "offset", encode_headers("headers").alias("headers_json"))


def q_headers_decode(spark, d):
    enc = _events(spark, d).select("topic", "partition", "offset", encode_headers("headers").alias("headers_json"))
    dec = enc.select("topic", "partition", "offset", decode_headers("headers_json").alias("h"))
    return dec.select("topic", "partition", "offset", F.posexplode("h").alias("header_pos", "hd")).select(
        "topic", "partition", "offset", "header_pos",
        F.col("hd.key").alias("header_key"), F.col("hd.value").cast("string").alias("header_value"))


def q_partition_counts(spark, d):
    return ops.partition_counts(_events(spark, d))


def q_group_commit_counts(spark, d):
    return ops.commit_counts(_captured(spark, d, _events(spark, d)))


def q_totals(spark, d):
    log = _events(spark, d)
    return ops.totals(log, _captured(spark, d, log))


def q_group_catalog(spark, d):
    log = _events(spark, d)
    return ops.consumer_groups(tv.nation_commits(spark, d, ops.end_offsets(log)))


def q_commit_triples(spark, d):
    log = _events(spark, d)
    return publish.commit_triples(ops.translate_offsets(log, _captured(spark, d, log)))


def q_commit_capture(spark, d):
    return _captured(spark, d, _events(spark, d))


def q_translate_offsets(spark, d):
    log = _events(spark, d)
    return ops.translate_offsets(log, _captured(spark, d, log))


def q_translate_offsets_conversations(spark, d):
    log = tv.conversations_log(spark, d)
    return ops.translate_offsets(log, _captured(spark, d, log))


def q_translate_offsets_lineitem(spark, d):
    log = _unique_lineitem(spark, d)
    return ops.translate_offsets(log, _captured(spark, d, log))


def q_restore_rows(spark, d):
    return _show(ops.with_target_offsets(_events(spark, d)), "target_offset")


def q_restore_rows_lineitem(spark, d):
    return ops.with_target_offsets(_unique_lineitem(spark, d)).select("topic", "partition", "offset", "target_offset")


def q_restore_rows_hot(spark, d):
    return ops.with_target_offsets(tv.hot_log(spark, d)).select("topic", "partition", "offset", "target_offset")


def q_translate_offsets_hot(spark, d):
    log = tv.hot_log(spark, d)
    return ops.translate_offsets(log, _captured(spark, d, log))


def q_publish_rows(spark, d):
    frame = publish.publish_frame(_events(spark, d))
    return frame.select("topic", "partition", F.col("key").cast("string").alias("key"),
                        F.col("value").cast("string").alias("value"),
                        encode_headers("headers").alias("headers_json"))


def q_group_offsets(spark, d):
    log = _events(spark, d)
    plan = ops.translate_offsets(log, _captured(spark, d, log))
    grouped = ops.group_commits(plan, "new_offset")
    return grouped.select("consumer_group", F.size("offsets").cast("long").alias("partitions"),
                          F.aggregate("offsets", F.lit(0).cast("long"), lambda a, e: a + e["offset"]).alias("offset_sum"))


def q_starting_offsets_json(spark, d):
    log = _events(spark, d)
    return publish.starting_offsets(ops.translate_offsets(log, _captured(spark, d, log)))


def q_null_key_violations(spark, d):
    return ops.null_keys(tv.conversations_log(spark, d))


def q_null_topic_commits(spark, d):
    log = _events(spark, d)
    return ops.null_topic_commits(ops.union_commits(tv.nation_commits(spark, d, ops.end_offsets(log)), tv.order_commits(spark, d)))


def q_duplicate_offsets(spark, d):
    return ops.duplicate_offsets(tv.lineitem_log(spark, d))


def q_latest_per_offset(spark, d):
    return _show(_unique_lineitem(spark, d))


def _snapshot(spark, d, topics=None):
    """Back up the events log with its raw commits into a fresh shared folder."""
    log = _events(spark, d)
    raw = tv.nation_commits(spark, d, ops.end_offsets(log))
    path = scratch_path(spark, "snapshot")
    backup(log, raw, path, topics=topics, ignore_missing_topics=True)
    return path


def q_snapshot_roundtrip(spark, d):
    return _show(snap.read_messages(spark, _snapshot(spark, d)), *_shown_headers())


def q_snapshot_topic_read(spark, d):
    path = _snapshot(spark, d)
    return _show(snap.read_messages(spark, path, SNAPSHOT_TOPICS), *_shown_headers())


def q_backup_selected_topics(spark, d):
    path = _snapshot(spark, d, BACKUP_TOPICS)
    return _show(snap.read_messages(spark, path), *_shown_headers())


def q_snapshot_partition_read(spark, d):
    part = snap.read_partition(spark, _snapshot(spark, d), SNAPSHOT_TOPICS[0], 1)
    return _show(part, *_shown_headers())


def q_commits_roundtrip(spark, d):
    return snap.read_commits(spark, _snapshot(spark, d))


def q_commit_plan(spark, d):
    _, plan = restore_plan(spark, _snapshot(spark, d))
    return plan


def q_restore_plan_rows(spark, d):
    rows, _ = restore_plan(spark, _snapshot(spark, d))
    return _show(rows, "target_offset")


def q_snapshot_lag_report(spark, d):
    """A snapshot cut at the ends seen before CUT_TIME, reported against the log's ends now."""
    log = _events(spark, d)
    early = log.where(F.col("timestamp") < ntz_to_instant(F.lit(CUT_TIME).cast("timestamp_ntz")))
    path = scratch_path(spark, "lagged")
    backup(log, tv.nation_commits(spark, d, ops.end_offsets(log)), path, ends=ops.end_offsets(early))
    return snapshot_report(spark, path, ops.end_offsets(log))


def q_backup_increments(spark, d):
    """A batch backup at the ends seen before CUT_TIME, then an appended increment up to now."""
    log = _events(spark, d)
    early = log.where(F.col("timestamp") < ntz_to_instant(F.lit(CUT_TIME).cast("timestamp_ntz")))
    raw = tv.nation_commits(spark, d, ops.end_offsets(log))
    path = scratch_path(spark, "appended")
    backup(log, raw, path, ends=ops.end_offsets(early))
    backup(log, raw, path, mode="append")
    return _show(snap.read_messages(spark, path), *_shown_headers())


def q_incremental_backup(spark, d):
    """Two streaming increments over the events folder; the second finds nothing new."""
    path = scratch_path(spark, "increments")
    for _ in range(2):
        incremental_backup(tv.events_as_log(tv.events_stream(spark, d)), path)
    return _show(snap.read_messages(spark, path), *_shown_headers())


def q_mixed_backup(spark, d):
    """A batch backup of early messages, then a streaming one of all into the same snapshot."""
    path, log = _mixed(spark, d)
    return _show(snap.read_messages(spark, path), *_shown_headers())


def q_mixed_backup_commits(spark, d):
    return snap.read_commits(spark, _mixed(spark, d)[0])


def _mixed(spark, d):
    log = _events(spark, d)
    early = log.where(F.col("timestamp") < ntz_to_instant(F.lit(CUT_TIME).cast("timestamp_ntz")))
    raw = tv.nation_commits(spark, d, ops.end_offsets(log))
    path = scratch_path(spark, "mixed")
    backup(log, raw.where(F.col("committed") > 0), path, ends=ops.end_offsets(early))
    incremental_backup(tv.events_as_log(tv.events_stream(spark, d)), path, commits=raw)
    return path, log


def q_stream_increments(spark, d):
    """Streaming increments over a folder that grows: the second run holds new rows, the third none."""
    events = tv.table(spark, d, "events")
    folder, path = scratch_path(spark, "arriving"), scratch_path(spark, "grown")
    for late in (False, True, None):
        if late is not None:
            events.where((F.col("event_id") % 2 == 1) == F.lit(late)).orderBy("event_id").write.mode("append").parquet(folder)
        incremental_backup(tv.events_as_log(tv.file_stream(spark, events.schema, folder)), path)
    return _show(snap.read_messages(spark, path), *_shown_headers())


def q_stopped_backup(spark, d):
    """A streaming backup stopped by its time limit, then finished by the next run."""
    events = tv.table(spark, d, "events")
    folder, path = scratch_path(spark, "many-files"), scratch_path(spark, "stopped")
    events.repartitionByRange(6, "event_id").write.parquet(folder)
    stream = lambda: tv.events_as_log(tv.file_stream(spark, events.schema, folder, max_files_per_trigger=2))      # noqa: E731
    incremental_backup(stream(), path, timeout=STOP_AFTER_SECONDS)
    incremental_backup(stream(), path)
    return _show(snap.read_messages(spark, path), *_shown_headers())


def q_stopped_appended_backup(spark, d):
    """A stream that holds the first and last third only, a batch append, then the stream over all files."""
    events = tv.table(spark, d, "events")
    folder, path, log = scratch_path(spark, "thirds"), scratch_path(spark, "stopped-appended"), _events(spark, d)
    top = events.agg(F.max("event_id").alias("n")).first()["n"] or 0
    middle = F.col("event_id").between(F.lit(top // 3), F.lit(2 * top // 3))
    for some in (~middle, middle):
        events.where(some).write.mode("append").parquet(folder)
        incremental_backup(tv.events_as_log(tv.file_stream(spark, events.schema, folder)), path)
        backup(log, tv.nation_commits(spark, d, ops.end_offsets(log)), path, mode="append")
    return _show(snap.read_messages(spark, path), *_shown_headers())


def q_binary_roundtrip(spark, d):
    log = tv.hashed_log(spark, d)
    path = scratch_path(spark, "binary")
    backup(log, tv.nation_commits(spark, d, ops.end_offsets(log)), path)
    back = snap.read_messages(spark, path)
    return back.select("topic", "partition", "offset", F.lower(F.hex("key")).alias("key"), F.lower(F.hex("value")).alias("value"))


def _places(rows: DataFrame, place: F.Column) -> DataFrame:
    """topic, partition, offset and the rank of ``place`` in the partition (by the bucketed ranking)."""
    moved = rows.select("topic", "partition", place.alias("offset"), F.lit(None).cast("binary").alias("key"),
                        F.col("offset").alias("value"))
    return ops.with_target_offsets(moved).select("topic", "partition", F.col("value").alias("offset"),
                                                 F.col("target_offset").alias("place"))


def q_ordered_partition_read(spark, d):
    """Every row's place in the order that the partition read promises."""
    part = snap.read_partition(spark, _snapshot(spark, d), SNAPSHOT_TOPICS[0], 1)
    return _places(part, F.monotonically_increasing_id())


def q_publish_order(spark, d):
    """Places of the messages inside their partition, wave after wave."""
    path = _snapshot(spark, d)
    largest = snap.read_counts(spark, path).agg(F.max("messages").alias("n")).first()["n"]       # from the snapshot's state
    waves = publish.publish_waves(snap.read_messages(spark, path), wave_messages=-(-largest // WAVES), keep_offset=True)
    sent = [f.withColumn("sent", F.monotonically_increasing_id() + F.lit(w << 50)) for w, f in enumerate(waves)]
    return _places(reduce(DataFrame.unionByName, sent), F.col("sent"))


def q_delivery_report(spark, d):
    rows, _ = restore_plan(spark, _snapshot(spark, d))
    return _show(publish.delivery_report(rows))


def q_target_mismatches(spark, d):
    """A target that got one message of each partition 1 twice, and nothing of partitions 2."""
    log = _events(spark, d)
    ends = ops.partition_counts(log).where("partition <> 2").select(
        "topic", "partition", F.lit(0).alias("low"), (F.col("messages") + F.when(F.col("partition") == 1, 1).otherwise(0)).alias("high"))
    return target_mismatches(log, ends)


def q_usable_ends(spark, d):
    return ops.usable_ends(tv.odd_ends(ops.end_offsets(_events(spark, d))))


def q_cut_at_odd_ends(spark, d):
    log = _events(spark, d)
    return _show(ops.cut(log, tv.odd_ends(ops.end_offsets(log))))


def q_all_commits(spark, d):
    log = _events(spark, d)
    return ops.union_commits(tv.nation_commits(spark, d, ops.end_offsets(log)), tv.order_commits(spark, d))


def q_topic_commits(spark, d):
    """Captured commits of two topics: those on absent partitions and without a topic go."""
    return ops.capture_commits(q_all_commits(spark, d), ops.end_offsets(_events(spark, d)), FILTER_TOPICS)


def q_snapshot_topic_commits(spark, d):
    return snap.read_commits(spark, _snapshot(spark, d), SNAPSHOT_TOPICS)


def q_translate_all_commits(spark, d):
    """Commits on partitions that the log lacks give no row."""
    return ops.translate_offsets(_events(spark, d), q_all_commits(spark, d).where(F.col("topic").isNotNull()))


def q_snapshot_topic_report(spark, d):
    """The report of chosen topics, of a snapshot that holds them whole: all done."""
    log = _events(spark, d)
    return snapshot_report(spark, _snapshot(spark, d), ops.end_offsets(log), SNAPSHOT_TOPICS)


def q_backup_report(spark, d):
    """The report that a backup at early ends gives about itself."""
    log = _events(spark, d)
    early = log.where(F.col("timestamp") < ntz_to_instant(F.lit(CUT_TIME).cast("timestamp_ntz")))
    return backup(log, tv.nation_commits(spark, d, ops.end_offsets(log)), scratch_path(spark, "reported"),
                  ends=ops.end_offsets(early)).report()


def _thirds(spark, d, name):
    """The events as files that arrive in the order first third, last third, middle third; a stream of two thirds a micro-batch."""
    events, folder = tv.table(spark, d, "events"), scratch_path(spark, name)
    top = events.agg(F.max("event_id").alias("n")).first()["n"] or 0
    third = F.expr(f"event_id * 3 div {top + 1}")
    for part in (0, 2, 1):
        events.where(third == part).repartition(PART_FILES).write.mode("append").parquet(folder)
    return lambda: tv.events_as_log(tv.file_stream(spark, events.schema, folder, max_files_per_trigger=2 * PART_FILES))


def _stopped(spark, d):
    """A snapshot of a stream that was stopped after its first micro-batch: the middle third is missing."""
    stream, path = _thirds(spark, d, "thirds-arriving"), scratch_path(spark, "stopped-early")
    incremental_backup(stream(), path, max_batches=1)
    return path, stream


def q_stopped_report(spark, d):
    """A stopped stream's report: offsets missing before the last one held count as remaining."""
    return snapshot_report(spark, _stopped(spark, d)[0], ops.end_offsets(_events(spark, d)))


def q_stopped_missing(spark, d):
    return snapshot_missing(spark, _stopped(spark, d)[0], ops.end_offsets(_events(spark, d)))


def q_resumed_report(spark, d):
    """The report after the next run came to its end: the log's own gaps are no holes."""
    path, stream = _stopped(spark, d)
    incremental_backup(stream(), path)
    return snapshot_report(spark, path, ops.end_offsets(_events(spark, d)))


def q_backup_progress(spark, d):
    """Progress of two runs, the first one stopped after a micro-batch."""
    path, stream = _stopped(spark, d)
    incremental_backup(stream(), path)
    rows = snap.read_progress(spark, path)
    first = rows.groupBy("run").agg(F.min("at").alias("began"))
    number = first.select("run", F.row_number().over(Window.orderBy("began")).alias("run_no"))      # one row a run
    return rows.join(number, "run").select("run_no", "batch", "seen", "written", "outcome")


def q_bounded_stream(spark, d):
    """A stream up to the ends seen before CUT_TIME, then one without a bound: what each left in the snapshot."""
    log, path = _events(spark, d), scratch_path(spark, "bounded")
    early = log.where(F.col("timestamp") < ntz_to_instant(F.lit(CUT_TIME).cast("timestamp_ntz")))
    stream = lambda: tv.events_as_log(tv.events_stream(spark, d))      # noqa: E731
    incremental_backup(stream(), path, ends=ops.end_offsets(early))
    first, _ = materialize(snap.read_messages(spark, path).select("topic", "partition", "offset", F.lit(1).alias("run_no")))
    incremental_backup(stream(), path)
    return first.unionByName(snap.read_messages(spark, path).select("topic", "partition", "offset", F.lit(2).alias("run_no")))


def q_merged_backup(spark, d):
    """Many small increments, merged into one whose old folders are removed."""
    events, folder, path = tv.table(spark, d, "events"), scratch_path(spark, "small-files"), scratch_path(spark, "merged")
    events.repartition(6, "event_id").write.parquet(folder)
    incremental_backup(tv.events_as_log(tv.file_stream(spark, events.schema, folder, max_files_per_trigger=1)), path, merge_above=3)
    remove_replaced(spark, path)
    return _show(snap.read_messages(spark, path), *_shown_headers())


def q_snapshot_counts(spark, d):
    """Messages and offsets of a snapshot of two increments, from its state."""
    log = _events(spark, d)
    early = log.where(F.col("timestamp") < ntz_to_instant(F.lit(CUT_TIME).cast("timestamp_ntz")))
    raw, path = tv.nation_commits(spark, d, ops.end_offsets(log)), scratch_path(spark, "counted")
    backup(log, raw, path, ends=ops.end_offsets(early))
    backup(log, raw, path, mode="append")
    return snap.read_counts(spark, path)


def q_damaged_partitions(spark, d):
    """A snapshot into whose folders somebody put files: messages twice in one partition, of another one in the next."""
    path, log = _snapshot(spark, d), _events(spark, d)
    increment = snap.read_state(spark, path).where("own").first()["increment"]
    stray = log.where("topic = 'click' AND partition = 1").drop("topic", "partition")
    for place in ("topic=click/partition=1", "topic=view/partition=2"):
        stray.write.mode("append").parquet(f"{messages_path(path)}/increment={increment}/{place}")
    return snap.damaged_partitions(spark, path)


def _read_back(spark, d):
    """A target that held messages before, and got the first half of the odd partitions twice (a retried task)."""
    log = _events(spark, d)
    sent = ops.with_target_offsets(publish.publish_frame(log, keep_offset=True, offset_header=publish.OFFSET_HEADER))
    sent = sent.join(ops.partition_counts(log), ["topic", "partition"])
    base, half = F.lit(100) + F.col("partition") * 10, F.when(F.col("partition") % 2 == 1, F.expr("messages div 2")).otherwise(F.lit(0))
    rank = F.col("target_offset")
    places = F.array(F.when(rank < 5, rank), F.when(rank < half, base + rank), base + half + rank)
    back = sent.select("topic", "partition", "key", "value", "headers", F.lit(None).cast("timestamp").alias("timestamp"),
                       F.explode(F.array_compact(places)).alias("offset"))
    before = ops.end_offsets(log).withColumns({"low": F.lit(0), "high": 100 + F.col("partition") * 10})
    return back, before


def q_target_deliveries(spark, d):
    return target.delivered(*_read_back(spark, d)).withColumn("copies", F.col("copies").cast("int"))


def q_target_plan(spark, d):
    """The commit plan in the target's true offsets, after what it held and what came twice."""
    back, before = _read_back(spark, d)
    found, _ = materialize(target.delivered(back, before))
    return target.translate_to_target(found, _captured(spark, d, _events(spark, d)), ops.end_offsets(back))


def _audited(spark, d):
    """The audit of the lineitem log as a stream of three waves of files."""
    li, folder, path = tv.table(spark, d, "lineitem"), scratch_path(spark, "repeating"), scratch_path(spark, "audit")
    files = tv.write_waves(li, "l_suppkey", 3, folder)
    schema = tv.lineitem_log(spark, d).schema
    log = tv.lineitem_as_log(tv.file_stream(spark, li.schema, folder, max_files_per_trigger=files))
    assert log.schema == schema
    run_audit(log, path)
    return spark.read.parquet(f"{path}/audit")


def q_stream_repeats(spark, d):
    """Offsets that a stream brought again, in whatever micro-batch."""
    return repeats_of(_audited(spark, d))


def q_stream_missing(spark, d):
    """Ranges between a stream's offsets, from its keyed state."""
    ends, _ = materialize(ops.end_offsets(tv.lineitem_log(spark, d)))
    return missing_ranges(ends, seen_sets(_audited(spark, d))).checkpoint()


def q_group_offset_lists(spark, d):
    log = _events(spark, d)
    grouped = ops.group_commits(ops.translate_offsets(log, _captured(spark, d, log)), "new_offset")
    return grouped.select("consumer_group", F.posexplode("offsets").alias("place", "o")).select(
        "consumer_group", F.col("place").cast("long").alias("place"), "o.topic", "o.partition", "o.offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "log_rows": q_log_rows,
    "topic_catalog": q_topic_catalog,
    "partition_catalog": q_partition_catalog,
    "end_offsets": q_end_offsets,
    "topic_filter": q_topic_filter,
    "requested_present": q_requested_present,
    "requested_missing": q_requested_missing,
    "point_in_time_cut": q_point_in_time_cut,
    "consumption_report": q_consumption_report,
    "consumption_complete": q_consumption_complete,
    "headers_encode": q_headers_encode,
    "headers_decode": q_headers_decode,
    "partition_counts": q_partition_counts,
    "group_commit_counts": q_group_commit_counts,
    "totals": q_totals,
    "group_catalog": q_group_catalog,
    "commit_capture": q_commit_capture,
    "commit_triples": q_commit_triples,
    "translate_offsets": q_translate_offsets,
    "translate_offsets_conversations": q_translate_offsets_conversations,
    "translate_offsets_lineitem": q_translate_offsets_lineitem,
    "restore_rows": q_restore_rows,
    "restore_rows_lineitem": q_restore_rows_lineitem,
    "restore_rows_hot": q_restore_rows_hot,
    "translate_offsets_hot": q_translate_offsets_hot,
    "publish_rows": q_publish_rows,
    "group_offsets": q_group_offsets,
    "starting_offsets_json": q_starting_offsets_json,
    "null_key_violations": q_null_key_violations,
    "null_topic_commits": q_null_topic_commits,
    "duplicate_offsets": q_duplicate_offsets,
    "latest_per_offset": q_latest_per_offset,
    "snapshot_roundtrip": q_snapshot_roundtrip,
    "snapshot_topic_read": q_snapshot_topic_read,
    "backup_selected_topics": q_backup_selected_topics,
    "snapshot_partition_read": q_snapshot_partition_read,
    "commits_roundtrip": q_commits_roundtrip,
    "commit_plan": q_commit_plan,
    "restore_plan_rows": q_restore_plan_rows,
    "snapshot_lag_report": q_snapshot_lag_report,
    "backup_increments": q_backup_increments,
    "incremental_backup": q_incremental_backup,
    "mixed_backup": q_mixed_backup,
    "mixed_backup_commits": q_mixed_backup_commits,
    "stream_increments": q_stream_increments,
    "stopped_backup": q_stopped_backup,
    "stopped_appended_backup": q_stopped_appended_backup,
    "binary_roundtrip": q_binary_roundtrip,
    "ordered_partition_read": q_ordered_partition_read,
    "publish_order": q_publish_order,
    "delivery_report": q_delivery_report,
    "target_mismatches": q_target_mismatches,
    "usable_ends": q_usable_ends,
    "cut_at_odd_ends": q_cut_at_odd_ends,
    "all_commits": q_all_commits,
    "topic_commits": q_topic_commits,
    "snapshot_topic_commits": q_snapshot_topic_commits,
    "translate_all_commits": q_translate_all_commits,
    "snapshot_topic_report": q_snapshot_topic_report,
    "backup_report": q_backup_report,
    "stopped_report": q_stopped_report,
    "stopped_missing": q_stopped_missing,
    "resumed_report": q_resumed_report,
    "backup_progress": q_backup_progress,
    "bounded_stream": q_bounded_stream,
    "merged_backup": q_merged_backup,
    "snapshot_counts": q_snapshot_counts,
    "damaged_partitions": q_damaged_partitions,
    "target_deliveries": q_target_deliveries,
    "target_plan": q_target_plan,
    "stream_repeats": q_stream_repeats,
    "stream_missing": q_stream_missing,
    "group_offset_lists": q_group_offset_lists,
}


# ---------------------------------------------------------------- oracle SQL (DuckDB)

_EVENTS_LOG = """
events_log AS (
  SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS "offset",
         CAST(user_id AS VARCHAR) AS key, props AS value, epoch_us(ts) // 1000 AS timestamp_ms,
         CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 0
              WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS header_count,
         event_id, event_type, ts
  FROM events)"""

_CONV_LOG = """
conv_log AS (
  SELECT role AS topic, CAST(conv_id AS INTEGER) AS "partition", turn AS "offset",
         CASE WHEN role = 'system' THEN NULL ELSE CAST(conv_id AS VARCHAR) END AS key,
         text AS value, CAST(NULL AS BIGINT) AS timestamp_ms
  FROM conversations)"""

_LINEITEM_LOG = """
li_log AS (
  SELECT l_returnflag AS topic, CAST(l_orderkey % 8 AS INTEGER) AS "partition",
         l_orderkey * 8 + l_linenumber AS "offset", CAST(l_orderkey AS VARCHAR) AS key,
         CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) AS value,
         epoch_us(l_shipdate) // 1000 AS timestamp_ms, l_linestatus
  FROM lineitem),
li_unique AS (
  SELECT topic, "partition", "offset", key, value, timestamp_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY topic, "partition", "offset"
                                 ORDER BY timestamp_ms DESC, key DESC, value DESC, l_linestatus DESC) AS rn
    FROM li_log) WHERE rn = 1),
hot AS (
  SELECT 'hot' AS topic, CAST(0 AS INTEGER) AS "partition", "offset", key, value, timestamp_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY "offset"
                                 ORDER BY timestamp_ms DESC, key DESC, value DESC, l_linestatus DESC) AS rn
    FROM li_log) WHERE rn = 1)"""


def _ends(log: str) -> str:
    return f"""
{log}_ends AS (
  SELECT topic, "partition", min("offset") AS low, max("offset") + 1 AS high FROM {log} GROUP BY topic, "partition")"""


def _commits(log: str) -> str:
    h = "md5(n_name)"
    uuid = (f"'tmp-' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4)"
            f" || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")
    return f"""
{log}_fan AS (
  SELECT e.topic, e."partition", e.high, n.n_name, n.n_nationkey // 5 AS slot
  FROM {log}_ends e JOIN nation n ON n.n_regionkey = e."partition" % 5),
{log}_commits_raw AS (
  SELECT n_name AS consumer_group, topic, "partition",
         CASE WHEN slot = 2 AND "partition" % 2 = 1 THEN -1001 ELSE (high * slot) // 3 END AS committed
  FROM {log}_fan
  UNION ALL
  SELECT {uuid} AS consumer_group, topic, "partition", high AS committed FROM {log}_fan WHERE slot = 0),
{log}_captured AS (
  SELECT consumer_group, topic, "partition", committed FROM {log}_commits_raw c
  WHERE committed IS NOT NULL AND committed <> -1001
    AND NOT regexp_matches(consumer_group, '{IGNORE_GROUP_PATTERN}')
    AND EXISTS (SELECT 1 FROM {log}_ends e WHERE e.topic = c.topic AND e."partition" = c."partition"))"""


def _translated(log: str) -> str:
    return f"""
{log}_translated AS (
  SELECT c.consumer_group, c.topic, c."partition", c.committed,
         (SELECT count(*) FROM {log} l
          WHERE l.topic = c.topic AND l."partition" = c."partition" AND l."offset" < c.committed) AS new_offset
  FROM {log}_captured c)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_EV = _EVENTS_LOG + "," + _ends("events_log") + "," + _commits("events_log")
_TYPE_HEADER = "{'key': 'type', 'val': to_base64(encode(event_type))}"
_TRACE_HEADER = "{'key': 'trace', 'val': CAST(NULL AS VARCHAR)}"
_HEADERS_LIST = f"""CASE WHEN event_id % 10 = 0 THEN NULL
            WHEN event_id % 10 = 1 THEN []
            WHEN event_id % 3 = 0 THEN [{_TYPE_HEADER}, {_TRACE_HEADER}]
            ELSE [{_TYPE_HEADER}] END"""
_TS_HEADER = "{'key': 'source-timestamp-ms', 'val': to_base64(encode(CAST(timestamp_ms AS VARCHAR)))}"

_STORED_HEADERS = f"CASE WHEN event_id % 10 IN (0, 1) THEN NULL ELSE CAST(to_json({_HEADERS_LIST}) AS VARCHAR) END AS headers_json"
_SHOWN = f'''topic, "partition", "offset", key, value, timestamp_ms, {_STORED_HEADERS}, header_count'''
_EVENTS_ROWS = _with(_EVENTS_LOG) + f"""
SELECT {_SHOWN} FROM events_log"""
_ORDER_COMMITS = """
order_commits AS (
  SELECT 'orders-' || o_orderstatus AS consumer_group, spot.topic, CAST(spot.p AS INTEGER) AS "partition", n AS committed
  FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus),
       (SELECT DISTINCT event_type AS t, user_id % 3 AS k FROM events),
       unnest([{'topic': t, 'p': 1}, {'topic': t, 'p': 99}, {'topic': NULL, 'p': 1}]) AS u(spot)
  WHERE k = instr('FOP', o_orderstatus) - 1)"""

_THIRDS = _EVENTS_LOG + f""",
thirds AS (SELECT *, event_id * 3 // (SELECT max(event_id) + 1 FROM events) AS third FROM events_log),
held AS (SELECT * FROM thirds WHERE third <> 1),""" + _ends("events_log") + """,
inner_range AS (
  SELECT e.topic, e."partition", e.low, e.high, h.last_read
  FROM events_log_ends e LEFT JOIN (SELECT topic, "partition", max("offset") AS last_read FROM held GROUP BY 1, 2) h
    ON e.topic = h.topic AND e."partition" = h."partition"),
holes AS (
  SELECT topic, "partition", before + 1 AS low, "offset" AS high FROM (
    SELECT h.topic, h."partition", h."offset",
           coalesce(lag(h."offset") OVER (PARTITION BY h.topic, h."partition" ORDER BY h."offset"), r.low - 1) AS before
    FROM held h JOIN inner_range r ON h.topic = r.topic AND h."partition" = r."partition")
  WHERE "offset" > before + 1)"""
_TARGET = _EV + """,
ranked AS (
  SELECT topic, "partition", "offset", row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") - 1 AS r,
         100 + "partition" * 10 AS base,
         CASE WHEN "partition" % 2 = 1 THEN count(*) OVER (PARTITION BY topic, "partition") // 2 ELSE 0 END AS half
  FROM events_log)"""

ORACLE: dict[str, str] = {
    "log_rows": _with(_EVENTS_LOG) + f"""
SELECT {_SHOWN} FROM events_log""",
    "topic_catalog": _with(_EVENTS_LOG) + """
SELECT DISTINCT topic FROM events_log""",
    "partition_catalog": _with(_EVENTS_LOG) + """
SELECT DISTINCT topic, "partition" FROM events_log""",
    "end_offsets": _with(_EVENTS_LOG, _ends("events_log")) + """
SELECT topic, "partition", low, high, high - 1 AS last_offset FROM events_log_ends""",
    "topic_filter": _with(_EVENTS_LOG) + """
SELECT topic, "partition", "offset" FROM events_log WHERE topic IN ('click', 'purchase')""",
    "requested_present": """
SELECT t AS topic FROM (VALUES ('click'), ('purchase'), ('refund'), ('signup'), ('audit')) v(t)
WHERE t IN (SELECT event_type FROM events)""",
    "requested_missing": """
SELECT t AS topic FROM (VALUES ('click'), ('purchase'), ('refund'), ('signup'), ('audit')) v(t)
WHERE t NOT IN (SELECT event_type FROM events)""",
    "point_in_time_cut": _with(_EVENTS_LOG) + f"""
, early AS (
  SELECT topic, "partition", max("offset") + 1 AS high FROM events_log
  WHERE ts < TIMESTAMP '{CUT_TIME}' GROUP BY topic, "partition")
SELECT l.topic, l."partition", l."offset", l.key, l.value, l.timestamp_ms
FROM events_log l JOIN early e ON l.topic = e.topic AND l."partition" = e."partition"
WHERE l."offset" < e.high""",
    "consumption_report": _with(_CONV_LOG, _ends("conv_log")) + f"""
, last AS (
  SELECT topic, "partition", max("offset") AS last_read FROM conv_log
  WHERE "offset" < {CONSUMED_TURNS} AND topic <> '{UNREACHED_TOPIC}' GROUP BY topic, "partition")
SELECT e.topic, e."partition", e.low, e.high, l.last_read,
       CASE WHEN l.last_read IS NULL THEN 'not_consumed' WHEN l.last_read >= e.high - 1 THEN 'done'
            ELSE 'remaining' END AS status,
       CASE WHEN l.last_read IS NULL THEN NULL ELSE greatest(e.high - 1 - l.last_read, 0) END AS remaining
FROM conv_log_ends e LEFT JOIN last l ON e.topic = l.topic AND e."partition" = l."partition"
WHERE e.low < e.high""",
    "consumption_complete": _with(_CONV_LOG, _ends("conv_log")) + f"""
, last AS (
  SELECT topic, "partition", max("offset") AS last_read FROM conv_log
  WHERE "offset" < {CONSUMED_TURNS} AND topic <> '{UNREACHED_TOPIC}' GROUP BY topic, "partition"),
rep AS (
  SELECT coalesce(l.last_read >= e.high - 1, false) AS done
  FROM conv_log_ends e LEFT JOIN last l ON e.topic = l.topic AND e."partition" = l."partition")
SELECT coalesce(bool_and(done), true) AS complete, count(*) AS partitions,
       count(*) FILTER (WHERE done) AS done_partitions FROM rep""",
    "headers_encode": _with(_EVENTS_LOG) + f"""
SELECT topic, "partition", "offset",
       CASE WHEN event_id % 10 IN (0, 1) THEN NULL ELSE CAST(to_json({_HEADERS_LIST}) AS VARCHAR) END AS headers_json
FROM events_log""",
    "headers_decode": _with(_EVENTS_LOG) + """
SELECT topic, "partition", "offset", 0 AS header_pos, 'type' AS header_key, event_type AS header_value
FROM events_log WHERE event_id % 10 NOT IN (0, 1)
UNION ALL
SELECT topic, "partition", "offset", 1 AS header_pos, 'trace' AS header_key, NULL AS header_value
FROM events_log WHERE event_id % 10 NOT IN (0, 1) AND event_id % 3 = 0""",
    "partition_counts": _with(_EVENTS_LOG) + """
SELECT topic, "partition", count(*) AS messages FROM events_log GROUP BY topic, "partition" """,
    "group_commit_counts": _with(_EV) + """
SELECT consumer_group, count(*) AS commits FROM events_log_captured GROUP BY consumer_group""",
    "totals": _with(_EV) + """
SELECT 'partitions' AS metric, count(*) AS value FROM events_log_ends
UNION ALL SELECT 'messages', count(*) FROM events_log
UNION ALL SELECT 'commits', count(*) FROM events_log_captured
UNION ALL SELECT 'groups', count(DISTINCT consumer_group) FROM events_log_captured""",
    "group_catalog": _with(_EV) + f"""
SELECT DISTINCT consumer_group, regexp_matches(consumer_group, '{IGNORE_GROUP_PATTERN}') AS ignored
FROM events_log_commits_raw""",
    "commit_triples": _with(_EV, _translated("events_log")) + """
SELECT consumer_group, topic, "partition", new_offset AS "offset" FROM events_log_translated""",
    "commit_capture": _with(_EV) + """
SELECT * FROM events_log_captured""",
    "translate_offsets": _with(_EV, _translated("events_log")) + """
SELECT * FROM events_log_translated""",
    "translate_offsets_conversations": _with(_CONV_LOG, _ends("conv_log"), _commits("conv_log"),
                                             _translated("conv_log")) + """
SELECT * FROM conv_log_translated""",
    "translate_offsets_lineitem": _with(_LINEITEM_LOG, _ends("li_unique"), _commits("li_unique"),
                                        _translated("li_unique")) + """
SELECT * FROM li_unique_translated""",
    "restore_rows": _with(_EVENTS_LOG) + """
SELECT topic, "partition", "offset", key, value, timestamp_ms,
       row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") - 1 AS target_offset
FROM events_log""",
    "restore_rows_lineitem": _with(_LINEITEM_LOG) + """
SELECT topic, "partition", "offset",
       row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") - 1 AS target_offset
FROM li_unique""",
    "restore_rows_hot": _with(_LINEITEM_LOG) + """
SELECT topic, "partition", "offset", row_number() OVER (ORDER BY "offset") - 1 AS target_offset FROM hot""",
    "translate_offsets_hot": _with(_LINEITEM_LOG, _ends("hot"), _commits("hot"), _translated("hot")) + """
SELECT * FROM hot_translated""",
    "publish_rows": _with(_EVENTS_LOG) + f"""
SELECT topic, "partition", key, value,
       CAST(to_json(list_concat(coalesce({_HEADERS_LIST}, []), [{_TS_HEADER}])) AS VARCHAR) AS headers_json
FROM events_log""",
    "group_offsets": _with(_EV, _translated("events_log")) + """
SELECT consumer_group, count(*) AS partitions, CAST(sum(new_offset) AS BIGINT) AS offset_sum
FROM events_log_translated GROUP BY consumer_group""",
    "starting_offsets_json": _with(_EV, _translated("events_log")) + """
, per_topic AS (
  SELECT consumer_group, topic,
         '{' || string_agg('"' || CAST("partition" AS VARCHAR) || '":' || CAST(new_offset AS VARCHAR), ','
                           ORDER BY "partition") || '}' AS pj
  FROM events_log_translated GROUP BY consumer_group, topic)
SELECT consumer_group, '{' || string_agg('"' || topic || '":' || pj, ',' ORDER BY topic) || '}' AS starting_offsets
FROM per_topic GROUP BY consumer_group""",
    "null_key_violations": _with(_CONV_LOG) + """
SELECT topic, "partition", "offset" FROM conv_log WHERE key IS NULL""",
    "null_topic_commits": _with(_EV, _ORDER_COMMITS) + """
SELECT * FROM order_commits WHERE topic IS NULL""",
    "duplicate_offsets": _with(_LINEITEM_LOG) + """
SELECT topic, "partition", "offset", count(*) AS copies FROM li_log
GROUP BY topic, "partition", "offset" HAVING count(*) > 1""",
    "latest_per_offset": _with(_LINEITEM_LOG) + """
SELECT * FROM li_unique""",
    "snapshot_roundtrip": _with(_EVENTS_LOG) + f"""
SELECT {_SHOWN} FROM events_log""",
    "snapshot_topic_read": _with(_EVENTS_LOG) + f"""
SELECT {_SHOWN} FROM events_log
WHERE topic IN ('click', 'view')""",
    "backup_selected_topics": _with(_EVENTS_LOG) + f"""
SELECT {_SHOWN} FROM events_log
WHERE topic IN ('click', 'view')""",
    "snapshot_partition_read": _with(_EVENTS_LOG) + f"""
SELECT {_SHOWN} FROM events_log
WHERE topic = 'click' AND "partition" = 1""",
    "commits_roundtrip": _with(_EV) + """
SELECT * FROM events_log_captured""",
    "commit_plan": _with(_EV, _translated("events_log")) + """
SELECT * FROM events_log_translated""",
    "restore_plan_rows": _with(_EVENTS_LOG) + """
SELECT topic, "partition", "offset", key, value, timestamp_ms,
       row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") - 1 AS target_offset
FROM events_log""",
    "snapshot_lag_report": _with(_EVENTS_LOG, _ends("events_log")) + f"""
, early AS (
  SELECT topic, "partition", max("offset") + 1 AS high FROM events_log
  WHERE ts < TIMESTAMP '{CUT_TIME}' GROUP BY topic, "partition"),
last AS (
  SELECT l.topic, l."partition", max(l."offset") AS last_read
  FROM events_log l JOIN early e ON l.topic = e.topic AND l."partition" = e."partition"
  WHERE l."offset" < e.high GROUP BY l.topic, l."partition")
SELECT e.topic, e."partition", e.low, e.high, l.last_read,
       CASE WHEN l.last_read IS NULL THEN 'not_consumed' WHEN l.last_read >= e.high - 1 THEN 'done'
            ELSE 'remaining' END AS status,
       CASE WHEN l.last_read IS NULL THEN NULL ELSE greatest(e.high - 1 - l.last_read, 0) END AS remaining
FROM events_log_ends e LEFT JOIN last l
  ON e.topic = l.topic AND e."partition" = l."partition"
""",
    "backup_increments": _with(_EVENTS_LOG) + f"""
SELECT {_SHOWN} FROM events_log""",
    "incremental_backup": _with(_EVENTS_LOG) + f"""
SELECT {_SHOWN} FROM events_log""",
    "mixed_backup": _EVENTS_ROWS,
    "mixed_backup_commits": _with(_EV) + """
SELECT * FROM events_log_captured""",
    "stream_increments": _EVENTS_ROWS,
    "stopped_backup": _EVENTS_ROWS,
    "stopped_appended_backup": _EVENTS_ROWS,
    "binary_roundtrip": _with(_EVENTS_LOG) + """
SELECT topic, "partition", "offset", md5(CAST("offset" AS VARCHAR)) AS key, md5(topic || ':' || "offset") AS value FROM events_log""",
    "ordered_partition_read": _with(_EVENTS_LOG) + """
SELECT topic, "partition", "offset", row_number() OVER (ORDER BY "offset") - 1 AS place FROM events_log WHERE topic = 'click' AND "partition" = 1""",
    "publish_order": _with(_EVENTS_LOG) + """
SELECT topic, "partition", "offset", row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") - 1 AS place
FROM events_log""",
    "delivery_report": _with(_EVENTS_LOG) + """
SELECT topic, "partition", row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") - 1 AS "offset",
       key, value, timestamp_ms FROM events_log""",
    "target_mismatches": _with(_EVENTS_LOG) + """
SELECT topic, "partition", count(*) AS published, CASE WHEN "partition" = 1 THEN count(*) + 1 ELSE 0 END AS grown
FROM events_log WHERE "partition" IN (1, 2) GROUP BY topic, "partition" """,
    "usable_ends": _with(_EVENTS_LOG, _ends("events_log")) + """
SELECT * FROM events_log_ends WHERE "partition" NOT IN (0, 1)""",
    "cut_at_odd_ends": _with(_EVENTS_LOG) + """
SELECT topic, "partition", "offset", key, value, timestamp_ms FROM events_log WHERE "partition" NOT IN (0, 1)""",
    "all_commits": _with(_EV, _ORDER_COMMITS) + """
SELECT * FROM events_log_commits_raw UNION ALL SELECT * FROM order_commits""",
    "topic_commits": _with(_EV, _ORDER_COMMITS) + """
SELECT * FROM events_log_captured WHERE topic IN ('click', 'purchase')
UNION ALL SELECT * FROM order_commits WHERE topic IN ('click', 'purchase') AND "partition" = 1""",
    "snapshot_topic_commits": _with(_EV) + """
SELECT * FROM events_log_captured WHERE topic IN ('click', 'view')""",
    "translate_all_commits": _with(_EV, _ORDER_COMMITS) + """
, all_commits AS (SELECT * FROM events_log_commits_raw UNION ALL SELECT * FROM order_commits)
SELECT c.*, (SELECT count(*) FROM events_log l WHERE l.topic = c.topic AND l."partition" = c."partition"
                                                 AND l."offset" < c.committed) AS new_offset
FROM all_commits c WHERE EXISTS (SELECT 1 FROM events_log_ends e WHERE e.topic = c.topic AND e."partition" = c."partition")""",
    "snapshot_topic_report": _with(_EVENTS_LOG, _ends("events_log")) + """
SELECT topic, "partition", low, high, high - 1 AS last_read, 'done' AS status, CAST(0 AS BIGINT) AS remaining
FROM events_log_ends WHERE topic IN ('click', 'view')""",
    "backup_report": _with(_EVENTS_LOG) + f"""
SELECT topic, "partition", min("offset") AS low, max("offset") + 1 AS high, max("offset") AS last_read, 'done' AS status,
       CAST(0 AS BIGINT) AS remaining
FROM events_log WHERE ts < TIMESTAMP '{CUT_TIME}' GROUP BY topic, "partition" """,
    "stopped_report": _with(_THIRDS) + """
SELECT r.topic, r."partition", r.low, r.high, last_read,
       CASE WHEN last_read IS NULL THEN 'not_consumed' WHEN last_read >= r.high - 1 AND n IS NULL THEN 'done' ELSE 'remaining' END AS status,
       CASE WHEN last_read IS NOT NULL THEN (greatest(r.high - 1 - last_read, 0) + coalesce(n, 0))::BIGINT END AS remaining
FROM inner_range r LEFT JOIN (SELECT topic, "partition", sum(high - low) AS n FROM holes GROUP BY 1, 2) h
  ON r.topic = h.topic AND r."partition" = h."partition" """,
    "stopped_missing": _with(_THIRDS) + """
SELECT topic, "partition", low, high FROM holes""",
    "resumed_report": _with(_EVENTS_LOG, _ends("events_log")) + """
SELECT topic, "partition", low, high, high - 1 AS last_read, 'done' AS status, CAST(0 AS BIGINT) AS remaining FROM events_log_ends""",
    "backup_progress": _with(_THIRDS) + """
, n AS (SELECT count_if(third <> 1) AS first, count_if(third = 1) AS second FROM thirds)
SELECT 1 AS run_no, 0 AS batch, first AS seen, first AS written, NULL AS outcome FROM n
UNION ALL SELECT 1, NULL, first, first, 'batch limit' FROM n
UNION ALL SELECT 2, 1, second, second, NULL FROM n
UNION ALL SELECT 2, NULL, second, second, 'finished' FROM n""",
    "bounded_stream": _with(_EVENTS_LOG) + f"""
, early AS (SELECT topic, "partition", max("offset") + 1 AS high FROM events_log WHERE ts < TIMESTAMP '{CUT_TIME}' GROUP BY 1, 2)
SELECT l.topic, l."partition", l."offset", 1 AS run_no
FROM events_log l JOIN early e ON l.topic = e.topic AND l."partition" = e."partition" WHERE l."offset" < e.high
UNION ALL SELECT topic, "partition", "offset", 2 FROM events_log""",
    "merged_backup": _EVENTS_ROWS,
    "snapshot_counts": _with(_EVENTS_LOG) + """
SELECT topic, "partition", count(*) AS messages, count(DISTINCT "offset") AS offsets FROM events_log GROUP BY topic, "partition" """,
    "damaged_partitions": _with(_EVENTS_LOG) + """
, n AS (SELECT topic, "partition", count(*) AS messages FROM events_log GROUP BY topic, "partition"),
stray AS (SELECT messages AS more FROM n WHERE topic = 'click' AND "partition" = 1)
SELECT topic, "partition", messages, messages + more AS found FROM n, stray
WHERE (topic = 'click' AND "partition" = 1) OR (topic = 'view' AND "partition" = 2)""",
    "target_deliveries": _with(_TARGET) + """
SELECT topic, "partition", "offset", base + half + r AS target_offset, CASE WHEN r < half THEN 2 ELSE 1 END AS copies FROM ranked""",
    "target_plan": _with(_TARGET, _translated("events_log")) + """
SELECT t.consumer_group, t.topic, t."partition", t.committed, t.new_offset + p.base + p.half AS new_offset
FROM events_log_translated t JOIN (SELECT DISTINCT topic, "partition", base, half FROM ranked) p
  ON t.topic = p.topic AND t."partition" = p."partition" """,
    "stream_repeats": _with(_LINEITEM_LOG) + """
SELECT topic, "partition", "offset", count(*) - 1 AS repeats FROM li_log GROUP BY topic, "partition", "offset" HAVING count(*) > 1""",
    "stream_missing": _with(_LINEITEM_LOG) + """
SELECT topic, "partition", before + 1 AS low, "offset" AS high FROM (
  SELECT topic, "partition", "offset", lag("offset") OVER (PARTITION BY topic, "partition" ORDER BY "offset") AS before FROM li_unique)
WHERE "offset" > before + 1""",
    "group_offset_lists": _with(_EV, _translated("events_log")) + """
SELECT consumer_group, row_number() OVER (PARTITION BY consumer_group ORDER BY topic, "partition", new_offset) - 1 AS place,
       topic, "partition", new_offset AS "offset" FROM events_log_translated""",
}


# ---------------------------------------------------------------- contract

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: where each consumer group continues after a restore (sf0.001)."""
    return q_translate_offsets(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    extra = {**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {}
    return {**QUERIES, **extra}


def oracle_sql() -> dict[str, str]:
    extra = dict(llm.ORACLE_SQL) if llm else {}
    if llm and corpus_pipeline.ORACLE_SQL:
        extra["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {k: v for k, v in {**ORACLE, **extra}.items() if k in queries()}
