import os

import pyarrow.parquet as pq
import pyarrow.compute as pc

from conftest import SF_SMALL
from tidemark.sources import tables as tv
from tidemark.sources.snapshot import read_messages
from tidemark.streaming import incremental_backup


def test_increments_add_up_to_one_backup(spark, scratch):
    # the events table split in two files that arrive one after the other
    src = os.path.join(scratch, "src")
    os.makedirs(src)
    events = pq.read_table(os.path.join(SF_SMALL, "events.parquet"))
    cut = events.filter(pc.less(events["event_id"], 600))
    rest = events.filter(pc.greater_equal(events["event_id"], 600))
    pq.write_table(cut, os.path.join(src, "part-1.parquet"))
    path = os.path.join(scratch, "snap")
    schema = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        return incremental_backup(tv.events_as_log(stream), path)

    first = run()
    assert first.finished and first.rows == cut.num_rows
    pq.write_table(rest, os.path.join(src, "part-2.parquet"))
    second = run()
    assert second.rows == rest.num_rows
    third = run()
    assert third.rows == 0
    full = tv.events_log(spark, SF_SMALL)
    back = read_messages(spark, path)
    assert back.exceptAll(full).count() == 0 and full.exceptAll(back).count() == 0


def test_time_limit_keeps_batches_and_next_run_resumes(spark, scratch):
    src = os.path.join(scratch, "src")
    os.makedirs(src)
    events = pq.read_table(os.path.join(SF_SMALL, "events.parquet"))
    step = events.num_rows // 8 + 1
    for i in range(8):
        pq.write_table(events.slice(i * step, step), os.path.join(src, f"part-{i}.parquet"))
    path = os.path.join(scratch, "snap")
    schema = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).schema

    def run(timeout):
        return incremental_backup(tv.events_as_log(tv.file_stream(spark, schema, src, max_files_per_trigger=1)), path,
                                  timeout=timeout, poll_seconds=0.1)

    first = run(6.0)  # stops early (or finishes); finished batches stay readable
    if first.rows:
        assert read_messages(spark, path).count() >= first.rows
    rest = run(None)
    assert rest.finished
    full = tv.events_log(spark, SF_SMALL)
    back = read_messages(spark, path)
    assert back.exceptAll(full).count() == 0 and full.exceptAll(back).count() == 0


def test_progress_adds_up_over_many_batches(spark, scratch):
    # more batches than a short poll sees at once: rows still add up by batch id
    src = os.path.join(scratch, "src")
    os.makedirs(src)
    events = pq.read_table(os.path.join(SF_SMALL, "events.parquet"))
    step = events.num_rows // 12 + 1
    for i in range(12):
        pq.write_table(events.slice(i * step, step), os.path.join(src, f"part-{i:02d}.parquet"))
    schema = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    result = incremental_backup(tv.events_as_log(stream), os.path.join(scratch, "snap"), poll_seconds=0.2,
                                progress_every=100)
    assert result.finished and result.batches == 12 and result.rows == events.num_rows


def _stream(spark, scratch, folder="src"):
    src = os.path.join(scratch, folder)
    os.makedirs(src)
    pq.write_table(pq.read_table(os.path.join(SF_SMALL, "events.parquet")), os.path.join(src, "p.parquet"))
    schema = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).schema
    return lambda: tv.events_as_log(tv.file_stream(spark, schema, src))


def test_user_stop_keeps_finished_batches(spark, scratch, monkeypatch):
    import tidemark.streaming.incremental as inc
    stream = _stream(spark, scratch)
    path = os.path.join(scratch, "snap")

    def interrupted(query, *args):
        query.processAllAvailable()
        raise KeyboardInterrupt

    monkeypatch.setattr(inc, "_wait", interrupted)
    result = inc.incremental_backup(stream(), path)
    assert result.finished is False and not any(q.isActive for q in spark.streams.active)
    assert read_messages(spark, path).count() == tv.events_log(spark, SF_SMALL).count()


def test_batch_and_stream_share_a_snapshot(spark, scratch):
    from builders import commits_df
    from tidemark.operators import end_offsets
    from tidemark.plans import backup
    from tidemark.sources.snapshot import read_commits
    log = tv.events_log(spark, SF_SMALL)
    path = os.path.join(scratch, "snap")
    commits = commits_df(spark, [("g", "click", 1, 40), ("never", "click", 1, -1001), ("g", "gone", 0, 3),
                                 ("tmp-1b9d6bcd-bbfd-4b2d-9b5d-ab8dfbbd4bed", "click", 1, 5)])
    backup(log, commits_df(spark, []), path, ends=end_offsets(log.where("offset < 300")))
    result = incremental_backup(_stream(spark, scratch)(), path, commits=commits)
    assert result.finished and result.rows < log.count()
    back = read_messages(spark, path)
    assert back.exceptAll(log).count() == 0 and log.exceptAll(back).count() == 0
    assert [tuple(r) for r in read_commits(spark, path).collect()] == [("g", "click", 1, 40)]
    assert {r.status for r in result.report(end_offsets(log)).collect()} == {"done"}
    # and a batch append after the stream
    more = log.where("topic = 'click' and partition = 1").withColumn("offset", log["offset"] + 100_000)
    backup(log.unionByName(more), commits, path, mode="append")
    assert read_messages(spark, path).count() == log.count() + more.count()


def test_a_batch_run_again_replaces_its_first_attempt(spark, scratch, monkeypatch):
    """The checkpoint is lost between the write and its commit: the same batch comes again."""
    import tidemark.streaming.incremental as inc
    path = os.path.join(scratch, "snap")
    stream, real, calls = _stream(spark, scratch), inc.write_increment, []

    def dies_after_writing(*args, **kw):
        n = real(*args, **kw)
        calls.append(n)
        if len(calls) == 1:
            raise RuntimeError("lost executor")
        return n

    monkeypatch.setattr(inc, "write_increment", dies_after_writing)
    try:
        inc.incremental_backup(stream(), path)
    except Exception:
        pass
    inc.incremental_backup(stream(), path)
    log = tv.events_log(spark, SF_SMALL)
    back = read_messages(spark, path)
    assert len(calls) >= 2
    assert back.exceptAll(log).count() == 0 and log.exceptAll(back).count() == 0


def test_stream_topics_and_null_keys(spark, scratch):
    import pytest
    from pyspark.sql import functions as F
    from tidemark.operators import end_offsets
    from tidemark.plans import MissingTopicsError
    stream = _stream(spark, scratch)
    path = os.path.join(scratch, "snap")
    log = tv.events_log(spark, SF_SMALL)
    with pytest.raises(MissingTopicsError):
        incremental_backup(stream(), path, topics=["click", "nope"], ends=end_offsets(log))
    incremental_backup(stream(), path, topics=["click", "nope"], ends=end_offsets(log), ignore_missing_topics=True)
    assert {r.topic for r in read_messages(spark, path).select("topic").distinct().collect()} == {"click"}
    with pytest.raises(MissingTopicsError):
        incremental_backup(stream(), os.path.join(scratch, "other"), topics=["nope"])
    unkeyed = stream().withColumn("key", F.lit(None).cast("binary"))
    with pytest.raises(Exception, match="null key"):
        incremental_backup(unkeyed, os.path.join(scratch, "unkeyed"))
    assert incremental_backup(unkeyed, os.path.join(scratch, "kept"), null_key="keep").rows == log.count()


def test_append_to_a_stopped_stream_fills_its_gaps(spark, scratch):
    from builders import commits_df, messages
    from tidemark.plans import backup
    from tidemark.schemas import LOG
    log = messages(spark, "t", 0, range(111)).cache()
    files = ["offset < 6", "offset >= 100", "offset between 6 and 99"]
    for name, first in (("one-increment", [" or ".join(files[:2])]), ("two-increments", files[:2])):
        src, path = os.path.join(scratch, name, "src"), os.path.join(scratch, name, "snap")
        stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)      # noqa: E731
        for part in first:
            log.where(part).coalesce(1).write.mode("append").parquet(src)
        assert incremental_backup(stream(), path).rows == 17
        assert backup(log, commits_df(spark, []), path, mode="append").messages == 94
        log.where(files[2]).coalesce(1).write.mode("append").parquet(src)
        assert incremental_backup(stream(), path).rows == 0
        assert sorted(r.offset for r in read_messages(spark, path).collect()) == list(range(111))


def test_a_stream_fills_gaps_of_a_batch(spark, scratch):
    from builders import commits_df, messages
    from tidemark.plans import backup
    from tidemark.schemas import LOG
    log = messages(spark, "t", 0, range(20)).cache()
    src, path = os.path.join(scratch, "src"), os.path.join(scratch, "snap")
    backup(log.where("offset in (0, 3, 12)"), commits_df(spark, []), path)
    log.coalesce(1).write.parquet(src)
    assert incremental_backup(spark.readStream.schema(LOG).parquet(src), path).rows == 17
    assert sorted(r.offset for r in read_messages(spark, path).collect()) == list(range(20))
