"""Incremental backup with Structured Streaming.

Each run drains what the source holds at its start (``availableNow``) and stops; the
checkpoint remembers the source position, so the next run takes only what arrived
since.  Every micro-batch goes through the snapshot writer (``foreachBatch``) as an
increment of its own, named by the checkpoint and the batch: a batch that Spark runs again
after a failure replaces what its first attempt left.  Batch and streaming backups share one
layout and may add to one snapshot: only offsets that others did not write there are
written.  What the stream itself wrote does not count for that: its checkpoint keeps rows from coming
twice, and files may arrive in any order of offsets.

A time limit (or a number of micro-batches) stops the run early and keeps the finished micro-batches, and the next run
resumes.  That needs bounded micro-batches: give the source a limit (``max_files_per_trigger``
of ``tables.events_stream``, ``maxOffsetsPerTrigger`` of ``stream_kafka_log``; both have defaults).

With ``ends`` the run takes each partition up to its end and no further.  The checkpoint has passed what lies beyond, so those
messages are written aside (``pending``) with the same increment; the next run takes them first, as far as its own ends allow.

Each micro-batch's state tells what it saw and wrote, and each run adds one with its outcome: ``read_progress`` shows
them.  A run that came to its end also vouches for the ranges it holds, so a report after a stopped run names the holes
and one after a finished run does not take a log's own gaps for holes.
"""
from __future__ import annotations

import datetime as dt
import logging
import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.groups import IGNORE_GROUP_PATTERN
from tidemark.operators.catalog import select_topics
from tidemark.operators.checks import guard_null_keys
from tidemark.operators.commits import capture_commits
from tidemark.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, join_checked
from tidemark.plans.backup import after_snapshot, check_topics
from tidemark.plans.report import snapshot_report
from tidemark.schemas import ENDS, LOG, conform
from tidemark.session import materialize, observed_count
from tidemark.sinks.snapshot import held_ends, merge_increments, next_seq, read_state, write_commits, write_increment, write_state
from tidemark.sources.snapshot import read_pending, read_progress

CHECKPOINT_DIR = "_checkpoint"
# fixed value: progress is logged each time this many more rows are in
PROGRESS_EVERY = 100_000
POLL_SECONDS = 2.0
# fixed values: how a run ended
FINISHED, TIME_LIMIT, BATCH_LIMIT, USER_STOP = "finished", "time limit", "batch limit", "user stop"

logger = logging.getLogger(__name__)


@dataclass
class IncrementResult:
    spark: SparkSession
    path: str
    topics: list[str] | None
    finished: bool
    batches: int
    rows: int
    outcome: str = FINISHED

    def progress(self) -> DataFrame:
        """One row for each micro-batch and each run's end, of all runs on the snapshot."""
        return read_progress(self.spark, self.path)

    def report(self, ends: DataFrame) -> DataFrame:
        """Per partition of ``ends``: done, not consumed or remaining."""
        return snapshot_report(self.spark, self.path, ends, self.topics)


def checkpoint_path(path: str) -> str:
    return f"{path.rstrip('/')}/{CHECKPOINT_DIR}/messages"


def _wait(query, timeout: float | None, every: int, poll: float, rows_by_batch: dict[int, int]) -> bool:
    """Wait for the query; True if it ended by itself, False if the time limit stopped it."""
    deadline = None if timeout is None else time.monotonic() + timeout
    logged = 0
    while True:
        wait = poll if deadline is None else max(0.01, min(poll, deadline - time.monotonic()))
        done = bool(query.awaitTermination(wait))
        total = sum(rows_by_batch.values())
        if every and total // every > logged // every:
            logger.info("backup %s: %d messages so far", query.id, total)
            logged = total
        if done:
            return True
        if deadline is not None and time.monotonic() >= deadline:
            query.stop()  # finished micro-batches stay committed; the next run resumes
            return False


class _Stop(Exception):
    """Ends a run before its next micro-batch."""


def at_ends(log: DataFrame, bounds: DataFrame, rows: int, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(messages below their partition's end, the others).  A partition without an end has none below."""
    ends = bounds.where(F.col("high").isNotNull()).select("topic", "partition", F.col("high").alias("_high"))
    both = join_checked(log, ends, ["topic", "partition"], "left", max_broadcast_rows, known_rows=rows)
    inside = F.coalesce(F.col("offset") < F.col("_high"), F.lit(False))
    return both.where(inside).select(*log.columns), both.where(~inside).select(*log.columns)


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def _take_pending(spark: SparkSession, path: str, run: str, wanted: list[str] | None, bounds, null_key: str, options: dict) -> int:
    """Write the waiting messages that this run's ends allow, as one increment; their number."""
    waiting, names = read_pending(spark, path)
    if waiting is None:
        return 0
    chosen = F.col("topic").isin(wanted) if wanted else F.lit(True)
    ready, rest = waiting.where(chosen), waiting.where(~F.coalesce(chosen, F.lit(False)))
    if bounds is not None:
        ready, late = at_ends(ready, *bounds)
        rest = rest.unionByName(late)
    if ready.isEmpty():
        return 0
    fresh = after_snapshot(spark, ready, path)
    left = None if rest.isEmpty() else rest
    return write_increment(guard_null_keys(fresh, null_key), path, mode="append", increment=f"taken-{run}", pending=left,
                           own={"takes": names, "run": run, "at": _now()}, **options)


def incremental_backup(stream_log: DataFrame, path: str, timeout: float | None = None,
                       checkpoint: str | None = None, commits: DataFrame | None = None,
                       topics: Iterable[str] | None = None, ignore_missing_topics: bool = False,
                       ends: DataFrame | None = None, null_key: str = "error",
                       ignore_group_pattern: str | None = IGNORE_GROUP_PATTERN,
                       progress_every: int = PROGRESS_EVERY, poll_seconds: float = POLL_SECONDS,
                       max_batches: int | None = None, merge_above: int | None = None,
                       **write_options) -> IncrementResult:
    """Add everything new in ``stream_log`` to the snapshot at ``path``, up to ``ends`` where they are given.

    ``timeout`` (seconds, None = no limit) and ``max_batches`` bound the run.  ``topics`` chooses topics; missing
    ones are checked against ``ends`` (the log's ends) before the run, or, without it, against
    what the snapshot holds after a finished run.  Messages at or beyond their partition's end, and those of partitions
    without one, wait for a later run.  ``null_key="error"`` fails the run at a message without a key.
    When ``commits`` is given and the run finished, the commits of kept groups on the snapshot's
    partitions are captured as by ``backup`` and take the place of the earlier ones.  Progress is
    logged every ``progress_every`` rows.  ``merge_above``: a finished run that leaves more increments
    merges them into one."""
    if not stream_log.isStreaming:
        raise ValueError("incremental_backup needs a streaming DataFrame")
    spark = stream_log.sparkSession
    wanted = list(dict.fromkeys(topics)) if topics else None
    bounds = None
    if ends is not None:
        if wanted:
            check_topics(ends, wanted, ignore_missing_topics)
        bounds = materialize(select_topics(conform(ends, ENDS), wanted))     # one row a partition
    run = uuid.uuid4().hex[:12]
    deadline = None if timeout is None else time.monotonic() + timeout
    taken = _take_pending(spark, path, run, wanted, bounds, null_key, write_options)
    rows_by_batch: dict[int, int] = {}
    seen_by_batch: dict[int, int] = {}
    started, name, stopped = threading.Event(), {}, {}

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        if max_batches is not None and len(rows_by_batch) >= max_batches:
            stopped["why"] = BATCH_LIMIT
        elif deadline is not None and time.monotonic() >= deadline:
            stopped["why"] = TIME_LIMIT
        if stopped:
            raise _Stop(stopped["why"])         # before anything is written: the next run gets this batch
        increment = f"{name['query']}-{batch_id}"
        obs = Observation(f"seen_{uuid.uuid4().hex[:8]}")
        inside, later = batch.observe(obs, F.count(F.lit(1)).alias("seen")), None
        if bounds is not None:
            inside, _ = at_ends(inside, *bounds)
            _, later = at_ends(batch, *bounds)
            later = None if later.isEmpty() else later
        fresh = after_snapshot(batch.sparkSession, inside, path, without_prefix=f"{name['query']}-")

        def seen() -> int:
            n = observed_count(obs, "seen")
            seen_by_batch[batch_id] = batch.count() if n is None else n
            return seen_by_batch[batch_id]

        rows_by_batch[batch_id] = write_increment(guard_null_keys(fresh, null_key), path, mode="append", increment=increment, pending=later,
                                                  own={"run": run, "batch": batch_id, "seen": seen, "at": _now()}, **write_options)

    query = (select_topics(conform(stream_log, LOG), wanted).writeStream.foreachBatch(write)
             .option("checkpointLocation", checkpoint or checkpoint_path(path))
             .trigger(availableNow=True).start())
    name["query"] = str(query.id)       # the same for all runs on one checkpoint
    started.set()
    try:
        finished = _wait(query, None if deadline is None else max(0.0, deadline - time.monotonic()), progress_every, poll_seconds, rows_by_batch)
        outcome = FINISHED if finished else TIME_LIMIT
    except StreamingQueryException:
        if not stopped:
            raise
        finished, outcome = False, stopped["why"]
    except KeyboardInterrupt:
        # stopped by the user: committed micro-batches stay, the next run resumes
        query.stop()
        finished, outcome = False, USER_STOP
        logger.info("backup %s stopped by the user", query.id)
    rows, batches = sum(rows_by_batch.values()) + taken, sum(1 for n in rows_by_batch.values() if n)
    logger.info("backup %s: %d messages in %d batches, %s", query.id, rows, batches, outcome)
    held = held_ends(spark, path)
    if finished and wanted and ends is None and held is not None:
        check_topics(held, wanted, ignore_missing_topics)
    if held is not None or (finished and commits is not None):
        _close_run(spark, path, run, held, commits if finished else None, wanted, ignore_group_pattern,
                   {"seen": sum(seen_by_batch.values()), "written": rows, "outcome": outcome})
    if finished and merge_above is not None and read_state(spark, path).where("own").count() > merge_above:
        merge_increments(spark, path)
    return IncrementResult(spark, path, wanted, finished, batches, rows, outcome)


def _close_run(spark: SparkSession, path: str, run: str, held: DataFrame | None, commits: DataFrame | None, wanted: list[str] | None,
               pattern: str | None, told: dict) -> None:
    """One state that tells the run's outcome: its commits, and what it vouches for when it came to its end."""
    increment = f"run-{run}"
    if commits is not None:
        partitions = spark.createDataFrame([], LOG).select("topic", "partition") if held is None else held
        write_commits(capture_commits(commits, partitions, wanted, pattern), path, increment)
    covered = held if held is not None and told["outcome"] == FINISHED else None
    write_state(spark, path, increment, covered=covered, seq=next_seq(spark, path, increment), has_commits=commits is not None,
                run=run, at=_now(), **told)
