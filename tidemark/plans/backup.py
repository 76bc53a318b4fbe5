"""``backup``: cut a log at an end-offset snapshot and write it with its commits.

One lazy plan per output: topic check, end snapshot (materialised, small),
cut, inline key check, write; then commit capture and its write."""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.groups import IGNORE_GROUP_PATTERN
from tidemark.operators import catalog
from tidemark.operators.checks import duplicate_offsets, guard_null_keys
from tidemark.operators.commits import capture_commits
from tidemark.operators.cut import cut
from tidemark.operators.ends import end_offsets, usable_ends
from tidemark.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, join_checked
from tidemark.operators.offset_sets import outside
from tidemark.plans.report import snapshot_report
from tidemark.schemas import ENDS, conform
from tidemark.session import materialize
from tidemark.sinks.snapshot import held_offsets, write_increment


class MissingTopicsError(ValueError):
    def __init__(self, missing: list[str]):
        super().__init__(f"topics not in the log: {', '.join(missing)}")
        self.missing = missing


class DuplicateOffsetsError(ValueError):
    pass


@dataclass
class BackupResult:
    path: str
    topics: list[str] | None
    ends: DataFrame
    messages: int = 0

    def report(self) -> DataFrame:
        """Per partition of the cut: done, not consumed or remaining (read from the snapshot)."""
        return snapshot_report(self.ends.sparkSession, self.path, self.ends, self.topics)


def check_topics(log: DataFrame, topics: Iterable[str] | None, ignore_missing_topics: bool = False
                 ) -> list[str] | None:
    """Requested topics that exist in ``log`` (a log, or its ends table); raise on
    missing ones unless told to ignore them.

    Only the requested names come back to the driver (the user's own list)."""
    if not topics:
        return None
    wanted = list(dict.fromkeys(topics))
    spark = log.sparkSession
    present = catalog.topics(catalog.select_topics(log, wanted))
    missing = sorted(r.topic for r in catalog.requested_missing(catalog.requested_frame(spark, wanted),
                                                                present).collect())
    if missing and not ignore_missing_topics:
        raise MissingTopicsError(missing)
    return [t for t in wanted if t not in set(missing)]


def after_snapshot(spark, snap: DataFrame, path: str, without_prefix: str | None = None,
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Rows of ``snap`` whose offset the snapshot at ``path`` does not hold.

    Where an increment has no gaps its range tells; offsets of increments with gaps (files of a stopped stream, transactions,
    compacted logs) are tested in their bitmaps.  Both come with the snapshot's state: no old message is read.
    Partitions the snapshot lacks pass whole."""
    ranges, sets = held_offsets(spark, path, without_prefix)
    out = snap
    if ranges is not None:
        held, n_held = materialize(ranges.select("topic", "partition", F.col("ranges").alias("_held")))
        within = F.exists("_held", lambda r: (F.col("offset") >= r["low"]) & (F.col("offset") < r["high"]))
        out = (join_checked(out, held, ["topic", "partition"], "left", max_broadcast_rows, known_rows=n_held)
               .where(~F.coalesce(within, F.lit(False))).select(*snap.columns))
    if sets is not None:
        out = outside(out, sets)
    return out


def _whole(bounds: DataFrame) -> DataFrame:
    """The ranges that a backup up to ``bounds`` completes: all it read of each partition."""
    return usable_ends(bounds).select("topic", "partition", F.coalesce("low", F.lit(0)).alias("low"), "high")


def backup(log: DataFrame, commits: DataFrame, path: str, topics: Iterable[str] | None = None,
           ends: DataFrame | None = None, ignore_missing_topics: bool = False, null_key: str = "error",
           check_unique_offsets: bool = False, ignore_group_pattern: str | None = IGNORE_GROUP_PATTERN,
           mode: str = "errorifexists", max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
           **write_options) -> BackupResult:
    """Write the messages of ``log`` below ``ends`` and the captured commits to ``path``.

    ``ends`` defaults to the log's own end offsets.  Missing topics raise
    before anything is written.  ``null_key="error"`` fails the write at the
    first message without a key.  ``check_unique_offsets`` adds one
    aggregation over (topic, partition, offset) and raises on repeats; offsets
    read from a broker are unique by construction, so it is off by default.

    ``mode="append"`` adds an increment to an existing snapshot, whether batch
    or stream wrote it: only offsets that the snapshot does not hold
    are written, so increments never repeat an offset, and the new capture
    takes the place of the old commits.  A backup that fails leaves the
    snapshot as it was; with ``overwrite`` the old one goes first."""
    wanted = list(dict.fromkeys(topics)) if topics else None
    requested = catalog.select_topics(log, wanted)
    bounds = end_offsets(requested) if ends is None else catalog.select_topics(conform(ends, ENDS), wanted)
    # one row per partition, reused by the topic check, the cut and the capture
    bounds, n_bounds = materialize(bounds)
    # the topic check reads the small ends table, not the log; still before any write
    chosen = check_topics(bounds, wanted, ignore_missing_topics)
    if chosen is None or len(chosen) == len(wanted or []):
        selected = requested
    elif chosen:
        selected = catalog.select_topics(log, chosen)
        bounds = catalog.select_topics(bounds, chosen)
    else:
        selected = log.where(F.lit(False))
        bounds = bounds.where(F.lit(False))
    snap = guard_null_keys(cut(selected, bounds, max_broadcast_rows, ends_rows=n_bounds), null_key)
    if mode == "append":
        snap = after_snapshot(log.sparkSession, snap, path, max_broadcast_rows=max_broadcast_rows)
    if check_unique_offsets and duplicate_offsets(snap).limit(1).count():
        raise DuplicateOffsetsError("the log repeats an offset within a partition")
    captured = capture_commits(commits, bounds, chosen, ignore_group_pattern)
    written = write_increment(snap, path, captured, mode, covered=_whole(bounds), **write_options)
    return BackupResult(path, chosen, bounds, written)
