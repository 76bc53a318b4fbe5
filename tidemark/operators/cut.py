"""Point-in-time cut of a log and the consumption report."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ends import last_offset, usable_ends
from tidemark.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, join_checked
from tidemark.session import materialize

KEY = ["topic", "partition"]

# fixed values: consumption status labels
DONE = "done"
NOT_CONSUMED = "not_consumed"
REMAINING = "remaining"


def cut(log: DataFrame, ends: DataFrame, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
        ends_rows: int | None = None) -> DataFrame:
    """Messages below the end snapshot: ``offset < high`` on partitions that have an end.

    Records past the cut and partitions unknown to ``ends`` are left out; they
    belong to the next increment.  ``ends`` has one row per partition, so it is
    broadcast when its checked row count allows, else joined by shuffle.  The
    bounds are materialised first, so ends derived from the log itself are
    computed once, not once for the size check and again for the join; a
    caller that already materialised ``ends`` passes its row count as
    ``ends_rows`` and nothing is recomputed."""
    bounds = usable_ends(ends).select(*KEY, F.col("high").alias("_high"))
    if ends_rows is None:
        bounds, ends_rows = materialize(bounds)
    return (join_checked(log, bounds, KEY, "inner", max_broadcast_rows, known_rows=ends_rows)
            .where(F.col("offset") < F.col("_high"))
            .select(*log.columns))


def consumption_report(ends: DataFrame, consumed: DataFrame) -> DataFrame:
    """Per partition of ``ends``: last offset read and what is left.

    status ``done`` when the last message before the cut was read,
    ``not_consumed`` when nothing was read, else ``remaining`` with the
    number of offsets still to read (end - last read)."""
    last = consumed.groupBy(*KEY).agg(F.max("offset").alias("last_read"))
    end = last_offset("high")
    report = usable_ends(ends).join(last, KEY, "left")
    status = (F.when(F.col("last_read").isNull(), F.lit(NOT_CONSUMED))
              .when(F.col("last_read") >= end, F.lit(DONE))
              .otherwise(F.lit(REMAINING)))
    remaining = (F.when(F.col("last_read").isNull(), F.lit(None).cast("long"))
                 .otherwise(F.greatest(end - F.col("last_read"), F.lit(0)).cast("long")))
    return report.select(*KEY, "low", "high", "last_read", status.alias("status"), remaining.alias("remaining"))


def consumption_complete(report: DataFrame) -> DataFrame:
    """One row: complete (every partition with data done; true when there is none)."""
    done = F.col("status") == F.lit(DONE)
    return report.agg(
        F.coalesce(F.bool_and(done), F.lit(True)).alias("complete"),
        F.count(F.lit(1)).alias("partitions"),
        F.count_if(done).alias("done_partitions"))
