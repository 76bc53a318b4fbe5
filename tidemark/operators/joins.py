"""Joins against a side whose size is checked before it is broadcast.

A broadcast is only taken when the small side is proven to have at most
``max_rows`` rows (one bounded count); beyond that the join stays a shuffle
join, where AQE can still split skewed partitions of the big side.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# rows of a key table (topic, partition, a few longs) that we still broadcast:
# about 64 bytes a row, so the default stays near 64 MB per executor
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


def fits_broadcast(small: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> bool:
    """True when ``small`` has at most ``max_rows`` rows (reads at most max_rows + 1)."""
    return small.limit(max_rows + 1).count() <= max_rows


def join_checked(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                 max_rows: int = DEFAULT_MAX_BROADCAST_ROWS, known_rows: int | None = None) -> DataFrame:
    """``big.join(small, on, how)`` with ``small`` broadcast only if it is proven small.

    ``known_rows`` is an upper bound on ``small``'s rows that the caller
    measured (e.g. with ``session.materialize``); it replaces the count."""
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti", "semi", "anti"):
        raise ValueError(f"the checked side must be the right side of an inner/left/semi/anti join, not {how}")
    if known_rows <= max_rows if known_rows is not None else fits_broadcast(small, max_rows):
        small = F.broadcast(small)
    return big.join(small, list(on), how)
