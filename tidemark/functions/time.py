"""Time conversions that do not depend on the session time zone."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz_to_instant(ts) -> Column:
    """TIMESTAMP_NTZ wall clock read as UTC -> TIMESTAMP (an instant).

    ``CAST(ntz AS TIMESTAMP)`` would read the wall clock in the session time
    zone; the micro-second difference from the NTZ epoch does not."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, _col(ts)))


def epoch_millis(ts="timestamp") -> Column:
    """TIMESTAMP -> epoch milliseconds (floor), the unit message logs carry."""
    return F.unix_millis(_col(ts))
