"""Small builders for fixtures."""
from __future__ import annotations

import datetime as dt

from tidemark.schemas import COMMITS, LOG

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def ms(value: int) -> dt.datetime:
    return EPOCH + dt.timedelta(milliseconds=value)


def log_df(spark, rows):
    """rows: (topic, partition, offset, key, value, timestamp_ms, headers)"""
    data = [(t, p, o, None if k is None else (k.encode() if isinstance(k, str) else k),
             None if v is None else (v.encode() if isinstance(v, str) else v),
             None if ts is None else ms(ts), h) for t, p, o, k, v, ts, h in rows]
    return spark.createDataFrame(data, LOG)


def messages(spark, topic, partition, offsets, ts=1_600_000_000_123):
    return log_df(spark, [(topic, partition, o, f"k-{topic}-{i}", f"payload {i}", ts, None) for i, o in enumerate(offsets)])


def commits_df(spark, rows):
    return spark.createDataFrame(rows, COMMITS)
