"""Spark schemas shared by every operator.

A *log* is any DataFrame in the ``LOG`` layout (the Kafka source's columns
minus ``timestampType``), *ends* bound each partition of a log, and
*commits* hold the next offset each consumer group will read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

HEADER = T.StructType([
    T.StructField("key", T.StringType(), True),
    T.StructField("value", T.BinaryType(), True),
])
HEADERS = T.ArrayType(HEADER, True)

LOG = T.StructType([
    T.StructField("topic", T.StringType(), True),
    T.StructField("partition", T.IntegerType(), True),
    T.StructField("offset", T.LongType(), True),
    T.StructField("key", T.BinaryType(), True),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("headers", HEADERS, True),
])

# high is exclusive: the partition holds offsets in [low, high)
ENDS = T.StructType([
    T.StructField("topic", T.StringType(), True),
    T.StructField("partition", T.IntegerType(), True),
    T.StructField("low", T.LongType(), True),
    T.StructField("high", T.LongType(), True),
])

# ``committed`` is the next offset to read (last consumed + 1)
COMMITS = T.StructType([
    T.StructField("consumer_group", T.StringType(), True),
    T.StructField("topic", T.StringType(), True),
    T.StructField("partition", T.IntegerType(), True),
    T.StructField("committed", T.LongType(), True),
])

PARTITION_KEY = ["topic", "partition"]


def require_columns(df: DataFrame, schema: T.StructType, what: str = "input") -> None:
    """Fail early, with the missing names, when ``df`` lacks columns of ``schema``."""
    have = set(df.columns)
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; has {sorted(have)}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: same order, names and types."""
    require_columns(df, schema)
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
