"""Reading the given tables, cutting lineage, and keeping column names apart."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared checkpoint folder and read it back: lineage is
    cut, and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# bytes of one Arrow batch: what a Python worker holds at once, whatever the length of the texts
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with this package importable on the executors, and with batches of at most
    ``BATCH_BYTES`` (lowered in the session where it allows more)."""
    spark = df.sparkSession
    ship_package(spark)
    if int(spark.conf.get(BATCH_CONF).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def shielded(docs: DataFrame, reserved: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named like ``reserved`` (in any case) moved out of
    the way, and the mapping temporary name -> original for ``restored``."""
    low = {c.lower() for c in reserved}
    moved = {f"__in_{i}": c for i, c in enumerate(docs.columns) if c.lower() in low}
    back = {c: t for t, c in moved.items()}
    return docs.toDF(*[back.get(c, c) for c in docs.columns]), moved


def restored(df: DataFrame, columns: list[str], moved: dict[str, str]) -> DataFrame:
    """The original columns, under their original names and in their order."""
    back = {c: t for t, c in moved.items()}
    return df.select(*[F.col(f"`{back.get(c, c)}`").alias(c) for c in columns])
