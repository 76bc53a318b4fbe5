"""Session helpers: a local session for tests and the bench, and the shared
scratch folder (``spark.checkpoint.dir``) that outputs and checkpoints use."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# settings we run with on a large cluster (tens of TB of log): AQE re-plans
# joins from measured sizes, merges small shuffle partitions and splits
# skewed ones; shuffle partitions sized so one holds ~256 MB at the largest
# stage (raise spark.sql.shuffle.partitions with the data, e.g. 100 TB of
# payload shuffled once ~ 400k partitions, or let AQE coalesce from a high
# start); scan splits of 256 MB keep the task count manageable.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.worker.reuse": "true",
}
# Materialised small sides are checkpoints.  spark.cleaner.referenceTracking.
# cleanCheckpoints would delete them once unreferenced, but in a long session
# it doubled our bench time (deletes run on the cleaner thread); leave the
# checkpoint folder to the cluster's retention policy instead.


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in CLUSTER_CONF.items():
        if k != "spark.sql.adaptive.advisoryPartitionSizeInBytes":
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, if any."""
    sc = spark.sparkContext
    value = sc.getConf().get(CHECKPOINT_CONF, None)
    if not value:
        try:
            value = spark.conf.get(CHECKPOINT_CONF, None)
        except Exception:  # pragma: no cover - conf lookups differ by deployment
            value = None
    if not value:
        value = sc.getCheckpointDir()
    return value or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only when none is set.

    A folder of our own is only made for local masters (tests, the bench); on a
    cluster an unset ``spark.checkpoint.dir`` is an error, because a
    machine-local folder is not visible to the other executors."""
    root = checkpoint_root(spark)
    sc = spark.sparkContext
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before running on a cluster")
        root = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root.rstrip("/"), "tidemark", f"{name}-{uuid.uuid4().hex[:12]}")


def observed_count(obs, name: str) -> int | None:
    """The count an ``Observation`` collected, or None where it brought none: never a made-up number."""
    try:
        value = obs.get.get(name)
    except Exception:  # the metrics of a job that ran can still be lost
        return None
    return None if value is None else int(value)


def materialize(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written once in the shared checkpoint folder (it survives executor loss), and its row count.

    The count is observed in the same job; where that brings none, the checkpoint is counted."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    ensure_checkpoint_dir(df.sparkSession)
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    out = df.observe(obs, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    n = observed_count(obs, "n")
    return out, out.count() if n is None else n


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tidemark`` importable in Python workers (once per application).

    Python data sources and grouped-map functions are unpickled in executor
    processes, which import this package; ``addPyFile`` distributes a zip of
    it through Spark's own file server."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package_dir = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-pyfiles-"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(package_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(package_dir)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
