"""tidemark: point-in-time snapshots of partitioned message logs on Spark.

A log is a DataFrame in the ``LOG`` layout (topic, partition, offset, key,
value, timestamp, headers).  The library cuts it at an end-offset snapshot,
reports what was consumed, checks its constraints, writes it as a parquet
snapshot (in full or in streaming increments), and builds the restore:
messages with the offsets they get in the new topic, and for every consumer
group the offset at which it continues.
"""
from tidemark.schemas import COMMITS, ENDS, LOG

__all__ = ["COMMITS", "ENDS", "LOG", "backup", "restore_plan", "publish_frame", "starting_offsets",
           "incremental_backup", "translate_offsets", "with_target_offsets", "cut", "end_offsets"]


def __getattr__(name):
    # the job-level API, imported on first use
    if name in ("backup", "restore_plan", "publish_frame", "starting_offsets"):
        from tidemark import plans
        return getattr(plans, name)
    if name == "incremental_backup":
        from tidemark.streaming import incremental_backup
        return incremental_backup
    if name in ("translate_offsets", "with_target_offsets", "cut", "end_offsets"):
        from tidemark import operators
        return getattr(operators, name)
    raise AttributeError(name)
