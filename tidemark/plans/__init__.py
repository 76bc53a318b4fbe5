"""End-to-end jobs: backup, restore plan, publication frames."""
from tidemark.plans.backup import BackupResult, MissingTopicsError, backup, check_topics
from tidemark.plans.publish import commit_triples, delivery_report, publish_frame, publish_waves, starting_offsets, wave_plan
from tidemark.plans.report import snapshot_complete, snapshot_missing, snapshot_report
from tidemark.plans.restore import TargetMismatchError, UndeliveredError, restore, restore_plan, target_mismatches
from tidemark.plans.target import delivered, translate_to_target, undelivered

__all__ = ["BackupResult", "MissingTopicsError", "TargetMismatchError", "backup", "check_topics", "commit_triples",
           "delivery_report", "publish_frame", "publish_waves", "starting_offsets", "restore", "restore_plan",
           "snapshot_complete", "snapshot_missing", "snapshot_report", "target_mismatches", "UndeliveredError", "delivered",
           "translate_to_target", "undelivered", "wave_plan"]
