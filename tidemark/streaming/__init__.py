"""Structured Streaming jobs: incremental backup, audit of offsets."""
from tidemark.streaming.audit import offset_audit, repeats_of, run_audit, seen_sets
from tidemark.streaming.incremental import IncrementResult, incremental_backup

__all__ = ["IncrementResult", "incremental_backup", "offset_audit", "repeats_of", "run_audit", "seen_sets"]
