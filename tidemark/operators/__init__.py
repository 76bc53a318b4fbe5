"""DataFrame operators over logs, ends and commits."""
from tidemark.operators.buckets import DEFAULT_BUCKET_SPAN
from tidemark.operators.catalog import (partitions, requested_frame, requested_missing, requested_present,
                                        select_topics, topics)
from tidemark.operators.checks import (duplicate_offsets, guard_null_keys, latest_per_offset, null_keys,
                                       null_topic_commits)
from tidemark.operators.commits import (NO_OFFSET, capture_commits, commit_counts, consumer_groups,
                                       group_commits, union_commits)
from tidemark.operators.counts import partition_counts, totals
from tidemark.operators.cut import consumption_complete, consumption_report, cut
from tidemark.operators.ends import end_offsets, last_offset, usable_ends
from tidemark.operators.joins import join_checked
from tidemark.operators.positions import with_target_offsets
from tidemark.operators.translate import translate_offsets

__all__ = [
    "DEFAULT_BUCKET_SPAN", "partitions", "requested_frame", "requested_missing", "requested_present",
    "select_topics", "topics", "duplicate_offsets", "guard_null_keys", "latest_per_offset", "null_keys",
    "null_topic_commits", "NO_OFFSET", "capture_commits", "commit_counts", "consumer_groups", "group_commits", "union_commits",
    "partition_counts", "totals", "consumption_complete", "consumption_report", "cut", "end_offsets",
    "last_offset", "usable_ends", "join_checked", "with_target_offsets", "translate_offsets",
]
