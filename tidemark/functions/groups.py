"""Consumer-group name rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: groups whose name contains this (unanchored, lower-case hex
# only) are temporary consumers and are not captured
IGNORE_GROUP_PATTERN = "[a-f0-9]{8}(-[a-f0-9]{4}){4}[a-f0-9]{8}"


def is_ignored_group(group="consumer_group", pattern: str = IGNORE_GROUP_PATTERN) -> Column:
    c = F.col(group) if isinstance(group, str) else group
    return c.rlike(pattern)
