"""Column expressions (JVM-side, codegen friendly) used by the operators."""
from tidemark.functions.headers import decode_headers, encode_headers
from tidemark.functions.groups import IGNORE_GROUP_PATTERN, is_ignored_group
from tidemark.functions.time import epoch_millis, ntz_to_instant

__all__ = [
    "decode_headers", "encode_headers", "IGNORE_GROUP_PATTERN", "is_ignored_group",
    "epoch_millis", "ntz_to_instant",
]
