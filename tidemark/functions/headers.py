"""Header codec: ``array<struct<key string, value binary>>`` <-> JSON text.

Stored text is a JSON array of ``{"key": ..., "val": ...}`` objects whose
``val`` is the base64 of the header bytes, or null.  A null or empty list is
stored as NULL (so ``[]`` comes back as NULL).  Both directions stay inside
Spark's JSON expressions: ``to_json`` writes binary fields as base64 without
line breaks and ``from_json`` decodes base64 into binary.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the stored field names and the parse schema of the text form
STORED_KEY_FIELD = "key"
STORED_VALUE_FIELD = "val"
STORED_SCHEMA = "array<struct<key:string,val:string>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_headers(headers="headers") -> Column:
    """Headers column -> JSON text; NULL for null or empty lists."""
    h = _col(headers)
    as_stored = F.transform(
        h, lambda x: F.struct(x["key"].alias(STORED_KEY_FIELD), x["value"].alias(STORED_VALUE_FIELD)))
    return F.when(F.size(h) > 0, F.to_json(as_stored, {"ignoreNullFields": "false"}))


def decode_headers(text="headers_json") -> Column:
    """JSON text -> headers column; NULL text stays NULL.  Accepts any JSON
    spacing, so the spaced form older snapshots hold decodes as well.

    Text that is no such list, or a value that is no base64, fails the job."""
    text = _col(text)
    parsed = F.from_json(text, STORED_SCHEMA)

    def corrupt(what: str, kind: str) -> Column:
        return F.raise_error(F.format_string(f"corrupt headers ({what}): %s", text)).cast(kind)

    def one(x):
        value = F.when(x[STORED_VALUE_FIELD].isNotNull(),
                       F.coalesce(F.try_to_binary(x[STORED_VALUE_FIELD], F.lit("base64")), corrupt("no base64", "binary")))
        entry = F.struct(x[STORED_KEY_FIELD].alias("key"), value.alias("value"))
        return F.when(x.isNull(), corrupt("no header", "struct<key:string,value:binary>")).otherwise(entry)

    # a lone object would be taken for a list of one
    listed = F.when(text.isNotNull() & (parsed.isNull() | ~text.rlike(r"^\s*\[")), corrupt("no list", "array<struct<key:string,value:binary>>"))
    return listed.otherwise(F.transform(parsed, one))


def header_value(headers, name: str) -> Column:
    """Value of the last header of that name, or NULL."""
    found = F.filter(_col(headers), lambda x: x["key"] == name)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])


def without_header(headers, name: str) -> Column:
    """The headers without those of that name; a list that only held them becomes NULL."""
    h = _col(headers)
    left = F.filter(h, lambda x: ~x["key"].eqNullSafe(F.lit(name)))
    return F.when(F.size(left) == F.size(h), h).otherwise(F.when(F.size(left) > 0, left))
