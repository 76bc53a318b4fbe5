"""Content-chosen anchors: what the two exact repeat operators share.

A window is ``length`` consecutive units (words or bytes) of one document.  Its anchor
is the position, among its first ``reach`` positions, whose gram of ``gram`` units has the
smallest hash (the leftmost of equals).  The choice looks at the window alone, so equal
windows have their anchor at the same place, and the windows of a document that share an
anchor start at consecutive places.  One row an anchor, about two for every ``reach``
units, therefore stands for all windows.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import written
from tidemark.llm.text import sliding_min

# of a packed place: window starts before it, then 12 bits each for their number - 1 and the anchor's offset from the first
SHIFT = 12


def window_anchors(order: np.ndarray, first: np.ndarray, length: int, reach: int):
    """(document, anchor, first start, last start) of every anchor of a block.

    ``order`` has a hash for each unit's gram (of which only the top half counts), ``first`` the
    first unit of each document and the total."""
    n = len(order)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    low = sliding_min((order & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64), reach)[: n - length + 1]
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.searchsorted(first, start, side="right") - 1
    valid = start + length <= first[1:][doc]
    start, anchor, doc = start[valid], anchor[valid], doc[valid]
    if not len(start):
        return none, none, none, none
    # equal anchors are neighbours: an anchor lies in one document, and the choice never moves left
    opens = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    closes = np.append(opens[1:], len(anchor)) - 1
    return doc[opens], anchor[opens], start[opens], start[closes]


def pack(start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """One number that orders by start: start of the first window, number of windows, the anchor's offset."""
    return (start << (2 * SHIFT)) | ((count - 1) << SHIFT) | offset


def unpack(place):
    """(start, count, offset), of arrays or columns' values."""
    mask = (1 << SHIFT) - 1
    return place >> (2 * SHIFT), ((place >> SHIFT) & mask) + 1, place & mask


def start_of(place) -> F.Column:
    return F.shiftright(place, 2 * SHIFT)


def count_of(place) -> F.Column:
    return F.shiftright(place, SHIFT).bitwiseAND(F.lit((1 << SHIFT) - 1)) + 1


def identified(docs: DataFrame) -> DataFrame:
    """(d, doc_id, text): ``d`` is doc_id where ids are unique and not null.

    Else the rows are written once with new numbers in the order of (doc_id, text), null ids
    last: repeated rows are documents of their own, and the later of two equal rows is the copy."""
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    text = docs.select("doc_id", "text")
    if not odd:
        return text.select(F.col("doc_id").cast("bigint").alias("d"), "doc_id", "text")
    ordered = text.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("d", F.monotonically_increasing_id())
    return written(ordered.select("d", "doc_id", "text"), "identified")
