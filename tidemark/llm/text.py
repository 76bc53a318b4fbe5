"""Vectorised text helpers for Arrow batches (NumPy inside Spark tasks).

An Arrow string column is one byte buffer plus offsets, so words, lines and
their hashes are computed for many documents at once, without a Python object
per word.  Batches are cut into blocks of about ``BLOCK_BYTES`` of text, which
bounds the memory of a task whatever the batch size; one document is never
split, so the bound is ``BLOCK_BYTES`` plus the longest document.

Hashes are polynomials over two prime fields (modulus 2**31 - 1, a base each), packed into 62 bits and mixed: over a prime,
unlike modulo 2**64, no text collides whatever the base.  The tables come from a fixed seed, so every
worker computes the same values.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_rng = np.random.default_rng(20240607)
BYTE_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASK = np.uint64(2**31 - 1)
BITS = np.uint64(31)
BASES = (1_103_515_245, 1_664_525_013)
# the two residues of each byte's number
BYTE_RESIDUES = (BYTE_TABLE & MASK, (BYTE_TABLE >> BITS) & MASK)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# fixed values: the two word patterns of the operators, as byte classes
SPACE_WORD = np.ones(256, dtype=bool)          # [^\x20\x09-\x0D]
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, dtype=bool)         # [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """A number equal to x modulo 2**31 - 1, about 31 bits shorter."""
    return (x & MASK) + (x >> BITS)


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, of any 64-bit x."""
    x = _fold(_fold(_fold(x)))
    return np.where(x >= MASK, x - MASK, x)


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**31 - 1, by doubling."""
    p = _POWERS.get(base, np.ones(1, np.uint64))
    while len(p) < n:
        p = np.concatenate([p, _residue(p * np.uint64(pow(base, len(p), 2**31 - 1)))])
    _POWERS[base] = p
    return p[:n]


def _packed(one: np.ndarray, two: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix64(((one << BITS) | two) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column with null as the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pc.fill_null(col, "") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array (from its first offset) and offsets from 0."""
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset: col.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def blocks(col: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, bytes, offsets) of consecutive rows with about ``limit`` bytes."""
    data, off = raw(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        lo = hi


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of data[starts[i]:ends[i]]; segments must not overlap and be in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.cumsum(length) - length
    inside = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    units = data[np.repeat(starts, length) + inside]
    full = length > 0
    out = []
    for table, base in zip(BYTE_RESIDUES, BASES):
        sums = np.zeros(len(starts), np.uint64)
        if full.any():
            sums[full] = np.add.reduceat(_fold(table[units] * powers(int(length.max()), base)[inside]), first[full])
        out.append(_residue(sums))
    return _packed(*out, length)


class Words:
    """Words of the documents of one block: byte spans, and the documents' first words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray = SPACE_WORD):
        self.data, self.off = data, off
        inside = table[data]
        edge = off[:-1][off[:-1] < len(data)]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[edge] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, off)      # first word of each document, then the total
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)

    def hashes(self) -> np.ndarray:
        return segment_hash(self.data, self.starts, self.ends)


def word_sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums (two rows) of ``h[i] * base**i``; with ``range_hash`` any run of words hashes in O(1)."""
    out = np.zeros((2, len(h) + 1), np.uint64)
    for row, part, base in zip(out, (h & MASK, (h >> BITS) & MASK), BASES):
        np.cumsum(_fold(part * powers(len(h), base)), out=row[1:])
    return out


def range_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mixed hash of items lo..hi-1, the same wherever the run of items stands."""
    out = []
    for row, base in zip(sums, BASES):
        inverse = powers(sums.shape[1], pow(base, -1, 2**31 - 1))
        out.append(_residue(_fold(_fold(row[hi] - row[lo])) * inverse[lo]))
    return _packed(*out, hi - lo)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values (len(x) - w + 1 of them), by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    size, cur = 1, x
    while size * 2 <= w:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    rest = w - size
    return np.minimum(cur[:n], cur[rest: rest + n]) if rest else cur[:n]


def minimizers(order: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the minimum of some ``w`` consecutive positions of one document.

    Any ``w`` consecutive positions of a document hold at least one, chosen by
    the values in that window alone (all tied minima are taken), so equal
    windows choose equal positions."""
    if len(order) < w:
        return np.zeros(0, np.int64)
    order = (order >> np.uint64(1)) + np.uint64(1)      # leaves 0 for "no window"
    valid = doc[: len(order) - w + 1] == doc[w - 1:]
    low = np.where(valid, sliding_min(order, w), np.uint64(0))
    # a position is chosen if it equals the minimum of some valid window that holds it:
    # the largest of those minima is then its own value
    pad = np.zeros(w - 1, np.uint64)
    best = ~sliding_min(~np.concatenate([pad, low, pad]), w)
    return np.flatnonzero(best == order)
