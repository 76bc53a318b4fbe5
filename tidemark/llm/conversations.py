"""Conversation structure repair (11): cheapest edits, least audit by prefix-doubling path ranking.

A conversation's roles should read (s?(ua)+)? by their initials.  Rows may be kept (cost 0), reroled to user or
assistant (2), deleted (3, required for blank rows and for repeats of an earlier role and text), and rows of
either role without text may be inserted anywhere (2); a truncated row that is not deleted adds 1.

Method.  A node is a place between two rows and what the roles so far read as; arcs are the edits.  A backward dynamic
program over the places gives each node's cheapest cost, which leaves the optimal arcs.  What a letter leads to is
settled by the node (a rerole or an insertion writes the one role that may follow), so the audits that
leave a node differ in some letter: ranks by the first letter, then by the first 2, 4, 8 ... letters (rank of the
node, rank of the node that its doubled pointer reaches) order all nodes by their least audit; each node goes
along the optimal arc of the least letter and rank; and the doubled pointers read the paths out, all steps at once.

At scale.  Rows are range-partitioned by (conversation, turn, role, hash of the text, a salt), so a conversation with a third of
all rows, or a third of all rows alike, spreads over many tasks; each task packs its sorted rows into pieces of one
conversation with at most ``PIECE_ROWS`` rows, written once.  Conversations of one piece are settled in the task.
For the others, first occurrences are an aggregation by (conversation, role, hash); each piece becomes a matrix of
cheapest costs between the four states; a scan over the matrices of a conversation, last piece first, gives the costs behind each
piece, and one over the pieces' state maps gives where each is entered.  Both scans stream one short row a piece
and hold four numbers, so no conversation is ever gathered.

Defined results.  Null roles and texts count as one space.  Rows are ordered by turn (nulls first), role and SHA-256 of the
text; alike rows follow each other.  An empty role has no initial: it cannot be kept.  A null conv_id is a conversation of
its own; repeated rows are duplicates.  Other columns are ignored.  Empty table: empty result.
"""
from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import map_arrow, table, written

PIECE_ROWS = 4096
PIECE_BYTES = 4 << 20

# fixed values: costs, letters in ASCII order, states (nothing yet, s, u, a) and the role that follows each
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)       # 0: the end
NEXT = (2, 2, 3, 2)                                # state after the only role that may be written
WRITTEN = ("user", "user", "assistant", "user")    # that role, by the state it is written in
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
END = (0, None, None, 0)                           # cost at the end: (s?(ua)+)? must be complete
FAR = 1 << 40
OK, CUT_OFF, GONE = 0, 1, 2                        # a row's fate: fine, truncated, to be deleted
INITIALS = "sua"
LEGAL = ("su", "ua", "au")
BLANK_TEXT = " \t\n\x0b\x0c\r"
# one byte a row: initial (0-3), + 4 where truncated, 8 where blank, 16 where a duplicate
CUT_BIT, BLANK_BIT, DUPLICATE_BIT = 4, 8, 16


@functools.lru_cache(None)
def arcs(initial: int, fate: int) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """For each state the row's own edits: (letter, cost, next state). ``initial`` is 0-2 for s, u, a, else 3."""
    more = TRUNCATED if fate == CUT_OFF else 0
    out = []
    for state in range(4):
        here = [(1, DELETE, state)]
        if fate != GONE:
            kept = KEPT.get((INITIALS[initial] if initial < 3 else "", state))
            if kept is not None:
                here.append((3, more, kept))
            here.append((4, REROLE + more, NEXT[state]))
        out.append(tuple(here))
    return tuple(out)


@functools.lru_cache(1 << 16)
def step(initial: int, fate: int, behind: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those behind it, both less their minimum, and that minimum before the row."""
    costs = with_inserts(tuple(min(c + behind[t] for _, c, t in here) for here in arcs(initial, fate)))
    low = min(costs)
    return tuple(c - low if c < FAR // 2 else FAR for c in costs), low


def with_inserts(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs when rows may be inserted first: at most two, as three come back to where two began."""
    once = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(min(c, INSERT + once[NEXT[s]]) for s, c in enumerate(once))


def end_costs() -> tuple[int, ...]:
    return with_inserts(tuple(FAR if c is None else c for c in END))


def cost_table(initial: np.ndarray, fate: np.ndarray, behind: tuple[int, ...]) -> np.ndarray:
    """Costs of the four states at the n + 1 places of n rows, given those behind the last."""
    n = len(initial)
    shape, low = [None] * (n + 1), np.zeros(n + 1, np.int64)
    base = min(behind)
    now = tuple(c - base if c < FAR // 2 else FAR for c in behind)
    shape[n], low[n] = now, base
    rows = list(zip(initial.tolist(), fate.tolist()))
    for i in range(n - 1, -1, -1):
        now, less = step(*rows[i], now)
        shape[i], low[i] = now, less
    return np.array(shape, np.int64) + np.cumsum(low[::-1])[::-1][:, None]


def matrix(initial: np.ndarray, fate: np.ndarray) -> list[int]:
    """Cheapest costs from each state before the rows to each state behind them, row by row; no insertion behind the last."""
    out = np.full((4, 4), FAR, np.int64)
    for t in range(4):
        out[:, t] = cost_table(initial, fate, tuple(0 if s == t else FAR for s in range(4)))[0]
    return np.minimum(out, FAR).ravel().tolist()


class Paths:
    """Least cheapest audits of several conversations (or pieces of one) at once.

    ``parts`` holds (initials, fates, costs behind the rows, last) for each; without ``last`` the rows of another piece follow
    and a path ends behind the last row, else insertions may follow it."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, tuple[int, ...], bool]]):
        tables = [cost_table(i, f, c) for i, f, c, _ in parts]
        places = np.array([len(t) for t in tables])
        self.first = np.cumsum(places) - places             # first place of each part
        cost = np.concatenate(tables).ravel()
        nodes = len(cost)
        node = np.arange(nodes)
        state, place = node & 3, node >> 2
        initial, fate = np.full(nodes >> 2, 3), np.full(nodes >> 2, GONE)
        ends = np.zeros(nodes >> 2, bool)
        ends[self.first + places - 1] = True
        last = np.zeros(nodes >> 2, bool)
        last[(self.first + places - 1)[[p[3] for p in parts]]] = True
        rows = ~ends
        initial[rows] = np.concatenate([p[0] for p in parts])
        fate[rows] = np.concatenate([p[1] for p in parts])
        self.cost = cost
        # the arcs of each letter: target and cost; FAR where there is none
        steps = {}
        following = np.array(NEXT)[state]
        row_here, more = rows[place], np.where(fate[place] == CUT_OFF, TRUNCATED, 0)
        steps[1] = (node + 4, np.where(row_here, DELETE, FAR))
        steps[2] = (node - state + following, np.where(row_here | last[place], INSERT, FAR))
        kept = np.full((4, 4), -1)
        for (c, s), t in KEPT.items():
            kept[INITIALS.index(c), s] = t
        after = kept[initial[place], state]
        may = row_here & (fate[place] != GONE)
        steps[3] = (node + 4 - state + after, np.where(may & (after >= 0), more, FAR))
        steps[4] = (node + 4 - state + following, np.where(may, REROLE + more, FAR))
        # optimal arcs; a finished path (the end, or the place behind a piece) has none
        done = np.where(last[place], (cost == 0) & ((state == 0) | (state == 3)), ends[place])
        optimal = {}
        for letter, (to, price) in steps.items():
            to = np.clip(to, 0, nodes - 1)
            optimal[letter] = (to, ~done & (price < FAR) & (price + cost[to] == cost) & (cost < FAR))
        # ranks by 1, 2, 4, ... letters along the arc of the least letter
        rank, pointer = np.zeros(nodes, np.int64), node.copy()
        for letter in sorted(optimal, reverse=True):
            to, ok = optimal[letter]
            rank[ok], pointer[ok] = letter, to[ok]
        self.letter = rank.copy()
        self.pointers = [pointer]
        while True:
            pair = rank * (int(rank.max()) + 1) + rank[pointer]
            _, rank_next = np.unique(pair, return_inverse=True)
            further = pointer[pointer]
            if np.array_equal(further, pointer):
                break
            rank, pointer = rank_next, further
            self.pointers.append(pointer)
        self.rank = rank
        # among a node's optimal arcs the least (letter, rank behind it)
        best = np.full(nodes, np.iinfo(np.int64).max)
        top = int(rank.max()) + 1
        chosen = node.copy()
        for letter, (to, ok) in optimal.items():
            key = np.where(ok, letter * top + rank[to], best)
            better = key < best
            chosen[better], best[better] = to[better], key[better]
        if not np.array_equal(chosen, self.pointers[0]):
            raise AssertionError("a letter leads to two nodes")
        self.steps = np.where(self.letter > 0, 1, 0)        # letters to the end of the path
        for p in self.pointers:
            self.steps = self.steps + self.steps[p]

    def start(self, part: int, state: int) -> int:
        return int(self.first[part]) * 4 + state

    def walk(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All nodes of the paths from ``starts`` one after another, where each path begins, and the nodes they end in."""
        length = self.steps[starts]
        begin = np.append(0, np.cumsum(length))
        t = np.arange(begin[-1]) - np.repeat(begin[:-1], length)
        now, end = np.repeat(starts, length), starts.copy()
        for k, pointer in enumerate(self.pointers):
            now = np.where(t >> k & 1, pointer[now], now)
            end = np.where(length >> k & 1, pointer[end], end)
        return now, begin, end


def row_codes(roles: pa.Array, texts: pa.Array) -> np.ndarray:
    """One byte a row; duplicates are not known yet."""
    first = pc.utf8_slice_codeunits(roles, 0, 1)
    code = np.full(len(roles), 3, np.uint8)
    for k, c in enumerate(INITIALS):
        code[pc.equal(first, c).to_numpy(zero_copy_only=False)] = k
    trimmed = pc.utf8_rtrim(texts, BLANK_TEXT)
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    ended = pc.match_substring_regex(trimmed, r"[.!?]\z").to_numpy(zero_copy_only=False)
    return code + np.where(blank, BLANK_BIT, np.where(ended, 0, CUT_BIT)).astype(np.uint8)


def split_codes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Initials and fates."""
    gone = (code & (BLANK_BIT | DUPLICATE_BIT)) > 0
    return (code & 3).astype(np.int64), np.where(gone, GONE, np.where(code & CUT_BIT, CUT_OFF, OK))


def mark_duplicates(code: np.ndarray, duplicate: np.ndarray) -> np.ndarray:
    """The first fault counts: blank, duplicate, truncated."""
    late = duplicate & ((code & BLANK_BIT) == 0)
    return np.where(late, (code & 3) | DUPLICATE_BIT, code).astype(np.uint8)


def packed(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pieces of conversations in order: conv_id, piece, whole (the conversation has no other piece), turn_first, turn_last (null
    without turns), turns (distinct ones), codes, roles, texts.  Written once."""
    if not 1 <= piece_rows <= PIECE_ROWS:
        raise ValueError(f"piece_rows must be between 1 and {PIECE_ROWS}")
    keyed = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("salt", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "digest", "salt"]           # alike rows may be dealt to several tasks
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest", "salt")

    def run(batches):
        from pyspark import TaskContext

        part, seq, first = TaskContext.get().partitionId(), 0, True
        held = None

        def emit(block, cuts, whole):
            nonlocal seq
            n = len(cuts) - 1
            turn = block.column(1)
            numbers = pc.fill_null(turn, 0).to_numpy(zero_copy_only=False)
            known = pc.is_valid(turn).to_numpy(zero_copy_only=False)
            low, high, distinct = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                some = numbers[lo:hi][known[lo:hi]]
                low.append(int(some[0]) if len(some) else None)
                high.append(int(some[-1]) if len(some) else None)
                distinct.append(int(1 + (some[1:] != some[:-1]).sum()) if len(some) else 0)
            roles, texts = block.column(2), block.column(3)
            codes = row_codes(roles, texts).tobytes()
            at = pa.array(cuts, pa.int32())
            out = pa.RecordBatch.from_arrays(
                [block.column(0).take(pa.array(cuts[:-1])), pa.array([part << 31 | seq + i for i in range(n)], pa.int64()), pa.array(whole),
                 pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(distinct, pa.int64()),
                 pa.array([codes[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])], pa.binary()),
                 pa.ListArray.from_arrays(at, roles), pa.ListArray.from_arrays(at, texts)],
                ["conv_id", "piece", "whole", "turn_first", "turn_last", "turns", "codes", "roles", "texts"])
            seq += n
            return out

        for batch in batches:
            block = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            ids = block.column(0).to_pylist()
            size = np.cumsum(pc.binary_length(block.column(3)).to_numpy(zero_copy_only=False).astype(np.int64))
            edges = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            cuts, whole, keep = [0], [], 0
            for lo, hi in zip(edges[:-1], edges[1:]):
                pieces = _piece_ends(lo, hi, size, piece_rows)
                if hi == len(ids):          # it may go on in the next batch: its last piece waits
                    pieces = pieces[:-1]
                cuts += pieces
                whole += [len(pieces) == 1 and not first and hi < len(ids)] * len(pieces)
                first = first and hi == len(ids)
                keep = pieces[-1] if pieces else keep
            split_tail = len(edges) > 1 and keep > edges[-2]        # the waiting piece has earlier ones
            first = first or split_tail
            if len(cuts) > 1:
                yield emit(block, cuts, whole)
            held = block.slice(keep)
        if held is not None and held.num_rows:
            yield emit(held, [0, held.num_rows], [False])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return written(map_arrow(dealt, run, f"conv_id {kind}, piece bigint, whole boolean, turn_first bigint, turn_last bigint, turns bigint, "
                                         "codes binary, roles array<string>, texts array<string>"), "conversation-pieces")


def _piece_ends(lo: int, hi: int, size: np.ndarray, rows: int) -> list[int]:
    """Ends of the pieces of the rows lo..hi: at most ``rows`` rows, and about ``PIECE_BYTES`` of text."""
    out = []
    while lo < hi:
        before = size[lo - 1] if lo else 0
        by_size = int(np.searchsorted(size, before + PIECE_BYTES, side="right"))
        lo = min(hi, lo + rows, max(by_size, lo + 1))
        out.append(lo)
    return out


# a piece's repaired rows and what the report sums up
REPAIRED = ("piece bigint, whole boolean, turn_first bigint, turn_last bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, "
            "illegal bigint, initial_first string, initial_last string, cost bigint, audit string, repaired array<struct<role string, text string>>")


def _mended(parts: list[dict], paths: Paths, states: list[int]) -> list[dict]:
    """The pieces' repaired rows along the paths from their states."""
    starts = np.array([paths.start(k, s) for k, s in enumerate(states)])
    nodes, begin, ends = paths.walk(starts)
    letters = LETTERS[paths.letter[nodes]].tobytes().decode()
    place, state = (nodes >> 2).tolist(), (nodes & 3).tolist()
    out = []
    for k, p in enumerate(parts):
        lo, hi, zero = int(begin[k]), int(begin[k + 1]), int(paths.first[k])
        rows = []
        for letter, i, s in zip(letters[lo:hi], place[lo:hi], state[lo:hi]):
            if letter == "K":
                rows.append({"role": p["roles"][i - zero], "text": p["texts"][i - zero]})
            elif letter == "R":
                rows.append({"role": WRITTEN[s], "text": p["texts"][i - zero]})
            elif letter == "I":
                rows.append({"role": WRITTEN[s], "text": ""})
        code = p["code"]
        initials = [r[:1] for r in p["roles"]]
        out.append({**{c: p[c] for c in ("conv_id", "piece", "whole", "turn_first", "turn_last", "turns")},
                    "blank": int((code & BLANK_BIT > 0).sum()), "duplicate": int((code & DUPLICATE_BIT > 0).sum()),
                    "truncated": int((code & CUT_BIT > 0).sum()),
                    "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                    "initial_first": initials[0], "initial_last": initials[-1],
                    "cost": int(paths.cost[starts[k]] - paths.cost[ends[k]]), "audit": letters[lo:hi], "repaired": rows})
    return out


def _repaired_schema(kind: str) -> pa.Schema:
    text, long = pa.string(), pa.int64()
    return pa.schema([("conv_id", kind), ("piece", long), ("whole", pa.bool_()), *[(c, long) for c in ("turn_first", "turn_last", "turns", "blank",
                      "duplicate", "truncated", "illegal")], ("initial_first", text), ("initial_last", text), ("cost", long), ("audit", text),
                      ("repaired", pa.list_(pa.struct([("role", text), ("text", text)])))])


def _groups(batch: pa.RecordBatch, rows: int = 1 << 14):
    """Rows of ``batch`` as dictionaries, in runs of about ``rows`` rows of conversations."""
    some, n = [], 0
    for i in range(batch.num_rows):
        p = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
        some.append(p)
        n += len(p["codes"])
        if n >= rows:
            yield some
            some, n = [], 0
    if some:
        yield some


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``REPAIRED`` for each piece of the conversations in ``rows`` (conv_id, turn, role, text); a conversation's
    pieces in the order of ``piece`` are its repaired rows and its audit."""
    pieces = packed(rows, piece_rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {REPAIRED}"

    def settle(batches):
        for batch in batches:
            shape = _repaired_schema(batch.schema.field("conv_id").type)
            for parts in _groups(batch):
                for p in parts:
                    seen, duplicate = set(), np.zeros(len(p["codes"]), bool)
                    for i, row in enumerate(zip(p["roles"], p["texts"])):
                        duplicate[i] = row in seen
                        seen.add(row)
                    p["code"] = mark_duplicates(np.frombuffer(p["codes"], np.uint8), duplicate)
                paths = Paths([(*split_codes(p["code"]), end_costs(), True) for p in parts])
                yield pa.RecordBatch.from_pylist(_mended(parts, paths, [0] * len(parts)), shape)

    def settle_split(batches):
        for batch in batches:
            shape = _repaired_schema(batch.schema.field("conv_id").type)
            for parts in _groups(batch):
                for p in parts:
                    p["code"] = np.frombuffer(p["codes"], np.uint8)
                paths = Paths([(*split_codes(p["code"]), tuple(p["behind"]), p["last"]) for p in parts])
                yield pa.RecordBatch.from_pylist(_mended(parts, paths, [p["entered"] for p in parts]), shape)

    alone = map_arrow(pieces.where("whole"), settle, schema)
    split = pieces.where("NOT whole")
    fates = _fates(split)
    known = split.drop("codes").join(_entered(fates), "piece")
    return alone.unionByName(map_arrow(known, settle_split, schema))


def _fates(split: DataFrame) -> DataFrame:
    """conv_id, piece, codes of the pieces of split conversations with their duplicates marked, and their cost matrix."""
    each = split.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "row"))
    place = F.col("piece") * PIECE_ROWS + F.col("i")
    first = (each.groupBy("conv_id", F.col("row.roles").alias("role"), F.sha2("row.texts", 256).alias("digest"))
             .agg(F.min(place).alias("place")))
    firsts = (first.groupBy(F.floor(F.col("place") / PIECE_ROWS).alias("piece"))
              .agg(F.collect_list((F.col("place") % PIECE_ROWS).cast("int")).alias("firsts")))       # at most PIECE_ROWS
    joined = split.select("conv_id", "piece", "codes").join(firsts, "piece", "left").select("conv_id", "piece", "codes", "firsts")

    def run(batches):
        for batch in batches:
            codes, out = [], []
            for code, firsts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                code = np.frombuffer(code, np.uint8)
                duplicate = np.ones(len(code), bool)
                duplicate[firsts or []] = False
                code = mark_duplicates(code, duplicate)
                codes.append(code.tobytes())
                out.append(matrix(*split_codes(code)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary()), pa.array(out, pa.list_(pa.int64()))],
                                             ["conv_id", "piece", "codes", "matrix"])

    kind = split.schema["conv_id"].dataType.simpleString()
    return written(map_arrow(joined, run, f"conv_id {kind}, piece bigint, codes binary, matrix array<bigint>"), "conversation-fates")


def _entered(fates: DataFrame) -> DataFrame:
    """piece, codes, behind (costs behind it), last, entered (the state in which the least path enters it)."""
    kind = fates.schema["conv_id"].dataType.simpleString()
    backward = fates.select("conv_id", "piece", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece"))

    def costs(batches):
        conv, behind = _NOTHING, None
        for batch in batches:
            ids, out, last = batch.column(0).to_pylist(), [], []
            for c, m in zip(ids, batch.column(2).to_pylist()):
                new = conv is _NOTHING or c != conv
                if new:
                    conv, behind = c, end_costs()
                out.append(list(behind))
                last.append(new)
                behind = [min(m[4 * s + t] + behind[t] for t in range(4)) for s in range(4)]
                behind = [b - min(behind) for b in behind]      # only differences matter
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(last)], ["piece", "behind", "last"])

    ends = map_arrow(backward, costs, "piece bigint, behind array<bigint>, last boolean")
    known = written(fates.drop("matrix").join(ends, "piece"), "conversation-costs").select("conv_id", "piece", "codes", "behind", "last")

    def exits(batches):
        for batch in batches:
            out = []
            for code, behind, last in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                paths = Paths([(*split_codes(np.frombuffer(code, np.uint8)), tuple(behind), last)])
                out.append((paths.walk(np.arange(4))[2] & 3).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["conv_id", "piece", "exits"])

    forward = map_arrow(known, exits, f"conv_id {kind}, piece bigint, exits array<int>").repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def states(batches):
        conv, state = _NOTHING, 0
        for batch in batches:
            out = []
            for c, to in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if conv is _NOTHING or c != conv:
                    conv, state = c, 0
                out.append(state)
                state = to[state]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.int32())], ["piece", "entered"])

    return known.drop("conv_id").join(map_arrow(forward, states, "piece bigint, entered int"), "piece")


_NOTHING = object()


def messages(repaired: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, piece, place in the piece, role, text."""
    return repaired.select("conv_id", "piece", F.posexplode("repaired").alias("place", "row")).select("conv_id", "piece", "place", "row.role", "row.text")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(repaired: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (bigint), audit and repaired_sha256 of each conversation."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    line = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    gaps = F.coalesce(F.col("turn_last") - F.col("turn_first") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    alone = repaired.where("whole").select("conv_id", gaps.alias("gaps"), *COUNTS[1:], "audit",
                                           F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
    rest = (repaired.where("NOT whole")
            .select("conv_id", "piece", "turn_first", "turn_last", "turns", *COUNTS[1:], "initial_first", "initial_last", "audit",
                    F.array_join(line, "\n").alias("lines"), (F.size("repaired") > 0).alias("any"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "piece"))

    def run(batches):
        now = None
        for batch in batches:
            names, done = batch.schema.names, []
            shape = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in COUNTS],
                               ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for i in range(batch.num_rows):
                p = {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}
                if now is None or now["conv_id"] != p["conv_id"]:
                    if now is not None:
                        done.append(_closed(now))
                    now = {"conv_id": p["conv_id"], **{c: 0 for c in COUNTS}, "turns": 0, "low": None, "high": None, "initial": None,
                           "audit": [], "any": False, "sha": hashlib.sha256()}
                for c in COUNTS[1:]:
                    now[c] += p[c]
                if now["initial"] is not None:
                    now["illegal"] += now["initial"] + p["initial_first"] not in LEGAL
                now["initial"] = p["initial_last"]
                if p["turn_first"] is not None:
                    now["turns"] += p["turns"] - (p["turn_first"] == now["high"])
                    now["low"] = p["turn_first"] if now["low"] is None else now["low"]
                    now["high"] = p["turn_last"]
                now["audit"].append(p["audit"])
                if p["any"]:
                    now["sha"].update((("\n" if now["any"] else "") + p["lines"]).encode())
                    now["any"] = True
            if done:
                yield pa.RecordBatch.from_pylist(done, shape)
        if now is not None:
            yield pa.RecordBatch.from_pylist([_closed(now)], shape)

    return alone.unionByName(map_arrow(rest, run, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"))


def _closed(now: dict) -> dict:
    gaps = now["high"] - now["low"] + 1 - now["turns"] if now["high"] is not None else 0
    return {"conv_id": now["conv_id"], **{c: now[c] for c in COUNTS[1:]}, "gaps": gaps, "audit": "".join(now["audit"]),
            "repaired_sha256": now["sha"].hexdigest()}


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; nulls as one space) with faults planted by crc32(conv_id:turn) % 20."""
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return marked.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                         F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                         .otherwise(F.col("text")).alias("text"),
                         F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found = report(repair(damaged(given))).withColumnRenamed("conv_id", "__c")
    both = given.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("__c")), "left")
    return both.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql_edit(state: int) -> str:
    """The best own edit of a row from ``state``, as a struct (cost, audit, lines with a line feed before each)."""
    s, n = f"s{state}", f"s{NEXT[state]}"
    kept = " ".join(f"WHEN ini = '{i}' AND fate <> {GONE} THEN struct_pack(c := more + s{t}.c, a := 'K' || s{t}.a, t := chr(10) || role || ':' || text || s{t}.t)"
                    for (i, at), t in KEPT.items() if at == state)
    return (f"list_min([struct_pack(c := {DELETE} + {s}.c, a := 'D' || {s}.a, t := {s}.t), "
            f"CASE WHEN fate <> {GONE} THEN struct_pack(c := {REROLE} + more + {n}.c, a := 'R' || {n}.a, t := chr(10) || '{WRITTEN[state]}:' || text || {n}.t) END"
            + (f", CASE {kept} END" if kept else "") + f"]) AS e{state}")


def _sql_insert(state: int, new: str, old: str) -> str:
    n = f"{old}{NEXT[state]}"
    return (f"least(e{state}, struct_pack(c := {INSERT} + {n}.c, a := 'I' || {n}.a, t := chr(10) || '{WRITTEN[state]}:' || {n}.t)) AS {new}{state}")


def _sql_four(make) -> str:
    return ", ".join(make(s) for s in range(4))


_SPACES = r"[\x20\x09-\x0D]"
ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i))),
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::UBIGINT)),
             lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS kind
  FROM conversations, crc_table),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?]{_SPACES}*$') AS open
  FROM rows_after),
seen AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate FROM placed),
judged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, blank, duplicate, NOT blank AND NOT duplicate AND open AS truncated,
         CASE WHEN blank OR duplicate THEN {GONE} WHEN open THEN {CUT_OFF} ELSE {OK} END AS fate,
         CASE WHEN NOT blank AND NOT duplicate AND open THEN {TRUNCATED} ELSE 0 END AS more,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS ini_before
  FROM seen),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank,
         count_if(duplicate)::BIGINT AS duplicate, count_if(truncated)::BIGINT AS truncated,
         count_if(ini_before IS NOT NULL AND ini_before || ini NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
best AS (
  SELECT conv_id, n + 1 AS i, struct_pack(c := 0::BIGINT, a := '', t := '') AS s0,
         struct_pack(c := {2 * INSERT}::BIGINT, a := 'II', t := chr(10) || 'user:' || chr(10) || 'assistant:') AS s1,
         struct_pack(c := {INSERT}::BIGINT, a := 'I', t := chr(10) || 'assistant:') AS s2,
         struct_pack(c := 0::BIGINT, a := '', t := '') AS s3
  FROM sums
  UNION ALL
  SELECT conv_id, i, {_sql_four(lambda s: f"o{s} AS s{s}")} FROM (
    SELECT conv_id, i, {_sql_four(lambda s: _sql_insert(s, "o", "m"))} FROM (
      SELECT *, {_sql_four(lambda s: _sql_insert(s, "m", "e"))} FROM (
        SELECT j.conv_id, j.i, {_sql_four(_sql_edit)}
        FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i - 1)))),
found AS (SELECT conv_id, s0 FROM best WHERE i = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit,
       sha256(coalesce(substr(s0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM c.conv_id
"""
