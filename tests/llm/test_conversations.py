"""Conversation repair: plain versions of the rules, the cheapest least audit, and pieces of any size."""
import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from tidemark.llm import conversations as C


def after_damage(rows):
    """(conv_id, turn, role, text) rows, damaged, by conversation in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit, repaired lines), from the back: all edits, up to two insertions in a row."""
    def options(state):
        role, to = ("assistant", 3) if state == 2 else ("user", 2)
        return role, to

    best = [(0, "", ()), (4, "II", ("user:", "assistant:")), (2, "I", ("assistant:",)), (0, "", ())]
    for (_, role, text), f in list(zip(rows, fault))[::-1]:
        own = []
        for s in range(4):
            c, a, t = best[s]
            some = [(c + 3, "D" + a, t)]
            if f not in ("blank", "duplicate"):
                more = f == "truncated"
                new, to = options(s)
                c, a, t = best[to]
                some.append((c + 2 + more, "R" + a, (f"{new}:{text}",) + t))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], s))
                if to is not None:
                    c, a, t = best[to]
                    some.append((c + more, "K" + a, (f"{role}:{text}",) + t))
            own.append(min(some))
        for _ in range(2):
            now = [min(own[s], (2 + now_c, "I" + now_a, (f"{options(s)[0]}:",) + now_t)) for s, (now_c, now_a, now_t)
                   in enumerate((own if _ == 0 else now)[options(s)[1]] for s in range(4))]
        best = now
    return best[0]


def every_edit(rows, fault):
    """The same by trying every sequence of edits."""
    slots = [[()]] + [[(r,) for r in ("user", "assistant")]] + [list(itertools.product(("user", "assistant"), repeat=2))]
    inserts = [i for s in slots for i in s]
    found = []
    for chosen in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product("KDua", repeat=len(rows)):
            cost, audit, lines, initials, fine = 0, "", [], "", True
            for k, ins in enumerate(chosen):
                for r in ins:
                    cost, audit, initials = cost + 2, audit + "I", initials + r[0]
                    lines.append(f"{r}:")
                if k == len(rows):
                    break
                (_, role, text), f, e = rows[k], fault[k], edits[k]
                if e == "D":
                    cost, audit = cost + 3, audit + "D"
                    continue
                if f in ("blank", "duplicate"):
                    fine = False
                    break
                new = role if e == "K" else {"u": "user", "a": "assistant"}[e]
                cost, audit = cost + (0 if e == "K" else 2) + (f == "truncated"), audit + ("K" if e == "K" else "R")
                initials += new[:1] or "?"
                lines.append(f"{new}:{text}")
            if fine and re.fullmatch("(s?(ua)+)?", initials):
                found.append((cost, audit, tuple(lines)))
    return min(found)


def expected(rows):
    out, original = {}, {r[0] for r in rows}
    by = after_damage(rows)
    for conv in original:
        some = by.get(conv, [])
        fault = faults(some)
        turns = [t for t, _, _ in some if t is not None]
        cost, audit, lines = cheapest(some, fault) if some else (0, "", ())
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fault.count("blank"), fault.count("duplicate"),
                     fault.count("truncated"), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in [*C.COUNTS, "audit", "repaired_sha256"]) for r in df.collect()}


ROWS = st.lists(st.tuples(st.none(), st.sampled_from(["user", "assistant", "system", "tool", "", " "]),
                          st.sampled_from(["a.", "b!", "open", "", " \n", "c? "])), max_size=2)


@settings(max_examples=60, deadline=None)
@given(ROWS)
def test_plain_version_tries_every_edit(rows):
    assert cheapest(rows, faults(rows)) == every_edit(rows, faults(rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.none(), st.sampled_from(["user", "assistant", "system", "tool", ""]),
                                   st.sampled_from(["a.", "b!", "c.", "d?", "e.", "open", "", " \n"])), min_size=1, max_size=14), min_size=1, max_size=4),
       st.integers(1, 6))
def test_paths_in_one_part_and_in_pieces(conversations, width):
    import numpy as np
    import pyarrow as pa

    parts = []
    for rows in conversations:
        fault = faults(rows)
        code = C.mark_duplicates(C.row_codes(pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])), np.array([f == "duplicate" for f in fault]))
        parts.append(C.split_codes(code))
    paths = C.Paths([(*p, C.end_costs(), True) for p in parts])
    nodes, begin, ends = paths.walk(np.array([paths.start(k, 0) for k in range(len(parts))]))
    for k, rows in enumerate(conversations):
        cost, audit, _ = cheapest(rows, faults(rows))
        assert paths.cost[paths.start(k, 0)] == cost
        assert C.LETTERS[paths.letter[nodes[begin[k]: begin[k + 1]]]].tobytes().decode() == audit
        # the same in pieces of a few rows: costs from the last piece, states from the first
        ini, fate = parts[k]
        cuts = list(range(0, len(rows), width))
        behind, known = C.end_costs(), []
        for lo in reversed(cuts):
            piece = (ini[lo: lo + width], fate[lo: lo + width])
            known.insert(0, (*piece, behind, lo == cuts[-1]))
            m = C.matrix(*piece)
            behind = tuple(min(m[4 * s + t] + behind[t] for t in range(4)) for s in range(4))
        state, letters = 0, ""
        for piece in known:
            one = C.Paths([piece])
            n, b, e = one.walk(np.array([state]))
            letters += C.LETTERS[one.letter[n]].tobytes().decode()
            state = int(e[0]) & 3
        assert letters == audit and behind[0] == cost


def test_query(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF_SMALL}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    assert got(C.query(spark, SF_SMALL)) == expected(rows)


def odd_rows():
    roles, texts = ["user", "assistant", "system", None, "", "User", "tool"], ["a.", "b!", None, "", "no end", " \t", "x" * 5000 + "?", "ünï."]
    rows = [(i % 7 if i % 11 else None, (i * 7) % 13 if i % 5 else None, roles[i * 3 % 7], texts[i * 5 % 8]) for i in range(150)]
    rows += [(99, t // 2, ["user", "assistant"][t % 2], f"text {t % 40}.") for t in range(300)]
    return rows + [(100, 3, "user", "same.")] * 90 + [(101, 9223372036854775806, "user", "far."), (102, None, None, None)]


@pytest.mark.parametrize("size", [4096, 5])
def test_odd_rows_and_small_pieces(spark, size):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    pieces = C.repair(C.damaged(df), size)
    found = got(C.report(pieces))
    if size < 10:
        assert pieces.where("NOT whole").count() > 50
    want = expected(rows)
    assert {k: found.get(k, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) for k in want} == want


def test_messages_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "user", "you?")], "conv_id int, turn int, role string, text string")
    rows = C.messages(C.repair(df)).orderBy("piece", "place").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("user", "hi."), ("assistant", "you?")]
    assert C.report(C.repair(df.limit(0))).count() == 0
