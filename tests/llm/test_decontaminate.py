import random
import re

from tidemark.llm import decontaminate as D


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute(docs, items):
    out = {}
    for i, text in docs:
        w = words(text)
        plain, hit, ids = [x[0] for x in w], set(), set()
        for item, t in items:
            own = [x[0] for x in words(t)]
            size = min(10, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                for p in range(len(plain) - size + 1):
                    if plain[p:p + size] == own[k:k + size]:
                        hit |= set(range(p, p + size))
                        ids |= {item} - {None}
        spans = []
        for p in sorted(hit):
            if spans and p - 1 in hit:
                spans[-1][1] = w[p][2]
            else:
                spans.append([w[p][1], w[p][2]])
        out[i] = (len(w), len(hit), sorted(ids), [tuple(s) for s in spans])
    return out


def sample():
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(60)] + ["é", "漢字", "42"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(9, 25)))) for i in range(8)]
    items += [(20, "Short, item!"), (21, ""), (22, None), (None, "nameless item here"), (0, "Short item"), (23, "--- ...")]
    docs = []
    for i in range(40):
        parts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 20)))]
        if i % 2:
            own = rnd.choice(items[:8])[1].split(" ")
            cut = rnd.randint(0, 3)
            parts += [rnd.choice([" ", ", ", "\n", "-"]).join(own[cut:]).upper(), "tail é"]
        docs.append((i, " ".join(parts)))
    docs += [(50, None), (51, ""), (52, "a SHORT...item b"), (53, "the nameless ITEM here"), (54, " ".join(items[3][1].split(" ")) * 3)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = sample()
    frame = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "1 as ITEMS", "2 as other")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    for limit in (D.MAX_ITEM_WORDS, 40):        # one automaton, and several
        out = D.find_leaks(frame, bench, max_item_words=limit)
        assert out.columns == ["doc_id", "text", "other", "n_words", "n_hit", "items", "spans"]
        got = {r.doc_id: (r.n_words, r.n_hit, r.items, [(s.start, s.end) for s in r.spans]) for r in out.collect()}
        assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 10


def test_stage_and_empty_tables(spark):
    docs, items = sample()
    frame = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "'keep' as N_HIT")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    left = D.drop_leaks(frame, bench)
    assert left.columns == frame.columns
    want = brute(docs, items)
    assert {r.doc_id for r in left.collect()} == {i for i, w in want.items() if not w[1]}
    assert D.drop_leaks(frame, bench.limit(0)).count() == len(docs)
    assert D.drop_leaks(frame.limit(0), bench).count() == 0


def test_item_ids_of_any_type(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    for kind in ("smallint", "string", "date", "decimal(10,0)", "double"):
        items = spark.createDataFrame([(text,)], "text string").selectExpr(f"cast(null as {kind}) as none", f"cast('2024' as {'date' if kind == 'date' else kind}) as item_id", "text")
        for bound in (D.MAX_ITEM_WORDS, 4):
            row = D.find_leaks(docs, items.select("item_id", "text"), max_item_words=bound).first()
            assert row.n_hit == 10 and len(row["items"]) == 1
