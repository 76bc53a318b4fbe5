"""Property checks (hypothesis) of translation and positions against brute force."""
import bisect

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from builders import commits_df, log_df
from tidemark.operators import translate_offsets, with_target_offsets

offsets_st = st.lists(st.integers(min_value=0, max_value=5000), min_size=0, max_size=60, unique=True)
commits_st = st.lists(st.integers(min_value=-3, max_value=5100), min_size=1, max_size=8)
span_st = st.sampled_from([1, 3, 17, 256, 1 << 16])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=offsets_st, b=offsets_st, points=commits_st, span=span_st)
def test_translation_and_positions_match_brute_force(spark, a, b, points, span):
    rows = [("t", 0, o, "k", "v", 1, None) for o in a] + [("t", 1, o, "k", "v", 1, None) for o in b]
    log = log_df(spark, rows)
    commits = [(f"g{i}", "t", p, c) for i, c in enumerate(points) for p in (0, 1)]
    got = {(g, p): n for g, _, p, _, n in
           (tuple(r) for r in translate_offsets(log, commits_df(spark, commits), bucket_span=span).collect())}
    parts = {0: sorted(a), 1: sorted(b)}
    want = {(g, p): bisect.bisect_left(parts[p], c) for g, _, p, c in commits if parts[p]}
    assert got == want
    ranks = {(r.partition, r.offset): r.target_offset
             for r in with_target_offsets(log, span).select("partition", "offset", "target_offset").collect()}
    assert ranks == {(p, o): i for p, offs in parts.items() for i, o in enumerate(offs)}
