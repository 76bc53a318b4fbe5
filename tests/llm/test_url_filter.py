import re
from itertools import product

import numpy as np

from conftest import SF_SMALL
from tidemark.llm import url_filter as U
from tidemark.llm.tables import table


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits) if fits else (0, None, None)
    return host, path, rule, verdict


def test_rules(spark):
    urls = [r.url for r in table(spark, SF_SMALL, "pages").collect()]
    urls += [None, "", "no scheme.org/", "http://ORG", "http://Org/x", "x://a.example.org/es/1", "x://example.org/en/17#a", "x://org",
             "http://a.com/fr/?q=/de/", "http://a.com/de/fr/", "http://notorg/", "http://a.org?x=/", "://b.com/fr/y#z", "é://Ä.COM/de/"]
    pages = spark.createDataFrame([(i, u, "<p>some words</p>", "mine") for i, u in enumerate(urls)],
                                  "page_id int, url string, html string, VERDICT string")
    out = U.judge(pages)
    assert out.columns == ["page_id", "url", *U.OUTPUT]
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or (verdict is None and got[i].verdict in ("allow", "block"))
    assert U.judge(pages.limit(0)).count() == 0


def test_best_cut_against_all_cuts():
    counts = {"the": 50, "there": 9, "rein": 3, "in": 30, "re": 5, "t": 1, "he": 20}
    total = sum(counts.values())
    for run in ("therein", "thexinq", "a", "tthe"):
        found = [{"start": i, "length": len(w), "n": n} for w, n in counts.items() for i in range(len(run)) if run.startswith(w, i)]
        best = -np.inf
        for cuts in product([0, 1], repeat=len(run) - 1):
            words, now = [], run[0]
            for c, cut in zip(run[1:], cuts):
                words, now = (words + [now], c) if cut else (words, now + c)
            words.append(now)
            score = sum(np.log(counts[w] / total) if w in counts else np.log(1 / total) - len(w) * np.log(U.UNSEEN) for w in words)
            best = max(best, score)
        got = U.best_cut(run, found, total)
        assert "".join(got) == run
        score = sum(np.log(counts[w] / total) if w in counts else np.log(1 / total) - len(w) * np.log(U.UNSEEN) for w in got)
        assert abs(score - best) < 1e-9


def test_host_words_and_odds(spark):
    html = "<p>" + "cheap pills daily news good " * 30 + "</p>"
    rows = [(i, f"http://dailynews{i % 3}.x.org/a/{i}", html) for i in range(20)]
    rows += [(100 + i, f"http://cheappills.y{i}.com/de/{i}", html) for i in range(20)]
    rows += [(200, "http://cheappills.zone.net/a", html), (201, "http://dailynews.zone.net/a", html), (None, None, None)]
    out = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert out[200].words[:2] == ["cheap", "pills"] and out[200].verdict == "block"
    assert out[201].words[:2] == ["daily", "news"] and out[201].verdict == "allow"
    assert out[None].host == "" and out[None].verdict == "allow"


def test_odds_match_plain_naive_bayes(spark):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, SF_SMALL, "pages").collect()]
    out = U.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    tokens = lambda r: (["h:" + w for w in r.words]        # noqa: E731
                        + ["p:" + t for t in re.findall(r"[^\W_]+", re.sub("[0-9]", "0", r.path.lower()))])
    good, bad, n = {}, {}, [0, 0]
    for r in out:
        if r.rule:
            side, k = (good, 0) if r.verdict == "allow" else (bad, 1)
            n[k] += 1
            for t in tokens(r):
                side[t] = side.get(t, 0) + 1
    v = len(set(good) | set(bad))
    a, b = sum(good.values()) + v + 1, sum(bad.values()) + v + 1
    for r in out:
        want = np.log((n[0] + 1) / (n[1] + 1)) + sum(np.log((good.get(t, 0) + 1) / a) - np.log((bad.get(t, 0) + 1) / b) for t in tokens(r))
        assert abs(want - r.log_odds) < 1e-6
        assert r.rule or r.verdict == ("allow" if want >= -1e-9 else "block")
