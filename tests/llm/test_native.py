"""URL rules and winnowing: against plain loops, on odd cases, and without Python in their plans."""

import hashlib
import random
import re

import pytest

from chronolake.llm import url_filter, winnow
from chronolake.llm.queries import URL_RULES

from .conftest import words

RULES = [*URL_RULES, ("a.com", "/b", "block"), ("x.a.com", "/", "allow"), ("com", "/very/deep/path/", "block"), ("a.com", "", "allow")]


def judge(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme/en/", "http://", "http://example.com", "https://EXAMPLE.com/en/", "http://www.example.com/en/x?y#z", "ftp://notexample.com/en/", "http://a.net/es/1", "http://net/fr/",
            "http://x.a.com/b/c", "http://a.com/bc", "http://a.com", "x://a.com?q=/b", "http://h.com/very/deep/path/x//y/", "http://é.com/ÉÀ/?", "a://b://c.com/en/", "http://.com/", "http://com./", "http://a.b.c.d.e.f.example.com:80/en/"]
    rows = [(i, u, "h", "p", "r", "v", "d") for i, u in enumerate(urls)] + [(0, None, "h", "p", "r", "v", "d"), (None, "http://a.com/b", "h", "p", "r", "v", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string, digest string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for small in (True, False):
        url_filter.BROADCAST_RULES, kept = (100_000 if small else -1), url_filter.BROADCAST_RULES
        got = url_filter.filter_urls(pages, rules)
        url_filter.BROADCAST_RULES = kept
        want = sorted(((i, *judge(u, RULES)) for i, u, *_ in rows), key=str)
        assert sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in got.collect()), key=str) == want
        assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        m = min(len(w), 13)
        for k in range(len(w) - m + 1) if w else ():
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= {str(x) for x in windows[tuple(w[k : k + m])] if x is not None}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [True, False])
def test_contamination(spark, edge_docs, no_docs, monkeypatch, small):
    if not small:
        monkeypatch.setattr(winnow, "BROADCAST_FINGERPRINTS", -1)
    rnd = random.Random(41)
    texts = [r.text for r in edge_docs.collect() if r.text and len(r.text) > 600 and " " in r.text]
    items = [(10 + k, " ".join(t.split()[5 : 5 + rnd.choice([13, 14, 20, 40])])) for k, t in enumerate(texts)]
    items += [(1, "one"), (2, "a B c!"), (3, "two words"), (4, None), (5, ""), (6, "..."), (7, " ".join(words(rnd, 30))), (8, "ha " * 20), (9, "ha " * 20), (None, "a b c d e")]
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    extra = [(1000 + k, " ".join(words(rnd, rnd.randint(0, 90)) + split(items[k % len(items)][1])[rnd.randint(0, 3) :] + words(rnd, 9))) for k in range(40)]
    frame = edge_docs.select("doc_id", "text", "words", "version", "hashes", "copies").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame([(i, t, "w", 1) for i, t in items], "item_id long, text string, words string, need int")
    got = winnow.contamination(frame, bench)
    assert result(got) == brute(docs + extra, items)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    left = winnow.drop_contaminated(frame, bench)
    bad = {r[0] for r in brute(docs + extra, items) if r[-1]}
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} >= {i for i, _ in docs + extra if i is not None} - bad
    assert not ({r.doc_id for r in left.collect()} & (bad - {None}))
    assert winnow.contamination(no_docs, bench).count() == 0
    assert {r.n_hit for r in winnow.contamination(frame, bench.limit(0)).collect()} == {0}
