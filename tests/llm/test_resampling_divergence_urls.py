"""Importance resampling, source divergence and URL filters against plain versions, and the awkward cases of their tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import divergence, resampling, urls
from gridloom.llm.resampling import Resample
from gridloom.llm.urls import Rule

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, term string, score double"


def prose(n: int, seed: int, size: int = 300) -> str:
    return " ".join(f"Wé{int(x)}x" for x in np.random.default_rng(seed).integers(0, size, n))


# op11

def resampled_by_hand(rows, target, how):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % how.buckets for k in range(1, how.n + 1) for i in range(len(w) - k + 1)]

    docs = [(i, *runs(t)) for i, t in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in runs(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(S + how.buckets) / ((s[b] + 1) * float(T + how.buckets))))
    out = []
    for i, n, b in docs:
        h = int(hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, b)) // len(b) if b else 0
        out.append([i, n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= how.least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[: len(able) * how.percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


ODD = [(900, None), (901, ""), (902, "..., !"), (None, prose(50, 7)), (None, prose(60, 8)), (3, prose(40, 9)), (904, "ü" * 5000 + " Ab12 " + "z" * 200), (905, "- " * 4000), (3, prose(3000, 3)), (3, prose(3000, 3))]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_equals_a_plain_version_with_cut_texts(spark, n):
    rows = [(i, prose(5 + 17 * (i % 90), i)) for i in range(120)] + ODD
    target = [prose(400, 900, 40), None, "wé1x WÉ2X"]
    how = Resample(n=n, chunk=512, percent=40)
    docs = spark.createDataFrame([(i, t, None, None, 0, 5, "x", 1.0) for i, t in rows], DOCS).repartition(3)
    got = resampling.resample(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), how)
    assert sorted(map(tuple, got.collect()), key=str) == resampled_by_hand(rows, target, how)


def test_chunks_own_each_word_once():
    how = Resample(n=3, chunk=64)
    text = prose(200, 1)
    parts = list(resampling.cut(text.encode(), how))
    assert len(parts) > 20 and sum(own for _, own in parts) == 200
    words, at = text.split(), 0
    for piece, own in parts:
        assert piece.decode().split() == words[at : at + own + 2][: own + 2]
        at += own


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, prose(30, 1)), (2, "a b")], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    assert sorted(map(tuple, resampling.resample(some, none, Resample(percent=100)).collect())) == resampled_by_hand([(1, prose(30, 1)), (2, "a b")], [], Resample(percent=100))


def test_crc32_of_all_lengths():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.integers(1, 400, 300)
    assert resampling.crc32(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


# op12

def divergence_by_hand(rows, how):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source in rows]
    count, holds, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        count.update((lang, source, w) for w in words)
        holds.update((lang, w) for w in set(words))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(w for (g, w), n in holds.items() if g == lang and n >= how.least)
        v = len(kept)

        def shares(n):
            size = sum(n.values()) + 2 * v
            return {w: 1 + how.unit * (n[w] + 2) // size for w in kept}

        own = {s: shares({w: count[lang, s, w] for w in kept}) for s in sources}
        q = shares({w: sum(count[lang, s, w] for s in sources) for w in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(own[s][w], own[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(own[s][w], q[w]), w.encode(), w) for w in kept if count[lang, s, w] and own[s][w] > q[w])[: how.top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -x, k + 1) for k, (x, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("knobs", [{}, {"heavy": 1}, {"heavy": 2}, {"heavy": 99}, {"heavy": 4, "postings": 50, "block": 3}])
def test_divergence_equals_a_plain_version(spark, knobs):
    rng = np.random.default_rng(5)
    word = lambda k: "".join(chr(97 + (k // 26**j) % 26) for j in range(3)) + "é"
    rows = []
    for i in range(160):
        lang, source = ("en", "de", None)[i % 3], f"s{int(rng.zipf(1.5)) % 9}" if i % 11 else None
        size = 40 if source != "s3" else 12
        rows.append((i, " ".join(word(int(x)).upper() if x % 2 else word(int(x)) for x in rng.zipf(1.3, size) % 400), lang, source))
    rows += [(1, None, "en", "blank"), (None, "12 , 34", "fr", "x"), (None, "un un deux", "fr", "y"), (None, "un un deux", "fr", "y"), (7, "", "", "")]
    how = divergence.Audit(least=3, **knobs)
    docs = spark.createDataFrame([(i, t, lang, s, 0, 5, "clash", 1.0) for i, t, lang, s in rows], DOCS).repartition(4)
    got = divergence.divergence(docs, how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == divergence_by_hand(rows, how)
    assert got.count() == len(divergence_by_hand(rows, how))


def test_divergence_of_long_texts_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 300)
    rows = [(i, " ".join(f"{'abcdefgh'[x % 8] * (x % 5 + 1)}7" for x in np.random.default_rng(i).integers(0, 40, 20 + 900 * (i == 3))) + "q" * 700 * (i == 3), "en", f"s{i % 2}") for i in range(8)]
    docs = spark.createDataFrame([(i, t, lang, s, 0, 5, "x", 1.0) for i, t, lang, s in rows], DOCS).coalesce(1)
    found = divergence.term_counts(docs).filter("term is not null")
    want, holds = Counter(), Counter()
    for _, text, _, source in rows:
        words = re.findall(r"[a-z]+", text)
        want.update((source, w) for w in words)
        holds.update((source, w) for w in set(words))
    import pyarrow as pa  # the cut of the worker is the driver's own function

    data = np.frombuffer(rows[3][1].encode(), np.uint8)
    cuts = list(divergence._pieces(data))
    assert len(cuts) > 3 and cuts[0][0] == 0 and cuts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False)) and pa
    assert {(r["source"], r["term"]): (r["n"], r["docs"]) for r in found.collect()} == {k: (n, holds[k]) for k, n in want.items()}
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(2)
    size = rng.integers(1 << 40, 9 * 10**15, 500)
    count = (size * rng.random(500)).astype(np.int64)
    assert divergence.shares(count, size).tolist() == [1 + 10**9 * (int(c) + 2) // int(s) for c, s in zip(count, size, strict=True)]


def test_terms_of_one_hash_stay_apart(monkeypatch):
    from gridloom.llm import _text

    monkeypatch.setattr(_text, "spans_hash", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    text = b"abc abd abc xyz abcdefghij abcdefghik abcdefghij"
    group, n, docs, terms = divergence._tally(np.frombuffer(text, np.uint8), np.array([0, 15, len(text)]), np.array([0, 1]))
    assert dict(zip(zip(group.tolist(), terms, strict=True), zip(n.tolist(), docs.tolist(), strict=True), strict=True)) == {(0, b"abc"): (2, 1), (0, b"abd"): (1, 1), (0, b"xyz"): (1, 1), (1, b"abcdefghij"): (2, 1), (1, b"abcdefghik"): (1, 1)}


# op13

PAGES = "page_id long, url string, html string, host string, node string, component long"
CANON = '<html><head><title>x</title><LINK href="{}" rel="canonical"></head><body>t</body></html>'
RULES = [Rule("block", "bad.com"), Rule("allow", "ok.bad.com", "/good/"), Rule("block", "x.org", "/a"), Rule("allow", "x.org", "/a/b")]


def judged_by_hand(pages, rules, edges):
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule(url):
        h, p = parts(url)
        fit = [(-len(r.host + r.path), r.verdict, r.host + r.path) for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        return min(fit)[1:] if fit else (None, None)

    def node(url):
        h, p = parts(url)
        q = re.match(r"[^?#]*(\?[^#]*)?", url.split("://", 1)[1])[1] or "" if h else ""
        return h + (p or "/") + q if h else None

    group = {}

    def find(n):
        while group.setdefault(n, n) != n:
            n = group[n]
        return n

    said = defaultdict(set)
    for a, b in edges:
        group[find(node(a))] = find(node(b))
    for u in {u for e in edges for u in e}:
        said[find(node(u))].add(rule(u)[0])
    out = []
    for i, url, *_ in pages:
        v, r = rule(url)
        n = node(url)
        reached = v is None and n in group and said[find(n)] >= {"block"} and "allow" not in said[find(n)]
        out.append((i, *parts(url), r, "block" if reached else v or "allow", reached))
    return sorted(out, key=str)


def test_blocks_reach_aliases_unless_one_is_allowed(spark):
    pages = [
        (1, "http://a.com/1", CANON.format("https://bad.com/z")), (2, "http://B.com/x/y/2", CANON.format("../../p?q=1&amp;r=2")), (3, "https://b.com/p?q=1&r=2#f", CANON.format("//a.com/1")),
        (4, "http://c.com/", '<head><meta content="0; URL=\'http://d.com/d\'" http-equiv=refresh></head>'), (5, "http://d.com/d", CANON.format("http://x.org/a/b/c")), (6, "http://e.com", CANON.format("http://x.org/abc")),
        (7, "http://x.org/a/b/c", CANON.format("http://x.org/abc")), (8, None, CANON.format("http://bad.com/")), (9, "mailto:x", CANON.format("http://bad.com/")), (10, "http://f.com/f", "<!-- " + CANON.format("http://bad.com/") + " -->"),
        (11, "http://g.com/g", "<html><head></head><body><link rel=canonical href=http://bad.com/></body>"), (12, "http://h.com/h", None), (13, "ftp://ok.bad.com/good/1?x#y", ""), (13, "ftp://ok.bad.com/good/1?x#y", ""), (None, "http://a.com/1", None),
        (14, "http://notbad.com/", ""), (15, "http://bad.com?x", ""), (16, "http:///nohost", ""), (17, "http://i.com/i", CANON.format("")), (18, "http://j.com/j", "<head><script>" + CANON.format("http://bad.com/") + "</script></head>"), (19, "http://k.com/k", None),
    ]
    edges = [("http://a.com/1", "https://bad.com/z"), ("http://b.com/x/y/2", "http://b.com/p?q=1&r=2"), ("http://b.com/p?q=1&r=2", "http://a.com/1"), ("http://c.com/", "http://d.com/d"), ("http://d.com/d", "http://x.org/a/b/c"), ("http://e.com", "http://x.org/abc"), ("http://x.org/a/b/c", "http://x.org/abc"), ("http://k.com/k", "http://a.com/1")]
    df = spark.createDataFrame([(*p, "clash", "clash", 1) for p in pages], PAGES).repartition(3)
    redirects = spark.createDataFrame([("http://k.com/k", "http://a.com/1"), (None, "http://bad.com/"), ("http://l.com/", None)], "url string, link string")
    got = sorted(map(tuple, urls.judge(df, RULES, redirects).collect()), key=str)
    assert got == judged_by_hand(pages, RULES, edges)
    verdict = {r[0]: r[4] for r in got}
    assert [verdict[i] for i in (1, 2, 3, 4, 6, 10, 11, 18, 19)] == ["block"] * 3 + ["allow"] * 5 + ["block"]


def test_many_rules_are_joined_alike(spark, monkeypatch):
    hosts = [f"h{i % 7}.{t}" for i in range(40) for t in ("com", "co.uk")]
    pages = [(i, f"http://{'www.' * (i % 3)}{hosts[i % len(hosts)]}/p{i % 4}/x{i}", None) for i in range(200)] + [(None, None, None), (1, "x", None)]
    rules = [Rule("block", "com", "/p1"), Rule("allow", "h1.com"), Rule("allow", "co.uk", "/p2"), Rule("block", "co.uk", "/p2"), Rule("block", "www.h3.co.uk", "/p3/x")]
    df = spark.createDataFrame([(*p, "clash", "clash", 1) for p in pages], PAGES)
    few = sorted(map(tuple, urls.judge(df, rules).collect()), key=str)
    monkeypatch.setattr(urls, "FEW", 1)
    assert few == sorted(map(tuple, urls.judge(df, rules).collect()), key=str) == judged_by_hand(pages, rules, [])
    assert urls.judge(df.limit(0), rules).count() == 0 and urls.judge(df, []).filter("verdict != 'allow'").count() == 0


def test_a_hot_target_and_a_long_chain(spark):
    chain = [(f"http://c{i}.com/", f"http://c{i + 1}.com/") for i in range(60)] + [("http://c60.com/", "http://bad.com/")]
    star = [(f"http://s{i}.com/", "http://hub.com/") for i in range(300)] + [("http://x.org/ab", "http://hub.com/")]
    pages = [(i, a, None) for i, (a, _) in enumerate(chain + star)]
    links = spark.createDataFrame(chain + star, "url string, link string")
    df = spark.createDataFrame([(*p, "clash", "clash", 1) for p in pages], PAGES)
    got = urls.judge(df, RULES, links)
    assert got.filter("verdict = 'block'").count() == got.count() == len(pages) and got.filter("inherited").count() == len(pages) - 1


def test_no_python_runs_in_url_filters(spark):
    df = spark.createDataFrame([(1, "http://a.com/", CANON.format("http://bad.com/"), "", "", 1)], PAGES)
    plan = urls.judge(df, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and F
