"""Ranked search, URL filters and source divergence against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinweave.llm import divergence, ranked, urls
from kinweave.llm.queries import URL_RULES
from kinweave.llm.terms import Terms

WORDS = [f"{a}{b}" for a in ("ka", "Lo", "mi", "été", "日本") for b in ("n", "T9", "s", "7", "r")]


def texts(n, seed):
    deal = random.Random(seed)
    out = [None, "", " .-! ", "ka", "KAn kan\x00kan"]
    while len(out) < n:
        out.append(" ".join(deal.choice(WORDS[: deal.choice((3, 8, 25))]) + deal.choice(["", ",", "-x"]) for _ in range(deal.choice((1, 5, 40, 200)))))
    return out + out[:9]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def found(text, digits):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def test_terms_in_slices():
    for digits in (True, False):
        for text in texts(40, 1):
            for size in (1, 7, 50, 4_000_000):
                assert Terms(digits).counted((text or "").encode(), size) == Counter(t.encode() for t in found(text, digits))


def best_of(docs, query, k=10):
    counts = [(i, Counter(found(t, True))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    scores = []
    for i, c in counts:
        m = 25 + (75 * c.total() * n_docs) // total
        score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in found(query, True) if c[t])
        if score > 0:
            scores.append((-score, math.inf if i is None else i, i))
    return [(k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:k])]


def test_ranked_search(spark):
    docs = [(None if k == 20 else 7 if k in (30, 31) else k, t) for k, t in enumerate(texts(150, 2))]
    items = [(0, "kan, KAN lot9"), (1, None), (2, "nowhere"), (3, "ka " + " ".join(WORDS)), (3, "kan"), (None, "日本n mis"), (5, WORDS[3] * 1)]
    # Extra columns with names of the operator's own.
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, segment int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, weight int")
    got = defaultdict(list)
    for r in ranked.search(ranked.index(table), asked).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    queries = defaultdict(str)
    for i, t in items:
        queries[i] += " " + (t or "")
    assert {i: sorted(x) for i, x in got.items()} == {i: best for i, q in queries.items() if (best := best_of(docs, q))}
    none = table.limit(0)
    assert ranked.search(ranked.index(none), asked).count() == 0 and ranked.search(ranked.index(table), asked.limit(0)).count() == 0


def test_skipping_over_long_lists():
    """Lists, short and long ones, over several blocks and segments: the best ten are those of the full sums, and documents are skipped."""
    deal, total, looked = np.random.default_rng(3), 0, 0
    for _ in range(20):
        best, full = ranked._Best(10), []
        weights = deal.integers(0, 9000, 12)
        for segment in range(3):
            n = int(deal.integers(1, 20_000))
            blocks, m = -(-n // ranked.BLOCK), deal.integers(25, 4000, n)
            ids, sums, lists = deal.permutation(n) + 100_000 * segment, np.zeros(n, np.int64), []
            for w in weights:
                places = np.flatnonzero(deal.random(n) < deal.choice([0.0005, 0.01, 0.3, 0.9]))
                tf = deal.geometric(0.5, len(places))
                if len(places):
                    lists.append((int(w), ranked._List(places.astype("<u2").tobytes(), tf.astype("<u4").tobytes(), m, blocks)))
                    sums[places] += w * (1_000_000_000 * tf // (1000 * tf + 8 * m[places]))
            looked, total = looked + ranked._search(lists, ids, blocks, best), total + n
            full += [(-int(s), int(i)) for s, i in zip(sums, ids, strict=True) if s > 0]
        assert list(zip(-best.scores, best.ids, strict=True)) == sorted(full)[:10]
    assert looked < total


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**6, 3])
    assert ranked._floors(n, 10**13, 10**15).tolist() == [25 + 75 * int(x) * 10**13 // 10**15 for x in n]


def brute_verdicts(pages, links):
    def cut(url):
        rest = url.split("://", 1)[1].split("#")[0] if url and "://" in url else ""
        host = re.match(r"[^/?]*", rest)[0]
        return lower(host), rest[len(host) :].split("?")[0], lower(host) + rest[len(host) :]

    def rule_of(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[top(cut(a)[2])] = top(cut(b)[2])
    said = defaultdict(set)
    for node in list(parent):
        said[top(node)].add(rule_of(*cut("x://" + node)[:2])[1])
    out = []
    for page_id, url, _ in pages:
        host, path, node = cut(url)
        rule, verdict = rule_of(host, path)
        spread = said[top(node)] if node in parent else set()
        out.append((page_id, host, path, rule, verdict or ("block" if "block" in spread and "allow" not in spread else "allow")))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(URL_RULES, "verdict string, host string, path string")


def test_url_filters(spark, rules):
    canonical, refresh = '<html><LINK href="{}" rel="x Canonical"></html>', "<meta http-equiv='Refresh' content='0; URL={}'>"
    pages = [
        (1, "http://a.net/x?q=1#f", canonical.format("https://shop.COM/de/1")), (2, "https://b.net/p/q/r", canonical.format("../../y")), (3, "https://b.net/y", refresh.format("http://a.net/x?q=1")),
        (4, "http://c.net", canonical.format("http://d.example.org/es/1")), (5, "https://e.org/", canonical.format("http://c.net")), (6, "http://example.org/en/12", None), (7, "http://notexample.org/es/", ""),
        (8, None, canonical.format("http://x.com/de/")), (9, "no scheme", canonical.format("http://x.com/de/")), (None, "http://f.net/a", "<!-- " + canonical.format("http://x.com/de/") + " -->"),
        (11, "http://u:p@Deep.Sub.Example.ORG:80/es/a", None), (12, "http://g.net/?a=/de/", canonical.format("mailto:me@x.com")), (13, "http://x.com/de/", None), (13, "http://x.com/de/", None),
        (14, "http://h.net/a", '<script>var s = "<link rel=canonical href=http://x.com/de/>"</script>'), (15, "http://org", None), (16, "http://i.net/d/", canonical.format("?b=1&amp;c=2")), (17, "http://i.net/d/?b=1&c=2", canonical.format("//x.com/de/z")),
        (18, "http://j.net/", canonical.format("#top")), (19, "http://k.net/", None), (20, "ftp://x.com/fr/de/", None),
    ]
    links = [("http://a.net/x?q=1", "x://shop.com/de/1"), ("x://b.net/p/q/r", "x://b.net/y"), ("x://b.net/y", "x://a.net/x?q=1"), ("x://c.net", "x://d.example.org/es/1"), ("x://e.org/", "x://c.net"), ("x://i.net/d/", "x://i.net/d/?b=1&c=2"), ("x://i.net/d/?b=1&c=2", "x://x.com/de/z"), ("x://k.net/", "x://l.net/"), ("x://l.net/", "x://x.com/de/far")]
    table = spark.createDataFrame([(*p, "mine", "rule") for p in pages], "page_id long, url string, html string, host string, rule string").repartition(4)
    log = spark.createDataFrame([("http://k.net/", "http://l.net/#x"), ("https://l.net/", "http://x.com/de/far"), (None, "http://x.com/de/"), ("http://m.net/", None)], "from_url string, to_url string")
    got = urls.judge(table, rules, log)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_verdicts(pages, links)
    assert urls.judge(table.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(table, rules.limit(0)).collect()} == {"allow"}


def test_long_alias_chains_and_hubs(spark, rules):
    """A chain of 60 redirects and 300 pages with one canonical url: all are blocked with their ends."""
    chain = [(k, f"http://c{k}.net/", f'<link rel="canonical" href="http://c{k + 1}.net/">' if k < 60 else '<link rel="canonical" href="http://x.com/de/end">') for k in range(61)]
    hub = [(100 + k, f"http://h.net/{k}", '<link rel="canonical" href="/es">') for k in range(300)] + [(1000, "http://h.net/es", '<meta http-equiv=refresh content="0;url=http://example.org/es/">')]
    table = spark.createDataFrame(chain + hub, "page_id long, url string, html string")
    assert {(r.verdict, r.rule) for r in urls.judge(table, rules).collect()} == {("block", None)}


def brute_audit(docs, least, listed):
    docs = [(t or "", g or "", s or "") for t, g, s in docs]
    out = []
    for lang in {g for _, g, _ in docs}:
        mine = [(s, Counter(found(t, False))) for t, g, s in docs if g == lang]
        df = Counter(t for _, c in mine for t in c)
        kept = [t for t, n in df.items() if n >= least]
        of = {s: Counter() for s, _ in mine}
        for s, c in mine:
            of[s].update({t: c[t] for t in kept if c[t]})
        whole = sum(of.values(), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = shares(whole)
        for s in of:
            p = shares(of[s])
            other = [(-sum(abs(p[t] - x[t]) for t in kept), o) for o in of if o != s for x in [shares(of[o])]]
            more = [(q[t] - p[t], t) for t in kept if of[s][t] and p[t] > q[t]]
            for part, rows, most in (("pair", other, None), ("term", more, listed)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(sorted(rows, key=lambda x: (x[0], x[1].encode()))[:most])]
    return sorted(out)


def test_divergence(spark):
    deal = random.Random(4)
    docs = [(t, deal.choice(["en", "de", None]), deal.choice(["a", "b", "c", None, "é"])) for t in texts(400, 5)]
    docs += [(None, "en", "silent"), ("alone", "fr", "one"), ("alone", "fr", "two"), ("", "", "")]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, n int, term string").repartition(5)
    got = divergence.audit(table)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, divergence.MIN_DOCS, divergence.LISTED)
    assert divergence.audit(table.limit(0)).count() == 0


def test_trees_price_and_surplus():
    """Walks over shared nodes equal the sums term by term, also for counts beyond 64 bits of product; equal trees are one node."""
    deal = np.random.default_rng(6)
    for most in (1, 3, 50, 10**15):
        counts = deal.integers(0, most, (5, 256)) * (deal.random((5, 256)) < 0.3)
        counts[1] = counts[0]
        trees = divergence.Trees(counts)
        assert trees.roots[0] == trees.roots[1]
        totals = [int(c.sum()) for c in counts]
        p = [divergence.shares(trees.leaves, t, 256) for t in totals]
        exact = [[1 + 10**9 * (int(x) + 5) // (t + 5 * 256) for x in c] for c, t in zip(counts, totals, strict=True)]
        for a in range(5):
            for b in range(5):
                assert divergence.price(trees, a, b, p[a], p[b]) == sum(abs(x - y) for x, y in zip(exact[a], exact[b], strict=True))
                want = sorted((k, x - y) for k, (x, y) in enumerate(zip(exact[a], exact[b], strict=True)) if counts[a][k] and x > y)
                got = divergence.surplus(trees, a, b, p[a], p[b], 7)
                best = sorted((-v, k) for k, v in want)[:7]
                assert set(got) <= set(want) and sorted((-v, k) for k, v in got)[: len(best)] == best
