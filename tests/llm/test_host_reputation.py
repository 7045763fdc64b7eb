"""Host reputation: rules, parts of a url, shrinkage against plain Python."""

import math
import random

import pytest

from pkgpulse.llm import host_reputation as H

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def judged(spark, urls, outcomes=(), **kw):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return {r.page_id: r for r in H.judge(pages, spark.createDataFrame(list(outcomes), "host string, bad boolean"), RULES, **kw).collect()}


def test_parts_and_rules(spark):
    cases = [
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://WWW.Example.ORG/Es/x", "www.example.org", "/Es/x", "org/", "allow"),
        ("http://example.org/es/x?q#f", "example.org", "/es/x", "example.org/es/", "block"),
        ("a\nb://m.example.org/en/12/#x", "m.example.org", "/en/12/", "example.org/en/1", "block"),
        ("x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("x://org", "org", "", None, "allow"),
        ("x://a.com?x=/fr/", "a.com", "", None, "allow"), ("x://a.com/fr", "a.com", "/fr", None, "allow"),
        ("x://a.com/de/1://b.org/", "a.com", "/de/1://b.org/", "com/de/", "block"), ("x://É.com/fr/é", "É.com", "/fr/é", "com/fr/", "allow"),
        ("://", "", "", None, "allow"), ("x:///only/path", "", "/only/path", None, "allow"),
    ]
    got = judged(spark, [c[0] for c in cases])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(cases))] == [c[1:] for c in cases]
    assert judged(spark, []) == {}


def plain(outcomes, z):
    hosts = {}
    for h, bad in outcomes:
        n, x = hosts.get(h, (0, 0))
        hosts[h] = (n + (bad is not None), x + bool(bad))

    def up(units, name):
        out = {}
        for u, (n, x) in units.items():
            a, b = out.get(name(u), (0, 0))
            out[name(u)] = (a + n, b + x)
        return out

    domain = lambda h: ".".join(h.split(".")[-3:] if ".".join(h.split(".")[-2:]) in H.LONG_SUFFIXES else h.split(".")[-2:])
    suffix = lambda h: ".".join(h.split(".")[-2:]) if ".".join(h.split(".")[-2:]) in H.LONG_SUFFIXES else h.split(".")[-1]
    domains, suffixes = up(hosts, domain), up(hosts, suffix)

    def strength(units):
        units = [u for u in units.values() if u[0]]
        n, x = sum(u[0] for u in units), sum(u[1] for u in units)
        p, k = x / n, len(units)
        between = sum(u[0] * (u[1] / u[0] - p) ** 2 for u in units) - p * (1 - p) * (k - 1)
        room = p * (1 - p) * (n - sum(u[0] ** 2 for u in units) / n - (k - 1))
        return 1 / min(max(between / room, 0.001), 0.5) - 1

    s, d, h = (strength(u) for u in (suffixes, domains, hosts))
    n, x = (sum(u[i] for u in hosts.values()) for i in (0, 1))
    out = {}
    for name, (hn, hx) in hosts.items():
        sn, sx = suffixes[suffix(name)]
        dn, dx = domains[domain(name)]
        m = (sx + s * (x + 1) / (n + 2)) / (sn + s)
        m = (dx + d * m) / (dn + d)
        m = (hx + h * m) / (hn + h)
        out[name] = (hn, hx, m, m - z * math.sqrt(m * (1 - m) / (hn + h + 1)))
    return out


def test_shrinkage_matches_plain_python(spark):
    rng = random.Random(3)
    names = [f"{s}.{d}.{t}" for s in ("a", "b", "www") for d in ("one", "two", "three") for t in ("com", "co.uk", "net")] + ["localhost"]
    rate = {n: rng.choice([0.02, 0.2, 0.95]) for n in names}
    outcomes = [(n, None if rng.random() < 0.3 else rng.random() < rate[n]) for n in names for _ in range(rng.choice([1, 5, 60]))]
    got = {r.host: (r.n, r.bad, r.mean, r.bound) for r in H.reputations(spark.createDataFrame(outcomes, "host string, bad boolean")).collect()}
    want = plain(outcomes, H.Z)
    assert got.keys() == want.keys()
    for name in want:
        assert got[name] == pytest.approx(want[name])
    verdicts = judged(spark, [f"x://{n}/" for n in names], outcomes)
    assert [verdicts[i].verdict for i in range(len(names))] == ["block" if want[n][3] > H.LIMIT else "allow" for n in names]
    assert any(want[n][3] > H.LIMIT for n in names)


def test_outcomes_come_from_the_document_a_path_ends_with(spark):
    pages = spark.createDataFrame([("x://a.com/en/7.html",), ("x://a.com/en/8/?p=9",), ("x://b.com/z",), (None,)], "url string")
    labels = spark.createDataFrame([(7, 0, 0), (8, 1, None), (8, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted((r.host, r.bad) for r in H.page_outcomes(pages, labels).collect() if r.host)
    assert got == [("a.com", False), ("a.com", True), ("b.com", None)]
