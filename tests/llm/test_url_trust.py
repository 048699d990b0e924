"""Rules, and trust and distrust against a plain walk over the links."""

import random
from collections import defaultdict

import pytest

from pointweave.llm import url_trust as u

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def got(spark, pages, rules=RULES, **how):
    found = u.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, **how)
    return [tuple(r) for r in found.collect()]


CASES = [
    ("http://a.com/x", "a.com", "/x", "com/", "allow"),
    ("http://A.COM", "a.com", "", None, "allow"),  # no path that starts with a slash
    ("https://Blog.Example.com/en/1?x=/fr/#y", "blog.example.com", "/en/1", "example.com/en/", "block"),
    ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("ftp://net/es/x", "net", "/es/x", "net/es/", "block"),
    ("x://a.net?q=/es/", "a.net", "", None, "allow"),
    ("//a.com/x", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http:///com/", "", "/com/", None, "allow"),
    ("http://a.b://c.com/", "a.b:", "//c.com/", None, "allow"),
    ("http://x.com:80/", "x.com:80", "/", None, "allow"),
    ("http://É.com/É", "É.com", "/É", "com/", "allow"),
]


def test_rules(spark):
    pages = [(i, url, None) for i, (url, *_) in enumerate(CASES)]
    assert sorted(got(spark, pages)) == [(i, *want) for i, (_, *want) in enumerate(CASES)]


def test_host_of_many_labels(spark):
    host = "a." * 50_000 + "com"
    assert got(spark, [(1, f"http://{host}/", None)])[0][3:] == ("com/", "allow")


def walked(pages, rules, rounds):
    """Masses by a loop over dictionaries; pages (host, verdict of its rule, links)."""
    n, seen, links = defaultdict(int), defaultdict(lambda: defaultdict(int)), set()
    for host, verdict, to in pages:
        n[host] += 1
        seen[verdict][host] += 1
        links |= {(host, x) for x in to if x != host}
    out = {}
    for kind, verdict, pairs in (("trust", "allow", links), ("distrust", "block", {(b, a) for a, b in links})):
        degree, base = defaultdict(int), {h: (100 - u.DAMPING) * (u.UNIT * k // n[h]) // 100 for h, k in seen[verdict].items()}
        for a, _ in pairs:
            degree[a] += 1
        now = dict(base)
        for _ in range(rounds - 1):
            then = defaultdict(int, base)
            for a, b in pairs:
                if a in now:
                    then[b] += now[a] * u.DAMPING // (100 * degree[a])
            now = then
        out |= {(kind, h): m for h, m in now.items()}
    return out


@pytest.mark.parametrize("rounds", [1, 2, 50])
def test_masses_equal_a_plain_walk(spark, rounds):
    rng = random.Random(rounds)
    hosts = [f"h{i}.{'com' if i < 4 else 'net' if i < 8 else 'org'}" for i in range(20)]
    pages, plain = [], []
    for i in range(150):
        host, to = rng.choice(hosts), [rng.choice(hosts) for _ in range(rng.randrange(4))]
        lang = rng.choice(["/en/", "/es/"])
        verdict = "allow" if host.endswith("com") else "block" if host.endswith("net") and lang == "/es/" else None
        pages.append((i, f"https://{host}{lang}{i}", "".join(rng.choice([f'<a href="http://{x}/1">', f"<A class=x HREF='//{x.upper()}?q'>", f"<a href=https://{x}>"]) for x in to) + '<a href="/own">'))
        plain.append((host, verdict, to))
    found = u.ruled(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES)
    masses = u.propagated(u.host_seeds(found), u.host_edges(found), rounds)
    assert {(r.kind, r.host): r.mass for r in masses.collect() if r.mass} == {k: m for k, m in walked(plain, RULES, rounds).items() if m}


def test_links_decide_where_no_rule_does(spark):
    """A host that links to blocked ones falls; a link from a trusted host, or nothing, keeps a host."""
    bad = [(i, f"http://bad{i}.net/es/", None) for i in range(5)]
    pages = bad + [
        (10, "http://farm.org/1", "".join(f'<a href="http://bad{i}.net/">' for i in range(5))),
        (11, "http://linked.org/", '<a href="http://farm.org/">'),
        (12, "http://quiet.org/", '<a href="/bad0.net/es/">'),
        (13, "http://good.com/", '<a href="http://quiet.org/">'),
        (14, "http://bad0.net/en/", None),
    ]
    verdict = {r[0]: r[4] for r in got(spark, pages)}
    assert verdict == {0: "block", 1: "block", 2: "block", 3: "block", 4: "block", 10: "block", 11: "block", 12: "allow", 13: "allow", 14: "block"}
    forgiven = pages + [(20 + i, f"http://friend{i}.com/", '<a href="http://farm.org/">') for i in range(20)]
    assert {r[0]: r[4] for r in got(spark, forgiven)}[10] == "allow"


def test_whole_host_at_one_half(spark):
    half = [(1, "http://a.net/es/", None), (2, "http://a.net/en/", None), (3, "http://b.net/es/", None), (4, "http://b.net/en/", None), (5, "http://b.net/de/", None)]
    assert {r[0]: r[4] for r in got(spark, half)} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_empty_repeated_and_more_columns(spark):
    assert got(spark, []) == []
    rows = [(None, "http://a.com/", None, "x", 1), (7, "http://a.net/es/", "<a href=", "y", 2), (7, "http://a.net/es/", "<a href=", "y", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, mass long")
    assert sorted(r.verdict for r in u.filter_urls(pages, RULES).collect()) == ["allow", "block", "block"]
    assert len(got(spark, [(1, "http://a.com/", None)], rules=[])) == 1


def test_long_page(spark):
    html = "<p>href = x " * 200_000 + '<a href="http://bad.net/x">'
    assert {r[0]: r[4] for r in got(spark, [(1, "http://a.org/", html), (2, "http://bad.net/fr/", None)])} == {1: "block", 2: "block"}
