"""URL rules against a scan over all rules."""

import random

from plenum.llm.urlrules import judge_urls

RULES = "host string, path string, verdict string"
PAGES = "page_id long, url string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules):
    host, path = split(url)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def check(spark, pages, rules, **options):
    got = judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, RULES), **options)
    assert sorted([tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()], key=repr) == sorted(
        [(i, *brute(u, [r for r in rules if None not in r])) for i, u in pages], key=repr
    )


def test_nested_rules(spark):
    rng = random.Random(5)
    label = lambda: rng.choice("abc")
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + label() for _ in range(rng.randint(0, 4))) + rng.choice(["", "/"])
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path() or "/") for _ in range(60))}.values())
    pages = [(i, f"http://{host()}{path()}{rng.choice(['', '?q=/a', '#x', '?a#b'])}") for i in range(400)]
    check(spark, pages, rules)
    check(spark, pages, rules, ranges=40)


def test_odd_urls(spark):
    rules = [("com", "/", "block"), ("example.com", "/é", "allow"), (None, "/", "block"), ("x", None, "block")]
    pages = [(1, None), (2, ""), (3, "no scheme.com/"), (4, "http://"), (5, "HTTP://WWW.Example.COM/É"), (6, "http://example.com/é?x"), (7, "http://com"), (8, "http://com/" + "a/" * 50_000), (9, "a://b://com/"), (None, "http://a.com/"), (4, "http://")]
    check(spark, pages, rules)
    check(spark, [(i, "http://hot.com/") for i in range(50)], rules)


def test_empty_tables_and_clashing_columns(spark):
    check(spark, [], [("com", "/", "block")])
    check(spark, [(1, "http://a.com/")], [])
    odd = spark.createDataFrame([(1, "http://a.com/", "h", 3, "v", "k")], "page_id long, url string, host string, rule int, verdict string, key string")
    (row,) = judge_urls(odd, spark.createDataFrame([("com", "/", "block"), ("com", "/", "allow")], RULES)).collect()
    assert (row.host, row.path, row.rule, row.verdict, row.key) == ("a.com", "/", "com/", "block", "k")


def test_home_pages_of_one_domain_ask_once(spark, monkeypatch):
    """The sweep holds a key once, however many hosts ask for it."""
    from plenum.llm import urlrules

    seen, write = {}, urlrules.materialize
    monkeypatch.setattr(urlrules, "materialize", lambda df, name: seen.setdefault(name, write(df, name)))
    urls = spark.range(400).selectExpr("id AS page_id", "concat('http://h', id, '.com/') AS url")
    rules = spark.createDataFrame([("com", "/", "block"), ("h7.com", "/", "allow")], "host string, path string, verdict string")
    out = urlrules.judge_urls(urls, rules, ranges=4)
    assert {r.page_id for r in out.where("verdict = 'allow'").collect()} == {7} and out.where("rule = 'com/'").count() == 399
