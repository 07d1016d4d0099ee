"""URL rules against a brute-force judge: nested rules, subdomains, ties, repeats, many rules, hot hosts and empty tables."""

import random
from collections import Counter

import pytest

from sextant.llm import urls

PAGES = "page_id long, url string, rule string"
RULES = "host string, path string, verdict string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host = rest.split("/", 1)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, rest[len(host) :]


def wanted(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if h and p is not None and v and (p == "" or p[0] == "/") and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def check(spark, pages, rules):
    frame = spark.createDataFrame([(*row, "r") for row in pages], PAGES)
    got = urls.judge(frame, spark.createDataFrame(rules, RULES))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter((i, u, *wanted(u, rules)) for i, u in pages)


def test_cases(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("com", "", "allow"), (None, "/", "block"), ("org", None, "block"), ("net", "x", "block"), ("b.com", "/", "block"), ("b.com", "/", "allow"), ("b.com", "/", "block"), ("", "/", "block")]
    pages = [(1, "http://a.EXAMPLE.com/en/77?x"), (2, "https://b.com/en/"), (3, None), (4, "no"), (5, "http://notcom/en/"), (None, "http://com"), (7, "http:///en/"), (8, "x://a..com./en/7#y"), (8, "x://a..com./en/7#y"), (9, "http://é.com/" + "é" * 5000), (10, "http://com/\U0010ffffz"), (11, "://net.x/"), (12, "")]
    check(spark, pages, rules)
    check(spark, pages, [])
    check(spark, [], rules)


@pytest.mark.parametrize("partitions", [1, 7])
def test_many_nested_rules_and_a_hot_host(spark, partitions):
    rng = random.Random(partitions)
    label = lambda: rng.choice("abc")
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 3)))
    path = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 5)))
    rules = [(host(), path() if rng.random() < 0.9 else "", rng.choice(["allow", "block"])) for _ in range(600)]
    pages = [(i, f"http://{host() if i % 3 else 'hot.a.b'}{path()}") for i in range(900)] + [(i, "http://hot.a.b/ab/a") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        check(spark, pages, rules)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
