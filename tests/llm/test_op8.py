"""URL filters against brute force, by the trie and by the join."""

import random

import pytest
from galley.llm.op8_url_filters import RULES, filter_urls


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def judge(url, rules):
    host, path = split(url)
    fits = [(len(h.split(".")) if h else 0, len(p), v == "block", v, h + p) for v, h, p in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[4], best[3] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/a?q=/fr/#x", "http://www.example.com/en/", "http://wwwexample.com/en/", "http://a.b.net/es/1", "http://net/fr", "http://net/fr/",
    "http://a.net#/es/", "ftp://x.com:80/", "http://.com/", "http://a..com/x", "://com/", "http://Ünï.com/", "http://example.com/en/" + "x" * 50_000, "http://net/es/://com/",
]


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_equals_brute_force(spark, limit):
    r = random.Random(4)
    labels, parts = ["a", "b", "net", "com", "example", "www"], ["", "en", "fr", "es", "en-gb"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))
    path = lambda: "".join("/" + r.choice(parts) for _ in range(r.randint(0, 3)))
    rules = [*RULES, *((r.choice(["allow", "block"]), host(), path()) for _ in range(40)), ("block", "", "/en/fr"), ("allow", "com", "/en"), ("block", "com", "/en")]
    urls = [*URLS, *(f"http://{host()}{path()}{r.choice(['', '?x', '#y', '/'])}" for _ in range(300))]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(None, "http://com/", "", ""), (0, None, "", "")], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([*rules, rules[0]], "verdict string, host string, path string")
    got = filter_urls(pages, listed, max_broadcast=limit).collect()
    assert len(got) == len(urls) + 2
    want = {i: judge(u, rules) for i, u in enumerate(urls)} | {None: judge("http://com/", rules)}
    for x in got:
        assert (x.host, x.path, x.rule, x.verdict) == want[x.page_id], (urls[x.page_id or 0], x)


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://com/")], "page_id long, url string")
    for limit in (0, 5):
        assert [(x.rule, x.verdict) for x in filter_urls(pages, none, default="block", max_broadcast=limit).collect()] == [(None, "block")]
        assert filter_urls(pages.limit(0), none, max_broadcast=limit).count() == 0
