from __future__ import annotations

import random
import re

import pytest

from evigraph.llm import urls as U
from evigraph.llm.queries import URL_RULES


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return ("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in m[1]), m[2]) if m else ("", "")


def plain(url, rules):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


URLS = [
    None, "", "example.com/en/", "https://example.com/en/", "https://EXAMPLE.com/en/x", "http://www.example.com/en/1?u=://net/es/", "https://m.www.example.com/en/", "https://m.example.com/en/2#/fr/",
    "https://notexample.com/en/", "https://com", "https://com?x=/", "https://com/", "http://net/es/", "http://a.net/es", "http://a.net/fr/ü", "ftp://x.org/en/", "://net/fr/", "a://b://net/es/",
    "https://user@example.com:80/en/", "https://example.com./en/", "https://É.Com/\n/en", "http://" + "a." * 50_000 + "net/fr/", "https://x.com/" + "en/" * 100_000,
]


def test_rows(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS + URLS[:5])], "page_id long, url string, host string, verdict int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.url_filter(pages, rules).collect()}
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(URLS + URLS[:5])}
    assert U.url_filter(pages.limit(0), rules).count() == 0
    empty = U.url_filter(pages, rules.limit(0), default="block").collect()
    assert len(empty) == len(URLS) + 5 and {(r.rule, r.verdict) for r in empty} == {(None, "block")}


@pytest.mark.parametrize("bits", [64, 5])
def test_many_rules_collisions_and_files(spark, bits):
    rng = random.Random(3)
    labels, dirs = ["a", "b", "cc", "d-d"], ["x", "y", "zz"]
    name = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 3)))
    place = lambda: rng.choice(["", "/", "/" + "/".join(rng.choice(dirs) for _ in range(rng.randint(1, 3)))])
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((name(), place()) for _ in range(300))}.values())
    odd = [(None, "/", "block"), ("a", None, "block"), ("a", "x", "block"), ("a", "/", None)]
    # of two verdicts of one rule, block counts
    arrays = U.rule_arrays(spark.createDataFrame(rules + odd + [("b", "/both", "allow"), ("b", "/both", "block")], "host string, path string, verdict string"), bits=bits, file_names=40)
    assert len(arrays.rules.files) > 1
    rules.append(("b", "/both", "block"))
    rules = [r for r in rules if r[:2] != ("b", "/both")] + [("b", "/both", "block")]
    urls = [f"http://{name()}.{name()}{place()}/{rng.choice(dirs)}" for _ in range(800)] + ["http://q.b/both"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.url_filter(pages, arrays).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}
    assert sum(r[2] is not None for r in got.values()) > 100
