from __future__ import annotations

import random

import pytest

from kartoteka.llm import urls


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:at])
    path = rest[at:].split("?")[0].split("#")[0]
    fits = [(len(h + p), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, False, None, urls.DEFAULT))
    return host, path, best[2], best[3]


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("a.com", "/", "block"), ("a.com", "/fr/", "block"), ("b.a.com", "/fr/x", "allow")]
HOSTS = ["org", "example.org", "EXAMPLE.org", "xexample.org", "w.example.org", "a.com", "b.a.com", "c.b.a.com", "com", "", "a..com", "com.a", "org-x", "ÉX.com"]
PATHS = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/y", "/en/2#f", "/fr/", "/fr/x", "?q=/fr/", "#/fr/", "/de/a\nb"]


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_sweep_matches_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(urls, "MIN_RANGES", ranges)
    rng = random.Random(3)
    found = [f"{rng.choice(['http', 'ftp', ''])}://{rng.choice(HOSTS)}{rng.choice(PATHS)}" for _ in range(400)]
    found += [None, "", "no scheme", "http://a.com/fr/"] + ["http://w.example.org/es/1"] * 200
    pages = spark.createDataFrame([(i if i % 9 else None, u, "h", "r") for i, u in enumerate(found)],
                                  "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "/", "block"), ("x", None, "block")], "host string, path string, action string")
    rows = urls.judge_urls(pages, rules).collect()
    expected = sorted(map(repr, [(i if i % 9 else None, *brute(u, RULES)) for i, u in enumerate(found)]))
    assert sorted(repr(tuple(r)) for r in rows) == expected


def test_empty_sides(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, action string")
    assert [tuple(r) for r in urls.judge_urls(pages, rules).collect()] == [(1, "a.org", "/x", None, urls.DEFAULT)]
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
