"""URL rules against a plain loop over all rules."""

import random

import pytest
from cases import rows

from tallyframe.llm import queries, url_rules

RULES = "host string, path string, verdict string"
URLS = [
    "http://example.com/en/x", "https://www.EXAMPLE.com/en/", "https://a.www.example.com/en/1?x=/en/", "http://example.com", "http://example.com?/en/",
    "http://example.com#/", "http://notexample.com/en/", "//example.com/en/", "example.com/en/", "", None, "x://", "a://b://example.com/en/",
    "http://é.example.com/en/ü", "http://net/es/", "http://m.net/fr", "http://m.net/fr/\nx", "\nhttp://net/es/a\n#b", "http://.com/", "http://com/",
    "http://com./", "http://" + "a." * 30000 + "com/en/", "http://example.com/en/" + "y" * 200_000, "http://example.com/en/x",
]


def plain(url, given):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len((h + p).encode()), len(h.encode()), v == "block", h + p) for h, p, v in given
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, False, None))
    return host, path, best[3], "block" if best[2] else "allow"


def found(spark, urls, given, mask=-1):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as hit", "'y' as Host", "'z' as rule_host")
    index = url_rules.build(spark.createDataFrame(given, RULES), mask)
    return rows(url_rules.judged(pages, index, mask=mask).select("page_id", "host", "path", "rule", "verdict"))


def want(urls, given):
    return sorted(((i, *plain(u, given)) for i, u in enumerate(urls)), key=str)


def test_hard_urls(spark):
    assert found(spark, URLS, queries.URL_RULES) == want(URLS, queries.URL_RULES)


@pytest.mark.parametrize(("mask", "segment"), [(-1, 1 << 30), (-1, 40), (7, 1 << 30), (0, 50)])
def test_many_rules(spark, mask, segment, monkeypatch):
    """One segment and several; few keys, so that most hits collide; hot hosts."""
    monkeypatch.setattr(url_rules, "SEGMENT_ROWS", segment)
    rng = random.Random(mask + segment)
    names = ["a", "b", "ab", "é", "com", "net"]
    host = lambda: ".".join(rng.choice(names) for _ in range(rng.randint(1, 3)))
    path = lambda: "".join("/" + rng.choice(names) for _ in range(rng.randint(0, 3)))
    given = [("com" if rng.random() < 0.4 else host(), path(), rng.choice(["allow", "block"])) for _ in range(150)]
    urls = [f"http://{host()}{path()}{rng.choice(['', '/', '?q', '#f/a'])}" for _ in range(400)]
    assert found(spark, urls, given, mask) == want(urls, given)


def test_rules_with_nulls_and_repeats(spark):
    given = [("COM", None, "allow"), ("com", "", "block"), (None, "/", "block"), ("", "/", "block"), ("net", "/", None)]
    assert found(spark, ["http://a.com/x", "http://net/"], given) == [(0, "a.com", "/x", "com", "block"), (1, "net", "/", None, "allow")]


def test_empty_tables(spark):
    assert found(spark, ["http://a.com/"], []) == [(0, "a.com", "/", None, "allow")]
    assert rows(url_rules.judged(spark.createDataFrame([], "page_id long, url string"), url_rules.build(spark.createDataFrame(queries.URL_RULES, RULES)))) == []


def test_files_that_no_folder_mounts(spark):
    """Executors get the files from Spark."""
    index = url_rules.build(spark.createDataFrame(queries.URL_RULES, RULES))
    for _, name in index.hosts + index.rules:
        for c in url_rules._COLUMNS:
            spark.sparkContext.addFile(f"{index.folder}/{name}.{c}")
    fetched = url_rules.Index("none://gone", False, index.hosts, index.rules)
    pages = spark.createDataFrame([(1, "http://example.com/en/")], "page_id long, url string")
    assert [r["verdict"] for r in url_rules.judged(pages, fetched).collect()] == ["block"]


def test_keys_are_those_of_spark(spark):
    texts = ["", "com", "é/ü", "x" * 100]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t)").collect()]
    assert got == url_rules._keyed([t.encode() for t in texts]).tolist()
