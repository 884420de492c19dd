import random

import pytest

from driftrank.llm.queries import URL_RULES
from driftrank.llm.url_filter import Trie, url_filter

URLS = ["http://example.org/es/1", "https://A.B.Example.ORG/en/148?x#y", "http://example.org", "http://example.org/", "x.com/fr/",
        "http://x.com/fr/?q", "http://com/de/", "http://xcom/de/", None, "", "://", "http://", "https://x.org:80/es/", "a://b://c/d",
        "http://example.org?a/es/", "http://www.example.org/es/\n2", "http://.org/", "http://a..com/fr/x", "HTTP://É.COM/de/É"]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[n:]
    m = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), path[:m]


def brute(url, rules):
    host, path = split(url)
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (r[0].count("."), len(r[1]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("max_rules", [1000, 3])
def test_equals_brute_force(spark, max_rules):
    rng = random.Random(1)
    hosts = ["org", "a.org", "b.a.org", "com", "x.com", "example.org"]
    paths = ["/", "/a", "/a/", "/a/b", "/ab", "/a/bc/", "/en/1", ""]
    rules = URL_RULES + [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)]
    urls = URLS + [f"http://{rng.choice(['', 'q.', 'b.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'a', '/bc/d', '1'])}"
                   for _ in range(300)]
    urls = [u for u in urls if u is None or not split(u)[0].startswith(".") and ".." not in split(u)[0]]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    for r in url_filter(df, rules, max_rules=max_rules).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]], rules), urls[r["page_id"]]


def test_odd_hosts_empty_tables_and_no_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    assert url_filter(df, URL_RULES).count() == len(URLS)
    assert url_filter(df.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter(df, []).collect()} == {"allow"}


def test_very_long_segments_and_repeated_pages(spark):
    import time
    rules = [("org", "/", "allow"), ("example.org", "/en/1", "block"), ("example.org", "/en/12345", "allow"), ("example.org", "/en/9", "block")]
    trie = Trie(rules)
    long = "x" * 200_000
    start = time.perf_counter()
    assert trie.find("a.example.org", "/en/" + long) == rules[0]
    assert trie.find("a.example.org", "/en/1" + long) == rules[1] and trie.find("example.org", "/en/12345" + long) == rules[2]
    assert trie.find("example.org", "/en/" + "9/" * 100_000) == rules[3]
    assert time.perf_counter() - start < 0.2
    rows = [(1, f"http://example.org/en/1{long}"), (1, f"http://example.org/en/1{long}"), (1, None)]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert [(r["page_id"], r["rule"]) for r in got] == [(1, "example.org/en/1")] * 2 + [(1, None)]
