"""Given rules against a plain longest match; mined rules where tokens imply the label."""

import re

from arcloom.llm import urls

PAGE = "page_id bigint, url string"
URLS = [
    "http://a.com/x", "https://WWW.Example.COM/en/1?q=1#t", "http://m.example.com/en/2", "http://example.com/en", "http://b.net/es/",
    "http://b.net/fr/9?x", "http://xnet/es/", "net/es/", "http://com", "http://com/", "http://a.comx/", "ftp://u@a.com:80/y",
    "http://b.net#/es/", "a://b://c.com/d", "", None, "http://", "http://x.org/en/?a=1&b=2", "http://a.com/\n/en/",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, _ in urls.RULES:
        rh, rp = rule.split("/", 1)
        if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_longest_rule_wins(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (None, URLS[0]), (0, URLS[0])], PAGE)
    none = spark.createDataFrame([], "tokens array<string>, confidence double, n_blocked bigint")
    rows = urls.judge(pages, urls.rule_table(spark), none).collect()
    assert len(rows) == len(URLS) + 2
    said = dict(urls.RULES)
    for r in rows:
        want = plain(URLS[r.page_id or 0])
        assert (r.host, r.path, r.rule) == want
        assert r.verdict == said.get(r.rule, "allow")
    assert urls.judge(pages.limit(0), urls.rule_table(spark), none).count() == 0


def test_mined_combinations_block(spark):
    rows = [(f"http://h{i % 7}.org/{'ads' if i % 3 else 'en'}/{i}{'?track=1' if i % 2 else ''}", bool(i % 3 and i % 2)) for i in range(600)]
    rows += [(None, True), ("http://x.org/", None)]
    mined = urls.RuleMiner(support=0.05, at_least=20).mine(spark.createDataFrame(rows, "url string, blocked boolean"))
    found = {tuple(r.tokens) for r in mined.collect()}
    assert ("key:track", "path:ads") in found
    assert not any({"key:track", "path:ads"} < set(f) for f in found)
    pages = spark.createDataFrame([(1, "http://new.org/ads/5?track=9"), (2, "http://new.org/en/5?track=9"), (3, "http://new.com/ads/1?track=1")], PAGE)
    said = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, urls.rule_table(spark), mined).collect()}
    assert said == {1: (None, "block"), 2: (None, "allow"), 3: ("com/", "allow")}


def test_rules_where_most_pages_are_blocked(spark):
    rows = [(f"http://h{i % 5}.org/{'ads' if i % 5 < 3 else 'en'}/{i}", i % 5 < 3) for i in range(500)]
    mined = urls.RuleMiner().mine(spark.createDataFrame(rows, "url string, blocked boolean"))
    assert ("path:ads",) in {tuple(r.tokens) for r in mined.collect()}


def test_rules_of_a_rare_host(spark):
    rows = [(f"http://h{i % 5}.org/{i}", i % 50 == 0) for i in range(12_000)] + [(f"http://rare.org/{i}", True) for i in range(12)]
    mined = urls.RuleMiner().mine(spark.createDataFrame(rows, "url string, blocked boolean"))
    assert ("host=rare.org",) in {tuple(r.tokens) for r in mined.collect()}


def test_no_labels_no_rules(spark):
    labelled = spark.createDataFrame([("http://a.org/", False)], "url string, blocked boolean")
    assert urls.RuleMiner().mine(labelled).count() == 0
    assert urls.RuleMiner().mine(labelled.limit(0)).count() == 0
