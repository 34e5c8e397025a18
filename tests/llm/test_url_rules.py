import random
import re

from jobsieve.llm import url_rules


def brute(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def check(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, stack string").repartition(5)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, rules), default).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == brute(u, rules, default), u


def test_odd_urls(spark):
    urls = ["https://www.Example.com/en/x?a=/b", "http://example.com/en/", "http://example.com/en", "http://notexample.com/en/", "http://example.com", "http://com/",
            "http://a.net/es/1#x", "http://a.net/de/", "HTTP://a.NET?x/fr/", None, "", "no scheme", "://", "a://b://c.com/en/", "http://..com/", "http://é.com/ü/", "http://x.com:80/",
            "http://a.net/fr/" + "p" * 100_000, "http://exa\nmple.com/en/"] + ["https://b.net/fr/9"] * 400
    check(spark, urls, url_rules.RULES)


def test_random_nested_rules(spark):
    rng = random.Random(4)
    labels, parts = ["a", "b", "ab", "c-d"], ["/", "a", "b/", "é", "/a"]
    host = lambda n: ".".join(rng.choices(labels, k=n))
    path = lambda n: "".join(rng.choices(parts, k=n))
    rules = list({(host(rng.randrange(1, 5)) if rng.random() < 0.95 else "", path(rng.randrange(4))): None for _ in range(250)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"s://{host(rng.randrange(1, 7))}{rng.choice(['', '/'])}{path(rng.randrange(6))}" for _ in range(600)]
    check(spark, urls, rules, "block")


def test_rules_of_one_key_and_no_rules(spark):
    rules = [("a.com", "/", "allow"), ("A.com", "/", "block"), ("b.com", None, "block")]
    pages = spark.createDataFrame([(1, "x://a.com/"), (2, "x://c.b.com")], "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()}
    assert got == {1: ("a.com/", "block"), 2: ("b.com", "block")}
    none = url_rules.rule_table(spark, [])
    assert {(r.rule, r.verdict) for r in url_rules.judge_urls(pages, none).collect()} == {(None, "allow")}
    assert url_rules.judge_urls(pages.limit(0), url_rules.rule_table(spark, rules)).count() == 0
