import random

from rotativa.llm import url_rules
from rotativa.llm.registry import URL_RULES


def brute(host, path, rules):
    fits = []
    for verdict, rule in rules:
        rule_host, rule_path = url_rules.split_rule(rule)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            fits.append((len(rule_host), len(rule_path), verdict == "block", rule, verdict))
    return max(fits)[3:] if fits else (None, "allow")


def test_trie_and_join_match_brute_force(spark):
    r = random.Random(2)
    part = lambda: r.choice(["a", "b", "ab", ""])
    host = lambda: ".".join(r.choice(["a", "b", "ab"]) for _ in range(r.randint(1, 3)))
    rules = [(r.choice(["allow", "block"]), host() + r.choice(["", "/"]) + "/".join(part() for _ in range(r.randint(0, 3)))) for _ in range(60)]
    rules += [("allow", "a.b/a/"), ("block", "a.b/a/")]
    urls = [f"http://{host()}/{'/'.join(part() for _ in range(r.randint(0, 4)))}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    found = url_rules.judge_urls(pages, rules).collect()
    assert [(x["rule"], x["verdict"]) for x in found] == [brute(x["host"], x["path"], rules) for x in found]
    joined = url_rules.judge_by_join(pages, spark.createDataFrame(rules, "verdict string, rule string"))
    assert sorted(joined.select(found[0].__fields__).collect(), key=str) == sorted(found, key=str)


def test_odd_urls(spark):
    rows = [
        (1, None, "h"), (2, "", None), (3, "no scheme/x", "h"), (4, "HTTP://A.NET", None), (5, "x://A.NET/", "h"),
        (6, "http://b.example.net/en/x?://z", "h"), (7, "http://example.net/EN/", "h"), (8, "http://É.ORG/fr/#a", "h"),
        (9, "a://b://c.net/", "h"), (None, "http://fakeexample.com/de/", "h"), (10, "http://m.example.com/de/\nq", "h"), (10, "http://m.example.com/de/\nq", "h"),
        (11, "http://x." + "long." * 3000 + "net/" + "p/" * 3000, "h"),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, host string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, URL_RULES).collect()}
    nothing = (None, "allow")
    assert found == {
        1: nothing, 2: nothing, 3: nothing, 4: nothing, 5: ("net/", "block"), 6: ("example.net/en/", "allow"), 7: ("net/", "block"),
        8: ("org/fr/", "allow"), 9: nothing, None: nothing, 10: ("example.com/de/", "block"), 11: ("net/", "block"),
    }


def test_too_many_rules_are_refused(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(url_rules, "MAX_RULES", 2)
    with pytest.raises(ValueError):
        url_rules.judge_urls(spark.createDataFrame([(1, "a://b/")], "page_id int, url string"), URL_RULES)


def test_empty(spark):
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id int, url string"), URL_RULES).count() == 0
