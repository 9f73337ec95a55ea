from __future__ import annotations

import random

from ledgerlens.llm import urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a-b.net", "/", "block"), ("b.net", "/es/x", "allow")]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        rest = rest[n:]
        path = rest[: min([len(rest), *(rest.find(c) for c in "?#" if c in rest)])]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best[2] if best else default


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "WWW.example.com", "x.www.example.com", "notexample.com", "net", "a-b.net", "q.a-b.net", "b.net", "a.b.net", "org", "", ".com", "example.com:80", "example.com."]
    paths = ["", "/", "/en/", "/en", "/en/x?y=/es/", "/es/", "/es/xy#z", "?/en/", "#", "/EN/"]
    rows = [(i, f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "no scheme"), (1003, "a://b://c/en/"), (1004, "http://é.com/ü\nx")] + [(2000 + i, "http://example.com/en/a") for i in range(300)]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([(i, u, "keep") for i, u in rows], "page_id long, url string, rule string")
    for ranges in (1, 7):
        got = {r["page_id"]: r for r in urls.judge_urls(df, rules, ranges=ranges).collect()}
        assert len(got) == len(rows)
        for i, u in rows:
            assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == brute(u, RULES), u


def test_empty_tables_and_no_rules(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge_urls(df, none, default="block").collect()] == ["block"]
    assert urls.judge_urls(df.limit(0), none).count() == 0
