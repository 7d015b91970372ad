"""URL filters: parsing and rules by hand, reputations by the closed form, and the SQL over tables of edge cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from datagauge.llm import hostrep

PAGES = "page_id long, url string, html string, host string, key int"


def judged(spark, urls, labels, **kw):
    pages = spark.createDataFrame([(i, u, "<p>", "clash", 1) for i, u in enumerate(urls)], PAGES)
    outcomes = hostrep.labelled(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    number = F.regexp_extract("path", "/([0-9]+)", 1).try_cast("bigint")
    return {r["page_id"]: r for r in hostrep.judge(pages, outcomes, number, **kw).collect()}


def test_urls_and_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme/x": ("", "", None), "http://": ("", "", None),
        "HTTP://WWW.Example.NET/EN/1": ("www.example.net", "/EN/1", "net/"),
        "x://a.example.net/en/1?q=/de/#/f": ("a.example.net", "/en/1", "example.net/en/"),
        "x://example.net/en/": ("example.net", "/en/", "example.net/en/"),
        "x://example.net/en": ("example.net", "/en", "net/"),
        "x://badexample.com/de/1": ("badexample.com", "/de/1", None),
        "x://b.example.com/de/1": ("b.example.com", "/de/1", "example.com/de/"),
        "x://net": ("net", "", None), "x://net/": ("net", "/", "net/"), "x://a.net?x": ("a.net", "", None),
        "x://ÄB.org/fr/ü\n#": ("Äb.org", "/fr/ü\n", "org/fr/"),
        "x://a.org:80/fr/1": ("a.org:80", "/fr/1", None),
        "x://y://z.net/": ("y:", "//z.net/", None),
        "x://a.net/" + "p" * 200_000: ("a.net", "/" + "p" * 200_000, "net/"),
    }
    got = judged(spark, list(cases), [])
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(cases))] == list(cases.values())
    verdict = {"net/": "block", "example.com/de/": "block", None: "allow"}
    assert all(r["verdict"] == verdict.get(r["rule"], "allow") and r["outcomes"] == 0 for r in got.values())


def test_equal_rules_take_the_longer_host(spark):
    rules = [("allow", "net", "/abc/"), ("block", "x.net", "/ab"), ("allow", "y.net", "/"), ("block", "y.net", "/")]
    got = judged(spark, ["h://x.net/abc/1", "h://y.net/z"], [], rules=rules)
    assert [got[i]["rule"] for i in (0, 1)] == ["x.net/ab", "y.net/"] and got[1]["verdict"] == "block"


def test_registered_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "a.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "local": ("local", "local"), "": ("", ""), "a.b.org:8080": ("b.org", "org")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: (r["d"], r["s"]) for r in df.select("host", *(c.alias(n) for c, n in zip(hostrep.registered(F.col("host")), "ds", strict=True))).collect()} == hosts


@pytest.mark.parametrize("bad_hosts", [0, 6])
def test_reputations_and_sql(spark, bad_hosts):
    """A host of bad pages is blocked, its siblings and hosts with few outcomes are not; the SQL gives the same rows."""
    rng = random.Random(bad_hosts)
    hosts = [f"h{i}.d{i % 7}.{'com' if i % 3 else 'co.uk'}" for i in range(40)]
    urls, labels = [], []
    for i in range(1500):
        host = hosts[min(int(rng.expovariate(0.1)), 39)]
        bad = rng.random() < (0.95 if hosts.index(host) < bad_hosts else 0.1)
        urls.append(f"https://{host.upper() if i % 5 else host}/p/{i}?x=1" if i % 11 else None)
        if i % 4:
            labels.append((i, int(not bad), None if i % 3 else int(bad)))
    labels += [(None, 0, 1), (10**17, 0, 1), (3, None, None), (5, 1, 0)]
    urls += ["http://h39.d4.com/" + "9" * 30, "http://few.d1.com/1", "http://10.1.1.1/2", "http://h0.d0.co.uk:81/3"]
    got = judged(spark, urls, labels)
    assert len(got) == len(urls)
    blocked = {r["host"] for r in got.values() if r["verdict"] == "block" and r["rule"] is None}
    assert blocked == set(hosts[:bad_hosts])
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id bigint, url varchar)")
    c.execute("CREATE TABLE labels (doc_id bigint, quality int, toxic int)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    c.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    rel = c.sql(hostrep.SQL)
    for row in rel.fetchall():
        want = dict(zip(rel.columns, row, strict=True))
        r = got[want["page_id"]].asDict()
        assert all(abs(r.pop(k) - want.pop(k)) < 2e-6 for k in ("bad_rate", "bad_bound")) and r == want


def test_empty_and_repeated(spark):
    assert judged(spark, [], [(1, 1, 1)]) == {}
    pages = spark.createDataFrame([(1, "a://b.c/1"), (1, "a://b.c/1"), (None, None), (None, None)], "page_id long, url string")
    outcomes = hostrep.labelled(spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int"))
    got = hostrep.judge(pages, outcomes, F.regexp_extract("path", "/([0-9]+)", 1)).collect()
    assert sorted((r["page_id"] or 0, r["host"], r["outcomes"]) for r in got) == [(0, "", 0), (0, "", 0), (1, "b.c", 2), (1, "b.c", 2)]
