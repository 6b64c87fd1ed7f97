"""URL filters against SQL and against a plain scan of the rules."""

import random

from cuelight.llm import queries, url_filter

from .against_sql import same_rows


def test_against_sql(spark):
    same_rows(spark, "/root/testdata/sf0.01", queries.op3_url_filter, queries.OP3_SQL)


def _judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda r: (len(r[0]), r[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_against_scan(spark):
    rng = random.Random(3)
    rules = [(".".join(rng.choice("ab") for _ in range(rng.randint(1, 3))), "/" + "x" * rng.randint(0, 3), rng.choice(["allow", "block"])) for _ in range(40)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = ["ht://" + ".".join(rng.choice("abAB") for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "/xx", "/xxxy?q=/", "#/x", "?a"]) for _ in range(300)]
    urls += [None, "", "no scheme", "a://b://c/x", "://a/", "http://É.a/x", "http://a./", "x\ny://a/xx\nz", "http://" + "a." * 3000 + "b/" + "x" * 50000]
    rows = [(i if i % 7 else None, u, "extra") for i, u in enumerate(urls)] + [(3, urls[3], "again")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = url_filter.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = [(r[0], *_judge(r[1], rules)) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in url_filter.filter_urls(pages, rules.limit(0)).collect()] == [(1, "a.com", "/", None, "allow")]


def test_filter_lets_through_what_is_listed(spark):
    listed = spark.range(5000).selectExpr("concat('h', id, '/') as listing")
    probes = spark.range(20000).selectExpr("concat('h', id, '/') as listing")
    hits = {r[0] for r in url_filter.possible_hits(probes, listed, 5000).collect()}
    assert {f"h{i}/" for i in range(5000)} <= hits
    assert len(hits) < 5000 + 0.05 * 15000


def test_very_long_hosts(spark):
    """A host of 30,000 parts is matched by its last parts alone; rows without a host keep their places."""
    rules = spark.createDataFrame([("com", "/", "block"), ("a.com", "/x", "allow")], "host string, path string, verdict string")
    urls = [(1, "http://" + "a." * 30000 + "com/x"), (2, "http://" + "b." * 30000 + "com/x"), (3, None), (3, None), (4, "no host")]
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect())
    assert got == [(1, "a.com/x", "allow"), (2, "com/", "block"), (3, None, "allow"), (3, None, "allow"), (4, None, "allow")]
