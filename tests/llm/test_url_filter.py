import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliant.llm import url_filter

START = datetime(2024, 1, 1)
CAPTURES = "page_id long, url string, fetched_at timestamp, host string, pattern string"
ENTRIES = "pattern string, category string, action string, dated timestamp"


def test_hosts(spark):
    urls = ["http://A.b.C/x", "https://u:p@h.example.com:80/a?b#c", "ftp://x.y./", "no url", "", None, "http://", "HTTP://[2001:DB8::1]:8080/a", "http://u:p@q@z.org/", "http://10.0.0.1/"]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.host_of(F.col("u")).alias("h")).collect()]
    want = ["a.b.c", "h.example.com", "x.y", "", "", "", "", "[2001:db8::1]", "z.org", "10.0.0.1"]
    assert got == want
    import duckdb

    sql = "SELECT coalesce(regexp_replace(regexp_extract(lower(u), $1, 1), '\\.+$', ''), '') FROM (SELECT unnest($2) AS u)"
    assert [r[0] for r in duckdb.execute(sql, [url_filter.HOST, urls]).fetchall()] == want


def test_addresses_have_no_parent_domains(spark):
    captures = spark.createDataFrame([(1, "http://10.0.0.1/", START, "", ""), (2, "http://[::ffff:1.2.3.4]/", START, "", "")], CAPTURES)
    entries = spark.createDataFrame([("0.0.1", "spam", "add", START), ("3.4]", "spam", "add", START), ("10.0.0.1", "adult", "add", START)], ENTRIES)
    assert sorted((r.page_id, r.pattern) for r in url_filter.filter_urls(captures, entries).collect()) == [(1, "10.0.0.1"), (2, None)]


def test_repeated_captures_long_urls_and_clashing_columns(spark):
    rows = [("http://a.com/" + "x" * 50000, START, "k1", "k2", "k3")] * 3 + [("http://b.org/", START, None, None, None)]
    captures = spark.createDataFrame(rows, "url string, fetched_at timestamp, host_key string, every string, salt string")
    got = url_filter.filter_urls(captures, spark.createDataFrame([("a.com", "spam", "add", START)], ENTRIES))
    assert got.columns == [*captures.columns, "host", "blocked", "n_active", "pattern", "category", "listed_at"]
    assert sorted((r.blocked, str(r.host_key)) for r in got.collect()) == [(False, "None"), (True, "k1"), (True, "k1"), (True, "k1")]


def slow(captures, entries):
    out = {}
    for page, _, at, host in captures:
        active = []
        for p, c in {(p, c) for p, c, _, d in entries if p is not None and d is not None}:
            if host and (host == p or host.endswith("." + p)):
                past = sorted({(d, a) for q, k, a, d in entries if (q, k) == (p, c) and d is not None and at is not None and d <= at})
                if past and past[-1][1] == "add":
                    active.append((-len(p), -past[-1][0].timestamp(), c, p))
        out[page] = (bool(active), len(active), min(active)[3] if active else None, min(active)[2] if active else None)
    return out


def test_as_of_join_matches_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.net", "za.com"]
    day = lambda: START + timedelta(days=rng.randrange(40))
    entries = [(rng.choice(hosts[:5]), rng.choice(["spam", "adult"]), rng.choice(["add", "remove"]), day()) for _ in range(60)]
    entries += [(None, "spam", "add", START), ("b.org", "spam", "add", None)] + entries[:3]
    captures = [(i, f"http://{h}/p", day(), h) for i, h in enumerate(rng.choices(hosts, k=300))] + [(900, None, START, ""), (901, "http://a.com/", None, "a.com")]
    df = spark.createDataFrame([(i, u, t, "old", "old") for i, u, t, _ in captures], CAPTURES)
    got = url_filter.filter_urls(df, spark.createDataFrame(entries, ENTRIES))
    assert got.columns == ["page_id", "url", "fetched_at", "host", "blocked", "n_active", "pattern", "category", "listed_at"]
    assert {r.page_id: (r.blocked, r.n_active, r.pattern, r.category) for r in got.collect()} == slow(captures, entries)


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.com", START, "", "")], CAPTURES)
    entries = spark.createDataFrame([], ENTRIES)
    assert [r.blocked for r in url_filter.filter_urls(captures, entries).collect()] == [False]
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0
