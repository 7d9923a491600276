"""Pacing of crawls: due times against a token bucket that is stepped through, budgets, the fetcher's waits."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.urls import Scope
from lakeloom.operators import crawl
from lakeloom.operators.crawl import Bucket, Pace


def stepped(rounds, pace):
    """The same by hand: a bucket of `burst` tokens that gets one every interval. Times are whole intervals' parts."""
    start, free, asked, due = 0, {}, defaultdict(int), {}
    for frontier in rounds:
        last = start
        for u in sorted(frontier):
            h = u.split("/")[2]
            if pace.most is not None and asked[h] >= pace.most:
                due[u] = None
                continue
            level_free = max(free.get(h, start), start)
            at = max(start, level_free - (pace.burst - 1) * pace.interval)
            free[h], asked[h], due[u] = level_free + pace.interval, asked[h] + 1, at
            last = max(last, at)
        start = last
    return due


@pytest.mark.parametrize("pace", [Pace(100, 1), Pace(100, 3), Pace(70, 2, most=5), Pace(10, 4, most=1), Pace(10, 1, most=0)])
def test_due_times(spark, pace):
    rounds = [[f"http://h{i % 3}.x.com/{i}" for i in range(14)], [f"http://h{i % 2}.x.com/b{i}" for i in range(5)], [], ["http://h2.x.com/z", "http://h9.x.com/z"]]
    start, hosts, got = 0, spark.createDataFrame([], crawl.HOSTS), {}
    for frontier in rounds:
        plan, hosts = crawl.paced(spark.createDataFrame([(u,) for u in frontier], "url string"), hosts, start, pace)
        rows = plan.collect()
        got |= {r["url"]: r["due"] for r in rows}
        start = max([start] + [r["due"] for r in rows if r["due"] is not None])
    assert got == stepped(rounds, pace)
    times = defaultdict(list)
    for u, t in got.items():
        if t is not None:
            times[u.split("/")[2]].append(t)
    for ts in times.values():
        ts.sort()
        assert pace.most is None or len(ts) <= pace.most
        # No stretch of time holds more than burst, and one for each interval.
        assert all(j - i + 1 <= pace.burst + (ts[j] - ts[i]) // pace.interval for i in range(len(ts)) for j in range(i, len(ts)))


def test_one_host_is_numbered_over_many_tasks(spark):
    df = spark.range(3000).select(F.lit("hot").alias("host"), F.format_string("http://hot/%05d", "id").alias("url")).unionByName(spark.createDataFrame([("a", "http://a/1"), (None, "x")], "host string, url string"))
    got = crawl.ranked(df).withColumn("p", F.spark_partition_id()).collect()
    hot = sorted((r["url"], r["i"]) for r in got if r["host"] == "hot")
    assert [i for _, i in hot] == list(range(3000)) and [r["i"] for r in got if r["host"] == "a"] == [0]


def test_crawl_with_a_pace(spark):
    site = spark.createDataFrame([("http://s.example.com/", '<a href="/a">a</a><a href="/b">b</a><a href="http://o.example.com/x">o</a>'), ("http://s.example.com/a", '<a href="/c">c</a>'), ("http://o.example.com/x", "")], "url string, html string")
    done = crawl.crawl(site.limit(1), crawl.from_table(site), Scope("example.com", 0, blacklist=[]), max_depth=3, pace=Pace(100, 1, most=3)).collect()
    got = {r["url"]: (r["depth"], r["due"], r["error"]) for r in done}
    assert got["http://s.example.com/"] == (0, 0, None) and got["http://s.example.com/a"] == (1, 100, None)
    assert got["http://s.example.com/b"][:2] == (1, 200) and got["http://o.example.com/x"] == (1, 0, None)
    assert got["http://s.example.com/c"] == (2, None, crawl.NO_HOST_BUDGET)


def test_bucket_waits_by_its_own_clock():
    now, sent = [0.0], []

    def sleep(s):
        now[0] += s

    b = Bucket(Pace(1000, 2), clock=lambda: now[0], sleep=sleep)
    for host, wait, takes in [("a", 0, 0), ("a", 0, 5), ("a", 1000, 0), ("a", 2000, 0), ("b", 0, 0), ("a", 3000, 0)]:
        b.take(host, wait)
        sent.append((host, round(now[0], 3)))
        now[0] += takes
    assert sent == [("a", 0), ("a", 0), ("a", 5), ("a", 5), ("b", 5), ("a", 6)]


def test_fetcher_keeps_the_pace(spark):
    import time

    fetch = crawl.from_function(lambda url: (f"{time.monotonic()}", 200, None), partitions=2, pace=Pace(150, 1))
    rows = spark.createDataFrame([(f"http://h{i % 2}/{i}", f"h{i % 2}", 0) for i in range(6)], "url string, host string, wait long")
    at = defaultdict(list)
    for r in fetch(rows).collect():
        at[r["url"].split("/")[2]].append(float(r["html"]))
    assert sorted(len(v) for v in at.values()) == [3, 3]
    assert all(b - a > 0.14 for v in at.values() for a, b in zip(sorted(v), sorted(v)[1:]))
