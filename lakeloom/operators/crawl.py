"""Crawling as a loop of set steps: expand the frontier, keep what the scope takes, drop what was seen, go on.

Pages come from a table or from a fetcher that runs in Arrow batches on the partitions of the frontier. Each round is
written to the shared folder, so the plan does not grow and a lost executor costs one round.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import charset, html, urls
from lakeloom.functions.urls import Scope
from lakeloom.operators.cut import saved
from lakeloom.sources import corpus

FETCHED = "url string, html string, status_code int, error string, final_url string, content_type string, redirects array<string>, headers map<string,string>, attempts int"
NO_BUDGET, NO_HOST_BUDGET = "over the budget of requests", "over the budget of requests to a host"


@dataclass(frozen=True)
class Pace:
    """What a host is asked at most: `burst` requests at once, then one every `interval` milliseconds, `most` in all."""

    interval: int = 1000
    burst: int = 1
    most: int | None = None


HOSTS = "host string, free long, asked long"


def ranked(urls_of: DataFrame) -> DataFrame:
    """(host, url) -> with `i`, from 0, by URL within a host. A host is numbered over ranges of rows, so one that holds most of
    them never meets in one task."""
    cut = saved(urls_of.repartitionByRange("host", "url").withColumn("__part", F.spark_partition_id()))
    sizes = cut.groupBy("host", "__part").agg(F.count("*").alias("n"))  # of a host, a row for each range
    before = Window.partitionBy("host").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("host", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("host", "__part").orderBy("url"))
    return cut.join(sizes, ["host", "__part"]).withColumn("i", F.col("__before") + own - 1).drop("__part", "__before")


def paced(frontier: DataFrame, hosts: DataFrame, start: int, pace: Pace) -> tuple[DataFrame, DataFrame]:
    """When each URL of a round is due, and the hosts' state after it: a token bucket for each host, in closed form.

    frontier (url), hosts (host, free: the millisecond at which the bucket would be full but for one, asked: requests so far),
    start: when the round begins -> (url, host, due, over), over for what exceeds the host's budget; hosts as they are then.
    """
    at = ranked(frontier.select("url", urls.host(F.col("url")).alias("host"))).join(hosts, "host", "left")
    at = at.withColumns({"free": F.greatest(F.coalesce("free", F.lit(start)), F.lit(start)), "asked": F.coalesce("asked", F.lit(0))})
    over = F.lit(False) if pace.most is None else F.col("asked") + F.col("i") >= pace.most
    due = F.greatest(F.lit(start).cast("long"), F.col("free") + (F.col("i") - (pace.burst - 1)) * pace.interval)
    at = saved(at.withColumn("over", over).withColumn("due", F.when(~F.col("over"), due)))
    new = at.where(~F.col("over")).groupBy("host").agg((F.max("free") + F.count("*") * pace.interval).alias("__free"), F.count("*").alias("__n"))
    both = hosts.join(new, "host", "full").select("host", F.coalesce("__free", "free").alias("free"), (F.coalesce("asked", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("asked"))
    return at.select("url", "host", "due", "over"), saved(both)


class Bucket:
    """What a task knows of its hosts, by its own clock: late requests are not made up for faster than the pace allows."""

    def __init__(self, pace: Pace, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pace, self.clock, self.sleep, self.began, self.free = pace, clock, sleep, clock(), {}

    def take(self, host: str | None, wait: int) -> None:
        """Returns once the host may be asked, `wait` milliseconds after the task began at the earliest."""
        step = self.pace.interval / 1000
        now = self.clock()
        at = max(now, self.began + wait / 1000, self.free.get(host, now) - (self.pace.burst - 1) * step)
        self.free[host] = max(self.free.get(host, at), at) + step
        if at > now:
            self.sleep(at - now)


@dataclass
class Response:
    """What a fetcher may give in place of (html, status, error): body as text or bytes, and what the server said."""

    body: str | bytes | None = None
    status: int | None = None
    headers: dict[str, str] = field(default_factory=dict)
    final_url: str | None = None
    redirects: list[str] = field(default_factory=list)
    error: str | None = None


def from_table(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetcher that looks pages (url, html) up; what is not there is an error. Where several pages have one URL, `copy` numbers
    them from 0: a crawl follows the links of all and gives the first."""
    copy = F.row_number().over(Window.partitionBy("url").orderBy("html")) - 1

    def look_up(frontier: DataFrame) -> DataFrame:
        found = frontier.join(pages.select("url", "html"), "url", "left").withColumn("copy", copy)
        return found.select("url", "html", F.when(F.col("html").isNotNull(), 200).alias("status_code"), F.when(F.col("html").isNull(), "Err").alias("error"), "copy")

    return look_up


def fetched(url: str, fetch: Callable, attempts: int, wait: float, final: tuple[str, ...], sleep: Callable[[float], None] = time.sleep) -> tuple:
    """A row of FETCHED: the call is made up to `attempts` times, with `wait` seconds between, while it raises; errors of a
    class named in `final` are not tried again. Bytes are decoded."""
    n = 0
    while True:
        n += 1
        try:
            got = fetch(url)
            break
        except Exception as e:  # the crawl goes on without this page
            if n >= attempts or any(c.__name__ in final for c in type(e).__mro__):
                return (url, None, None, urls.error_text(e), url, None, [], {}, n)
            sleep(wait)
    r = got if isinstance(got, Response) else Response(got[0], got[1], error=got[2])
    headers = {str(k): str(v) for k, v in (r.headers or {}).items()}
    kind = next((v for k, v in headers.items() if k.lower() == "content-type"), None)
    body = charset.text_of(r.body, charset.charset_of(kind)) if isinstance(r.body, bytes) else r.body
    return (url, body, r.status, r.error, r.final_url or url, kind, list(r.redirects or []), headers, n)


def from_function(fetch: Callable[[str], Response | tuple[str | None, int | None, str | None]], partitions: int = 32, attempts: int = 3, wait: float = 0.5, final: tuple[str, ...] = ("TooManyRedirects",), pace: Pace | None = None) -> Callable[[DataFrame], DataFrame]:
    """A fetcher that calls fetch(url) -> Response, or (html, status, error), for each URL, on as many partitions.

    With a pace, as the crawl has it, a host's URLs are asked by one task, which streams them in the order in which they are due
    and waits for each; to ask a host at a bounded rate is serial work however many tasks there are. Further attempts count
    as requests. A task that runs again, as its executor was lost, asks its URLs again.
    """

    def run(batches):
        bucket = pace and Bucket(pace)
        for b in batches:
            out = []
            for u, host, ms in zip(*(b.column(i).to_pylist() for i in range(3))) if bucket else ((u, None, 0) for u in b.column(0).to_pylist()):
                asked = (lambda url, host=host, ms=ms: (bucket.take(host, ms), fetch(url))[1]) if bucket else fetch
                out.append(fetched(u, asked, attempts, wait, final))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.int32())
            columns = [pa.array([list(r[i].items()) if i == 7 else r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FETCHED.split(", ")])

    if pace:
        return lambda frontier: frontier.select("url", "host", "wait").repartition(partitions, "host").sortWithinPartitions("wait", "url").mapInArrow(run, FETCHED)
    return lambda frontier: frontier.select("url").repartition(partitions, "url").mapInArrow(run, FETCHED)


def documents(got: DataFrame) -> DataFrame:
    """Fetched pages with `title` and `needs_rendering`; a status of 400 and above is an error and its page is not read."""
    bad = F.col("status_code") >= 400
    rows = got.withColumns({"error": F.when(bad, F.concat(F.lit("HTTPError: "), F.col("status_code").cast("string"))).otherwise(F.col("error")), "html": F.when(~F.coalesce(bad, F.lit(False)), F.col("html"))})
    p = html.page(F.col("url"), F.col("html"), fields=["title", "needs_rendering"])
    return rows.withColumn("__p", p).withColumns({"title": F.col("__p.title"), "needs_rendering": F.col("__p.needs_rendering")}).drop("__p")


def hrefs(html: F.Column) -> F.Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'>]*)["']"""), F.lit(1))


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], scope: Scope, max_depth: int = 3, max_urls: int | None = None, links: Callable = hrefs, max_requests: int | None = None, same_host: bool = False, pace: Pace | None = None) -> DataFrame:
    """seeds (url) -> (url, depth, status_code, error, html, ...): each URL once, at its least depth.

    The scope is asked before a page is fetched. Links are followed while the depth is under max_depth; with same_host those
    that stay on the host of their page only. max_urls bounds how many URLs there are, whole rounds first, then by URL.
    max_requests bounds how many are fetched in the same order; of the round in which it is met, the rest are errors.
    pace: bounds what each host is asked, by URL within a round; the fetcher gets `host` and `wait`, the milliseconds from the
    round's start, and rows get `due`, those from the crawl's start if no request takes any time. What exceeds a host's budget
    is an error. A round begins when the one before has ended.
    links: the candidates that stand in a page, from its HTML, or from (HTML, URL), as urls.candidates takes.
    """
    frontier = saved(seeds.select("url").where(urls.is_url(F.col("url"))).distinct())
    done = seen = None
    total = asked = start = 0
    hosts = seeds.sparkSession.createDataFrame([], HOSTS)
    for depth in range(max_depth + 1):
        if max_urls is not None:
            frontier = frontier.orderBy("url").limit(max_urls - total)
        rest = None
        if max_requests is not None:
            frontier = saved(frontier)
            first = saved(frontier.orderBy("url").limit(max(0, max_requests - asked)))
            rest, frontier = frontier.join(first, "url", "left_anti"), first
            asked += first.count()
        if pace is None:
            got = fetch(frontier)
        else:
            plan, hosts = paced(frontier, hosts, start, pace)
            took = plan.where(~F.col("over")).select("url", "host", "due", (F.col("due") - start).alias("wait"))
            late = plan.where("over").select("url", F.lit(NO_HOST_BUDGET).alias("error"))
            got = fetch(took).join(took.select("url", "due"), "url").unionByName(late, allowMissingColumns=True)
            start = took.agg(F.coalesce(F.max("due"), F.lit(start)).alias("t")).first()["t"]
        if rest is not None:
            got = got.unionByName(rest.withColumn("error", F.lit(NO_BUDGET)), allowMissingColumns=True)
        got = saved(got.withColumn("depth", F.lit(depth)))
        one = got.where(F.coalesce("copy", F.lit(0)) == 0).drop("copy") if "copy" in got.columns else got
        total += one.count()
        done = one if done is None else done.unionByName(one)
        seen = one.select("url") if seen is None else seen.unionByName(one.select("url"))
        if depth == max_depth or max_urls is not None and total >= max_urls or max_requests is not None and asked >= max_requests:
            break
        standing = links(F.col("html")) if links is hrefs else links(F.col("html"), F.col("url"))
        found = got.where(F.col("html").isNotNull()).select(F.col("url").alias("page"), F.explode(urls.page_links(F.col("url"), standing, scope)).alias("url"))
        found = found.where(urls.host(F.col("url")) == urls.host(F.col("page"))) if same_host else found
        frontier = saved(found.select("url").distinct().join(seen, "url", "left_anti"))
        if frontier.isEmpty():
            break
    return done


def crawl_csv(spark: SparkSession, path: str, fetch: Callable[[DataFrame], DataFrame], scope: Scope | None = None, max_depth: int = 0, **options) -> DataFrame:
    """A crawl from the first column of a CSV file; without a depth its pages only, else on each one's host."""
    return crawl(corpus.url_csv(spark, path), fetch, scope or Scope(mode=2), max_depth, same_host=True, **options)


def within_hosts(found: DataFrame, each: int) -> DataFrame:
    """The first `each` URLs of each host, by depth and URL."""
    w = Window.partitionBy(urls.host(F.col("url"))).orderBy("depth", "url")
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= each).drop("__n")


def same_host_links(pages: DataFrame) -> DataFrame:
    """(url, link): the links of a page that stay on its host, without fragments."""
    link = F.regexp_replace(urls.resolved(F.col("url"), F.col("href")), "#.*$", "")
    return pages.select("url", F.explode(F.array_distinct(hrefs(F.col("html")))).alias("href")).where(~F.col("href").rlike("^(?:#|javascript:|mailto:|tel:|data:)")).select("url", link.alias("link")).where(urls.host(F.col("link")) == urls.host(F.col("url"))).distinct()
