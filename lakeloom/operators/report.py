"""Crawl results: filters of the sink, duplicates by arrival, report rows, side outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import secrets, urls
from lakeloom.functions.urls import Scope

#: The report's columns, in order, and how duplicates are marked.
COLUMNS = ["URL", "Status", "Title", "Length", "LinkType", "Redirects", "Depth", "Types", "Counts", "Details", "Duplicate"]
YES, NO = "是", "否"


def with_duplicates(results: DataFrame, order: str, key: str = "url") -> DataFrame:
    """`is_duplicate`: whether the URL came before, in order of arrival."""
    return results.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1)


def reported(results: DataFrame, scope: Scope, order: str) -> DataFrame:
    """What the sink writes: results that no filter takes, once for each URL."""
    kept = results.where(urls.sink_verdict(F.col("url"), F.col("status_code"), F.col("title"), scope).isNull())
    return with_duplicates(kept, order).where(~F.col("is_duplicate"))


def console_only(results: DataFrame, scope: Scope) -> DataFrame:
    """Results that only the allow-list keeps out of the report."""
    return results.where(urls.sink_verdict(F.col("url"), F.col("status_code"), F.col("title"), scope) == "allow")


def rows(results: DataFrame) -> DataFrame:
    """Report rows of results (url, status_code, error, title, length, redirects array, depth, sensitive, is_duplicate)."""
    types, counts, details = secrets.report_columns(F.col("sensitive"))
    cols = [F.col("url"), urls.status_text(F.col("status_code"), F.col("error")), F.coalesce("title", F.lit("")), F.coalesce("length", F.lit(0)), urls.link_type(F.col("url")), F.array_join("redirects", " → "), F.coalesce("depth", F.lit(0)), types, counts, details, F.when(F.col("is_duplicate"), YES).otherwise(NO)]
    return results.select(*[c.alias(n) for c, n in zip(cols, COLUMNS)])


def danger_rows(found: DataFrame, scope: Scope) -> DataFrame:
    """Blocked URLs (url), once each, as report rows with the token that blocked them."""
    blocked = found.select("url").distinct().withColumn("token", urls.danger_token(F.col("url"), scope.danger)).where(F.col("token").isNotNull())
    fixed = {"Status": "danger", "Title": "", "Length": 0, "Redirects": "", "Depth": 0, "Counts": "1", "Duplicate": NO}
    return blocked.select(F.col("url").alias("URL"), *[F.lit(v).alias(k) for k, v in fixed.items()], urls.link_type(F.col("url")).alias("LinkType"), F.lit("danger").alias("Types"), F.col("token").alias("Details")).select(*COLUMNS)


def unvisited(external: DataFrame, visited: DataFrame) -> DataFrame:
    return external.select("url").distinct().join(visited.select("url"), "url", "left_anti")


def full(*parts: DataFrame) -> DataFrame:
    """One report of several: results, external pages, blocked URLs."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tally(results: DataFrame, outcome: str) -> DataFrame:
    return results.groupBy(outcome).agg(F.count("*").alias("n"))


def last_lines(log: DataFrame, n: int, order: str = "line_no", line: str = "line") -> DataFrame:
    """The last n lines of a log, without terminal colours."""
    from lakeloom.functions.text import without_ansi

    return log.orderBy(F.desc(order)).limit(n).withColumn(line, without_ansi(F.col(line))).orderBy(order)


def file_name(host: F.Column, at: F.Column) -> F.Column:
    """A report's file name: host and time."""
    return F.concat(F.replace(host, F.lit("."), F.lit("_")), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".csv"))
