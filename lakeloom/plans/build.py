"""From fetched pages to a corpus: titles, Markdown with a header, tables of contents, a tally; then a tree or a table.

Each page is parsed once; all that follows are columns of what the parser gives. Pages whose title is filtered out, or that
hold nothing, are tallied and left out; of pages with one name the last stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import html, similarity, urls
from lakeloom.functions import text as T
from lakeloom.operators import report
from lakeloom.sources import tree
from lakeloom.sources.corpus import toc_text

HEADER = "# {title}\n\n> **原文链接**: {url}\n\n---\n\n"


def cleaned_title(title: Column, removed: list[str]) -> Column:
    """A title without set strings."""
    for r in removed:
        title = F.replace(title, F.lit(r), F.lit(""))
    return F.trim(title)


def page_name(title: Column, url: Column) -> Column:
    """A page's folder: its title as a file name, else the last part of its path, else index."""
    parts = F.filter(F.split(urls.path(url), "/"), lambda p: p != "")
    named = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.try_element_at(parts, F.lit(-1)), F.lit("index"))
    return T.safe_name(similarity.normalised(named), folder=True)


def doc_set(url: Column, name: str | None = None, version: str = "latest") -> Column:
    return F.concat(F.lit(name) if name else urls.doc_name(url), F.lit(f"@{version}"))


def converted(pages: DataFrame, options: html.Options | None = None, name: str | None = None, version: str = "latest", removed: list[str] = (), skipped: list[str] = tuple(urls.TITLES), order: str | None = None) -> DataFrame:
    """pages (url, html, ...) -> (doc_set, title, url, content, anchors, outcome): one row for each page, outcome one of
    ok, empty, skipped_title, replaced (a later page has the name; by `order`, else by URL)."""
    p = pages.withColumn("p", html.page(F.col("url"), F.col("html"), options))
    title = cleaned_title(F.col("p.title"), list(removed))
    rows = p.select("url", *([order] if order else []), F.col("p.anchors").alias("anchors"), F.col("p.markdown").alias("body"), title.alias("heading"), page_name(title, F.col("url")).alias("title"), doc_set(F.col("url"), name, version).alias("doc_set"))
    state = F.when(urls.skipped_title(F.col("heading"), list(skipped)), "skipped_title").when((F.col("body") == "") & (F.size("anchors") == 0), "empty").otherwise("ok")
    rows = rows.withColumn("outcome", state)
    last = F.row_number().over(Window.partitionBy("doc_set", "title", F.col("outcome") == "ok").orderBy(F.desc(order or "url"), "url"))
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "ok") & (last > 1), "replaced").otherwise(F.col("outcome")))
    before, _, rest = HEADER.partition("{title}")
    middle, _, after = rest.partition("{url}")
    return rows.withColumn("content", F.concat(F.lit(before), "heading", F.lit(middle), "url", F.lit(after), "body")).select("doc_set", "title", "url", "content", "anchors", "outcome")


def tally(rows: DataFrame) -> DataFrame:
    return report.tally(rows, "outcome")


def contents(rows: DataFrame) -> DataFrame:
    """(doc_set, title, content) of what is kept."""
    return rows.where("outcome = 'ok'").select("doc_set", "title", "content")


def tables_of_contents(rows: DataFrame) -> DataFrame:
    """(doc_set, title, content): title, source, number of anchors, then the anchors, numbered, by level."""
    kept = rows.where((F.col("outcome") == "ok") & (F.size("anchors") > 0))
    each = kept.select("doc_set", "title", F.posexplode("anchors").alias("pos", "a")).select("doc_set", "title", "pos", "a.level", "a.number", "a.text", "a.url")
    toc = toc_text(each, ["doc_set", "title"])
    head = F.concat(F.lit("# "), "title", F.lit("\n\n原文链接: "), "url", F.lit("\n\n提取的锚点数量: "), F.size("anchors").cast("string"), F.lit("\n\n"))
    return kept.join(toc, ["doc_set", "title"]).select("doc_set", "title", F.concat(head, "toc").alias("content"))


def write_tree(pages: DataFrame, base: str, file: str = "docContent.md", overwrite: bool = False) -> DataFrame:
    """Writes base/<doc_set>/<title>/<file> for each page (doc_set, title, content), all or none; gives the paths."""
    tree.write(pages, base, file, overwrite)
    return pages.select(F.concat_ws("/", F.lit(base), "doc_set", "title", F.lit(file)).alias("path"))
