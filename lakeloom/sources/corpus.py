"""Sources and sinks of a corpus: trees of Markdown pages, lists of URLs, keyword files, reports.

A corpus is a folder of doc sets named <name>@<version>, each a folder of pages with docContent.md and docTOC.md. All reads go
through Spark's file sources, so any file system it knows will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.functions.charset import decoded  # noqa: F401


class CorpusError(ValueError):
    pass


def _files(spark: SparkSession, base: str, name: str) -> DataFrame:
    df = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    parts = F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/")
    return df.select(F.element_at(parts, -3).alias("doc_set"), F.element_at(parts, -2).alias("title"), F.element_at(parts, -1).alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("content")).where(F.col("doc_set").contains("@"))


def pages(spark: SparkSession, base: str, doc_sets: list[str] | None = None) -> DataFrame:
    """(doc_set, title, content) of a corpus tree; the named doc sets only if given."""
    df = _files(spark, base, "docContent.md").drop("file")
    return df if doc_sets is None else df.where(F.col("doc_set").isin(doc_sets))


def tocs(spark: SparkSession, base: str, doc_sets: list[str] | None = None) -> DataFrame:
    df = _files(spark, base, "docTOC.md").drop("file")
    return df if doc_sets is None else df.where(F.col("doc_set").isin(doc_sets))


def catalog(pages: DataFrame) -> DataFrame:
    """(doc_set, name, version, titles): what there is, titles in order."""
    return pages.groupBy("doc_set").agg(F.array_sort(F.collect_set("title")).alias("titles")).select("doc_set", T.doc_set_name(F.col("doc_set")).alias("name"), T.doc_set_version(F.col("doc_set")).alias("version"), "titles")


def content_of(pages: DataFrame, title: str, doc_set: str | None = None) -> str:
    """The text of one page; that there is none of this title is an error."""
    found = pages.where(F.col("title") == title)
    row = (found if doc_set is None else found.where(F.col("doc_set") == doc_set)).orderBy("doc_set").select("content").limit(1).collect()
    if not row:
        raise CorpusError(f"no page {title!r}" + (f" in {doc_set}" if doc_set else ""))
    return row[0]["content"]


def first_lines_of(spark: SparkSession, paths: list[str] | str, most: int = 100) -> DataFrame:
    """(path, text): the first lines of files, for an index that needs no more of them."""
    df = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.withColumn("text", F.array_join(F.slice(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), 1, most), "\n"))


def checked(pages: DataFrame) -> DataFrame:
    if pages.isEmpty():
        raise CorpusError("there is no doc set with pages here")
    return pages


def doc_sets(pages: DataFrame) -> DataFrame:
    return pages.select("doc_set").where(F.col("doc_set").contains("@")).distinct().orderBy("doc_set")


def single_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_set, title, content) of one Markdown file; the title is its first heading that has text."""
    if not path.endswith(".md"):
        raise CorpusError(f"not a Markdown file: {path}")
    df = spark.read.text(path, wholetext=True)
    return df.select(F.lit("single@latest").alias("doc_set"), F.coalesce(F.nullif(F.trim(F.regexp_extract("value", r"(?m)^#+[ \t]+(\S.*)$", 1)), F.lit("")), F.lit("Unknown")).alias("title"), F.col("value").alias("content"))


def source_url(content: F.Column) -> F.Column:
    """The URL on the first line that names the source."""
    return F.regexp_extract(content, r"(?m)^.*原文链接[*]*[:：]\s*(\S+)", 1)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL to a line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url") != "")


def url_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first column of a CSV file with a header, http(s) only."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.select(F.trim(df[df.columns[0]]).alias("url")).where(F.col("url").rlike("^https?://"))


def has_content(spark: SparkSession, path: str) -> bool:
    return not spark.read.csv(path, header=True, multiLine=True, escape='"').isEmpty()


def first_url(spark: SparkSession, path: str) -> str | None:
    row = url_csv(spark, path).limit(1).collect()
    return row[0]["url"] if row else None


def keywords(spark: SparkSession, path: str) -> list[str]:
    """A list of words that a person keeps by hand, one to a line; lines that begin with # are notes."""
    return [r["url"] for r in url_list(spark, path).where(~F.col("url").startswith("#")).collect()]


def write_csv(report: DataFrame, path: str, append: bool = False) -> None:
    report.write.mode("append" if append else "overwrite").csv(path, header=True, escape='"')


def write_pages(pages: DataFrame, path: str, order: str | None = None) -> None:
    """(doc_set, title, content, ...) as Parquet by doc set; of pages with one title the last in `order` stays."""
    if order is not None:
        w = Window.partitionBy("doc_set", "title").orderBy(F.desc(order))
        pages = pages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")
    pages.write.mode("overwrite").partitionBy("doc_set").parquet(path)


def toc_text(anchors: DataFrame, by: list[str]) -> DataFrame:
    """(by..., toc): numbered anchors (pos, level, number, text, url) as a table of contents in Markdown."""
    line = F.concat(F.when(F.col("level") <= 3, F.concat(F.repeat(F.lit("#"), F.col("level") + 1), F.lit(" "))).otherwise("- "), F.col("number"), F.lit(". "), F.col("text"), F.lit("："), F.col("url"), F.when(F.col("level") <= 3, "\n\n").otherwise("\n"))
    return anchors.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "").alias("toc"))


def as_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct("*")).alias("json"))
