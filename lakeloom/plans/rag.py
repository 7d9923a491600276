"""Retrieval in phases, each a DataFrame that can be looked at: search, filter after reranking, sections, answer text."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import lines as L
from lakeloom.operators.cut import saved
from lakeloom.plans import phases
from lakeloom.plans import search as S
from lakeloom.plans.steps import Ask, ask_all, rule_composer, rule_optimiser, rule_router
from lakeloom.sources.corpus import source_url

FAITHFUL = ("faithful_reference", "faithful_how_to")


def understood(queries: DataFrame, optimise: Ask = rule_optimiser, route: Ask = rule_router) -> DataFrame:
    """queries (id, text) -> search parameters of each, by the first two steps."""
    q = queries.select("id", phases.parsed(ask_all(F.col("text"), optimise)["answer"], phases.OPTIMISED).alias("a"), phases.parsed(ask_all(F.col("text"), route)["answer"], phases.ROUTED).alias("b"))
    return phases.transition("0a+0b", "1")(q, ("a", "b"))


def sections_of(found: DataFrame, pages: DataFrame, threshold: int = 2100) -> DataFrame:
    """(doc_set, title, key, content, lines, total_lines, requires_processing): what the found headings head; the page whole
    if none are named, or if a heading is the page's title."""
    want = found.select("doc_set", F.col("page_title").alias("page"), F.explode_outer("headings.text").alias("h")).withColumn("h", F.trim(F.regexp_replace("h", r"^[# ]+", "")))
    whole = want.where(F.col("h").isNull() | F.coalesce(F.lower("h") == F.lower("page"), F.lit(False))).select("doc_set", "page").distinct()
    pages = pages.withColumnRenamed("title", "page")
    full = pages.join(whole, ["doc_set", "page"], "left_semi").select("doc_set", "page", F.col("page").alias("key"), "content")
    part = L.sections(L.explode(pages.select("doc_set", "page", "content"), "content"), ["doc_set", "page"], want.where(F.col("h").isNotNull()).join(whole, ["doc_set", "page"], "left_anti").select("doc_set", "page", F.col("h").alias("title")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    part = part.groupBy("doc_set", "page", "title").agg(text.alias("content")).select("doc_set", "page", F.concat_ws("::", "page", "title").alias("key"), "content")
    return L.line_counts(full.unionByName(part), [], "content", threshold).select("doc_set", F.col("page").alias("title"), "key", "content", "lines", "total_lines", F.col("over").alias("requires_processing"))


def missing(found: DataFrame, sections: DataFrame) -> DataFrame:
    """Headings that were asked for and are not there."""
    want = found.select("doc_set", F.col("page_title").alias("title"), F.explode("headings.text").alias("h")).withColumn("h", F.trim(F.regexp_replace("h", r"^[# ]+", ""))).withColumn("key", F.concat_ws("::", "title", "h"))
    have = sections.select("doc_set", "key").unionByName(sections.where(F.col("key") == F.col("title")).join(want.select("doc_set", "title", F.col("key").alias("k")), ["doc_set", "title"]).select("doc_set", F.col("k").alias("key")))
    return want.join(have, ["doc_set", "key"], "left_anti").select("doc_set", "title", F.col("h").alias("heading"))


def compressed(sections: DataFrame, query: str | None, threshold: int = 2100) -> DataFrame:
    """Sections over the threshold cut: by relevance to the query, best first while 1.5 thresholds hold them, or each in itself."""
    if query is None:
        return sections.withColumn("content", L.smart_truncate(F.col("content"), threshold))
    from lakeloom.operators.ranking import section_score

    scored = sections.withColumn("score", section_score(F.lit(query), F.element_at(F.split("key", "::"), -1), F.col("content")))
    return L.packed(scored, ["doc_set", "title"], [F.desc("score"), "key"], "lines", 1.5 * threshold).where("taken").drop("taken")


def answer(query: str, scene: str, sections: DataFrame, pages: DataFrame, compose: Ask = rule_composer) -> DataFrame:
    """One row (output, sources): sections in order, as they are for faithful scenes, else through the composer; sources."""
    urls = pages.join(sections.select("doc_set", "title").distinct(), ["doc_set", "title"], "left_semi").select("doc_set", "title", source_url(F.col("content")).alias("source_url"))
    metas = sections.groupBy("doc_set", "title").agg(F.array_compact(F.array_sort(F.collect_set(F.when(F.col("key").contains("::"), F.element_at(F.split("key", "::"), -1))))).alias("headings"))
    metas = metas.join(urls, ["doc_set", "title"]).select(F.lit(1).alias("one"), F.concat_ws("/", "doc_set", "title").alias("pos"), "title", "source_url", "headings", F.concat_ws("/", "doc_set", "title", F.lit("docContent.md")).alias("local_path"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_set", "title", "key", "content"))), lambda x: x["content"]), "\n\n")
    body = sections.groupBy(F.lit(1).alias("one")).agg(text.alias("body"))
    if scene not in FAITHFUL:
        body = body.withColumn("body", ask_all(F.concat(F.lit(f"{query}\n\n"), "body"), compose)["answer"])
    return body.join(phases.sources(metas, ["one"]), "one").select(F.concat("body", F.lit("\n\n"), "sources").alias("output"), "sources")


def write_answer(found: DataFrame, path: str | None = None) -> str:
    """Writes the output of answer() to a file of the driver: the path that is given, else the one that LAKELOOM_RESULT_FILE
    names, else one in the temporary folder. Gives the path."""
    path = path or os.environ.get("LAKELOOM_RESULT_FILE") or os.path.join(tempfile.gettempdir(), "lakeloom-result.txt")
    row = found.select("output").first()
    with open(path, "w", encoding="utf-8") as f:
        f.write((row["output"] if row else None) or "")
    return path


def retrieve(query: str, pages: DataFrame, tocs: DataFrame, doc_sets: list[str] | None = None, stop_at: str = "4", options: S.Options | None = None, encode: Callable[[Column], Column] | None = None, optimise: Ask = rule_optimiser, route: Ask = rule_router, compose: Ask = rule_composer) -> DataFrame:
    """The result of the phase that is named: 0 (parameters), 1 (search), 1.5 (after reranking), 2 (sections), 4 (answer)."""
    params = understood(pages.sparkSession.createDataFrame([(1, query)], "id int, text string"), optimise, route)
    if stop_at == "0":
        return params
    p = params.first().asDict()
    sets = doc_sets or p["target_doc_sets"] or None
    o = S.options_of(p, options)
    found = S.search(pages, tocs, p["query"], sets, o, encode)
    if stop_at == "1":
        return found
    if encode is not None:
        before, found = found, found.drop("toc_path")  # paths are no text to rerank by
        ask, skip = S.to_rerank(found)
        good = F.coalesce(F.col("rerank_sim") >= o.rerank_threshold, F.lit(False))
        kept = ask.withColumn("headings", F.when(good, F.slice("headings", 1, 0)).otherwise(F.filter("headings", lambda h: h["rerank_sim"] >= o.rerank_threshold))).where(good | (F.size("headings") > 0))
        found = kept.unionByName(skip)
        found = S.with_paths(found, before)
    if stop_at == "1.5":
        return found
    sections = saved(sections_of(found, pages))
    return sections if stop_at == "2" else answer(query, p["scene"], sections, pages, compose)
