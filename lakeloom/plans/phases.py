"""From one phase's answer to the next phase's question: six transitions, as projections of typed columns.

Answers come as JSON text or as structs. Whatever an answer lacks takes the default that is stated here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.similarity import extract_json

# Scenes and the ranges that an answer has to keep.
SCENES = ["fact_lookup", "faithful_reference", "faithful_how_to", "concept_learning", "how_to", "comparison", "exploration"]
THRESHOLD = (0.30, 0.80)
DEFAULT_SCENE, DEFAULT_THRESHOLD = "fact_lookup", 0.63

OPTIMISED = "query_analysis struct<original string, language string, doc_set array<string>, domain_nouns array<string>, predicate_verbs array<string>>, optimized_queries array<struct<rank int, query string, strategy string>>"
ROUTED = "scene string, confidence double, ambiguity double, coverage_need double, reranker_threshold double"
FOUND = "success boolean, results array<struct<doc_set: string, page_title: string, toc_path: string, rerank_sim: double, headings: array<struct<text: string, level: int, rerank_sim: double>>>>"


def parsed(raw: Column, schema: str) -> Column:
    """An answer's JSON, mended if need be, by its schema; null where there is none."""
    return F.from_json(extract_json(raw), schema, {"mode": "PERMISSIVE"})


def optimised_faults(a: Column) -> Column:
    """What an optimiser's answer lacks."""
    q = a["query_analysis"]
    return F.array_compact(F.array(F.when(F.coalesce(q["original"], F.lit("")) == "", "query_analysis.original"), F.when(F.coalesce(F.size(q["domain_nouns"]), F.lit(0)) <= 0, "query_analysis.domain_nouns"), F.when(F.coalesce(F.size(a["optimized_queries"]), F.lit(0)) <= 0, "optimized_queries")))


def routed_faults(a: Column) -> Column:
    """Which fields of a router's answer are missing or out of range."""
    out = [F.when(~F.coalesce(a["scene"].isin(SCENES), F.lit(False)), "scene")]
    for name in ("confidence", "ambiguity", "coverage_need", "reranker_threshold"):
        low, high = THRESHOLD if name == "reranker_threshold" else (0.0, 1.0)
        out.append(F.when(~F.coalesce(a[name].between(low, high), F.lit(False)), name))
    return F.array_compact(F.array(*out))


def ranked_queries(a: Column) -> Column:
    """Query texts by rank, 999 where there is none; a text that comes twice has its first rank both times."""
    some = F.filter(a["optimized_queries"], lambda q: q["query"].isNotNull())
    rank = lambda q: F.coalesce(F.get(F.filter(some, lambda x: x["query"] == q["query"]), F.lit(0))["rank"], F.lit(999))
    rows = F.transform(some, lambda q, i: F.struct(rank(q).alias("r"), i.alias("i"), q["query"].alias("q")))
    return F.coalesce(F.transform(F.array_sort(rows), lambda x: x["q"]), F.array().cast("array<string>"))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _plain(heading: Column) -> Column:
    return F.trim(F.regexp_replace(heading, r"^[# ]+", ""))


def optimiser_to_search(df: DataFrame, a: str, cli: bool = False) -> DataFrame:
    q = F.col(a)["query_analysis"]
    sets = F.array_join(_list(q["doc_set"]), ",").alias("doc_sets") if cli else _list(q["doc_set"]).alias("target_doc_sets")
    return df.select(*_others(df, a), ranked_queries(F.col(a)).alias("query"), sets, _list(q["domain_nouns"]).alias("domain_nouns"), _list(q["predicate_verbs"]).alias("predicate_verbs"))


def router_to_search(df: DataFrame, a: str, cli: bool = False) -> DataFrame:
    return df.select(*_others(df, a), F.coalesce(F.col(a)["reranker_threshold"], F.lit(DEFAULT_THRESHOLD)).alias("reranker_threshold"), F.coalesce(F.col(a)["scene"], F.lit(DEFAULT_SCENE)).alias("scene"))


def both_to_search(df: DataFrame, a: tuple[str, str], cli: bool = False) -> DataFrame:
    return router_to_search(optimiser_to_search(df, a[0], cli), a[1], cli)


def search_to_rerank(df: DataFrame, a: str, cli: bool = False) -> DataFrame:
    r = F.coalesce(F.col(a)["results"], F.array().cast(df.schema[a].dataType["results"].dataType))
    needs = F.exists(r, lambda p: F.exists(p["headings"], lambda h: h["rerank_sim"].isNull()))
    return df.select(*_others(df, a), F.coalesce(needs, F.lit(False)).alias("needs_rerank"), r.alias("results"), F.coalesce(F.col(a)["success"], F.lit(False)).alias("success"))


def results_to_sections(df: DataFrame, a: str, cli: bool = False) -> DataFrame:
    """What to read: title, headings without marks, doc set, of each result."""
    sections = F.transform(F.col(a)["results"], lambda p: F.struct(F.coalesce(p["page_title"], F.lit("")).alias("title"), F.coalesce(F.transform(p["headings"], lambda h: _plain(F.coalesce(h["text"], F.lit("")))), F.array().cast("array<string>")).alias("headings"), F.coalesce(p["doc_set"], F.lit("")).alias("doc_set")))
    empty = F.array().cast("array<struct<title: string, headings: array<string>, doc_set: string>>")
    if not cli:
        return df.select(*_others(df, a), F.coalesce(sections, empty).alias("sections"))
    return df.select(*_others(df, a), F.coalesce(sections, empty).alias("page_titles"), F.lit(True).alias("with_metadata"), F.lit("json").alias("format"))


def _others(df: DataFrame, a: str) -> list[Column]:
    return [F.col(c) for c in df.columns if c != a]


TRANSITIONS: dict[tuple[str, str], Callable] = {
    ("0a", "1"): optimiser_to_search,
    ("0b", "1"): router_to_search,
    ("0a+0b", "1"): both_to_search,
    ("1", "1.5"): search_to_rerank,
    ("1", "2"): results_to_sections,
    ("1.5", "2"): results_to_sections,
}


def transition(start: str, end: str) -> Callable:
    if (start, end) not in TRANSITIONS:
        raise ValueError(f"no way from phase {start} to {end}; there are {sorted(TRANSITIONS)}")
    return TRANSITIONS[start, end]


def sources(metas: DataFrame, by: list[str]) -> DataFrame:
    """(by..., sources): pages (title, source_url, local_path, headings, pos) as a list of sources in Markdown."""
    anchors = F.array_join(F.transform("headings", lambda h: F.concat(F.lit("   - #"), h, F.lit(": "), F.when(F.col("source_url") != "", F.concat("source_url", F.lit("#"), h)).otherwise(""), F.lit("\n"))), "")
    one = F.concat(F.lit("- **"), "title", F.lit("**\n   - 原文链接: "), "source_url", F.lit("\n"), anchors, F.lit("   - 本地文档: `"), "local_path", F.lit("`\n\n"))
    return metas.groupBy(*by).agg(F.concat(F.lit("---\n\n### 文档来源 (Sources)\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("t")))), lambda x: x["t"]), "")).alias("sources"))
