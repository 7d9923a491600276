"""Layered retrieval of documents: titles, then tables of contents, then previews, until the result satisfies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import similarity
from lakeloom.operators import bm25
from lakeloom.operators import lines as L
from lakeloom.operators import ranking as R
from lakeloom.operators.cut import saved

#: How many titles, pages by their tables of contents, previews, lines of content, and rows in the end.
CAPS = {"titles": 5, "toc": 10, "previews": 8, "content": 20, "final": 10}
COLUMNS = ["doc_set", "title", "similarity", "match_type", "source", "sections", "preview"]


def _row(df: DataFrame, source: str, **more) -> DataFrame:
    none = {"sections": F.array().cast("array<string>"), "preview": F.lit(None).cast("string")}
    return df.withColumns({"source": F.lit(source), **{k: v for k, v in none.items() if k not in df.columns}, **more}).select(*COLUMNS)


def by_title(pages: DataFrame, query: str, k: int = CAPS["titles"], fuzzy: float = 0.6) -> DataFrame:
    return _row(R.title_layers(pages.select("doc_set", "title"), query, k=k, fuzzy=fuzzy), "title")


def by_toc(tocs: DataFrame, query: str, k: int = CAPS["toc"], sections: int = 20) -> DataFrame:
    """Pages by their most relevant headings; several relevant ones count 0.1 more."""
    from pyspark.sql import Window

    heads = L.toc(L.explode(tocs, "content")).withColumn("rel", R.toc_relevance(F.trim(F.regexp_extract("line", r"^\s*#+\s+(.+)$", 1)), query)).where(F.col("rel") >= 0.3)
    w = Window.partitionBy("doc_set", "title").orderBy(F.desc("rel"), "line_no")
    ranked = heads.withColumn("n", F.row_number().over(w)).where(F.col("n") <= sections)
    pages = ranked.groupBy("doc_set", "title").agg(F.max("rel").alias("best"), F.count("*").alias("c"), F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "text")))).alias("s"))
    sim = F.when(F.col("c") > 1, F.least(F.lit(1.0), F.col("best") + 0.1)).otherwise(F.col("best"))
    top = pages.withColumn("similarity", sim).orderBy(F.desc("similarity"), "doc_set", "title").limit(k)
    return _row(top.withColumn("match_type", F.lit("toc_section")).withColumn("sections", F.col("s.text")), "toc")


def by_preview(pages: DataFrame, query: str, k: int = CAPS["previews"], lines: int = 50, least: float = 0.1) -> DataFrame:
    """Pages by BM25 over their first lines; scores by the share of the best."""
    p = pages.select(F.struct("doc_set", "title").alias("id"), L.first_lines(F.col("content"), lines).alias("preview")).where(F.col("preview") != "")
    index = bm25.build(p, "id", "preview", bm25.Params(stemmed=False, most=None))
    found = bm25.search(index, p.sparkSession.createDataFrame([(0, query)], "query_id int, query string"), k, least)
    scored = R.preview_scores(found, "score", "similarity").select(F.col("doc").alias("id"), "similarity")
    short = F.when(F.length("preview") > 200, F.concat(F.left("preview", F.lit(200)), F.lit("..."))).otherwise(F.col("preview"))
    return _row(scored.join(p, "id").select("id.doc_set", "id.title", "similarity", F.lit("content_preview_bm25").alias("match_type"), short.alias("preview")), "preview")


def satisfied(rows: DataFrame, least: int = 3, high: float = 0.7) -> bool:
    r = rows.agg(F.count("*").alias("n"), F.max("similarity").alias("s"), F.count_distinct("match_type").alias("t")).first()
    return r["n"] >= least and r["s"] >= high and (r["t"] >= 2 or r["s"] >= 0.8)


def retrieve(pages: DataFrame, tocs: DataFrame, query: str) -> DataFrame:
    """The layers in turn, each only if those before do not satisfy."""
    rows = by_title(pages, query)
    for layer in (lambda: by_toc(tocs, query), lambda: by_preview(pages, query)):
        if satisfied(rows):
            break
        rows = rows.unionByName(layer())
    return rows


def rerank(rows: DataFrame, query: str) -> DataFrame:
    return R.diverse(R.composite(R.best_of_title(rows), query))


def expansions(query: str, most: int = 2) -> list[str]:
    """Single words over three letters, then pairs of neighbours, in the order of the query."""
    words = re.findall(r"\w+", query.lower())
    every = [w for w in words if len(w) > 3] + [" ".join(p) for p in zip(words, words[1:])]
    return [e for e in dict.fromkeys(every) if e != query.lower()][:most]


def match(pages: DataFrame, tocs: DataFrame, query: str, k: int = CAPS["final"], turns: int = 3) -> DataFrame:
    """Retrieve and rerank; while that is not good, also by expansions of the query."""
    rows = retrieve(pages, tocs, query)
    for more in expansions(query, max(0, turns - 1)):
        if R.quality(rows).first()["satisfactory"]:
            break
        rows = rows.unionByName(retrieve(pages, tocs, more))
    return rerank(rows, query).orderBy("rank").limit(k)


MODES = ("exact", "case_insensitive", "partial", "fuzzy")


def extract(pages: DataFrame, titles: DataFrame, mode: str = "exact", modes: tuple[str, ...] = MODES, fuzzy: float = 0.6) -> DataFrame:
    """titles (title) -> (title, doc_set, page, mode, similarity, content), a row for each title that is found: the best page
    of `mode`, else of the first of `modes` that has any. Exact and folded titles are joined by equality; only titles that
    are not found so are compared with all pages, by ratio only where lengths and counts of characters let it reach `fuzzy`."""
    if unknown := {mode, *modes} - set(MODES):
        raise ValueError(f"no such mode: {sorted(unknown)}")
    from lakeloom.operators import layers

    # Pages are read once for their names and once for what is found; names, and what each mode leaves, are small tables of their own.
    names = saved(pages.groupBy(F.col("title").alias("page")).agg(F.min("doc_set").alias("doc_set")))
    left = saved(titles.select(F.col("title").alias("asked")).where(F.trim("title") != "").distinct())
    fold = lambda c: F.lower(F.trim(c))
    best = None
    for m in dict.fromkeys([mode, *modes]):
        if m in ("exact", "case_insensitive"):
            key = F.trim if m == "exact" else fold
            near = left.withColumn("__k", key(F.col("asked"))).join(names.select("page", key(F.col("page")).alias("__k")), "__k").select("asked", "page", F.lit(1.0).alias("similarity"))
        elif m == "fuzzy":
            near = similarity.similar_pairs(left, names.select("page"), "page", fuzzy, best=1)
        else:
            forms = names.select("page", fold(F.col("page")).alias("name"))
            held = layers.holding(left.select(fold(F.col("asked")).alias("asked")).distinct(), forms.select("name").distinct())
            near = held.withColumnRenamed("asked", "__q").join(forms, "name").join(left.withColumn("__q", fold(F.col("asked"))), "__q")
            near = near.select("asked", "page", (F.length("__q") / F.greatest(F.length("name"), F.lit(1))).alias("similarity"))
        w = Window.partitionBy("asked").orderBy(F.desc("similarity"), F.asc_nulls_last("doc_set"), "page")
        hit = near.join(names, "page").withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1)
        hit = saved(hit.select("asked", "doc_set", "page", F.lit(m).alias("mode"), F.col("similarity").cast("double").alias("similarity")))
        best = hit if best is None else best.unionByName(hit)
        left = saved(left.join(hit.select("asked"), "asked", "left_anti"))
        if left.isEmpty():
            break
    keys = best.select(F.col("doc_set").alias("__d"), F.col("page").alias("__p")).distinct()
    same = F.col("doc_set").eqNullSafe(F.col("__d")) & (F.col("page") == F.col("__p"))
    text = pages.select("doc_set", F.col("title").alias("page"), "content").join(keys, same, "left_semi").dropDuplicates(["doc_set", "page"])
    found = best.join(text.select(F.col("doc_set").alias("__d"), F.col("page").alias("__p"), "content"), same)
    return found.select(F.col("asked").alias("title"), "doc_set", "page", "mode", "similarity", "content")


def candidates(pages: DataFrame, query: str, least: float = 0.5, k: int = 10) -> DataFrame:
    """Titles from a ratio on, with a preview of 200 characters."""
    found = R.match_titles(pages, query, "fuzzy", threshold=least)
    return found.select("doc_set", "title", "similarity", F.left("content", F.lit(200)).alias("preview")).limit(k)


def info(pages: DataFrame, title: str) -> DataFrame:
    """Size of the page of that title, in the first doc set that has it."""
    found = pages.where(F.col("title") == title).orderBy("doc_set").limit(1)
    return found.select("doc_set", "title", F.length("content").alias("chars"), F.size(F.split("content", "\n")).alias("lines"))


def first_doc_set(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """titles (title) -> (title, doc_set): the first doc set that has a page of that title."""
    return titles.select("title").distinct().join(pages.select("title", "doc_set"), "title").groupBy("title").agg(F.min("doc_set").alias("doc_set"))


def matched_terms(found: DataFrame, k: int = 5) -> DataFrame:
    """One row for each query of bm25.search(): the terms that its first k documents match."""
    return found.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))


def listing(pages: DataFrame) -> DataFrame:
    return pages.select("doc_set", "title").distinct().orderBy("doc_set", "title")


def as_text(found: DataFrame) -> DataFrame:
    """Pages of a search as lines: the page, its path, its headings."""
    heads = F.array_join(F.transform("headings", lambda h: F.concat(F.lit("  - "), h["text"])), "\n")
    return found.select("doc_set", "page_title", F.concat_ws("\n", F.concat_ws(": ", "doc_set", "page_title"), F.concat(F.lit("  "), "toc_path"), F.nullif(heads, F.lit(""))).alias("text"))
