"""Ranking operators: cosine reranking, cuts, fusion of several searches, title matching, composite scores."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import similarity, vectors
from lakeloom.functions import text as T

SOURCE_WEIGHTS = {"title": 1.0, "toc": 0.95, "preview": 0.8}


def in_blocks(queries: DataFrame, candidates: DataFrame, each: Callable, schema: str, block_mb: float = 64) -> DataFrame:
    """queries (query_id, v) against all candidates (id, v): each(query ids, query vectors, ids, vectors) gives the columns of
    `schema` for a batch of candidates; vectors are scaled to length 1 before they meet. Queries are broadcast in blocks of
    block_mb at most, one pass over the candidates for each block."""
    spark = candidates.sparkSession
    q = queries.select("query_id", vectors.unit(F.col("v")).alias("v")).where(F.col("v").isNotNull())
    size = q.agg(F.sum(F.size("v") * 8 + 16).alias("b")).first()["b"] or 0
    blocks = max(1, math.ceil(size / (block_mb * 1e6)))
    c = candidates.select("id", vectors.unit(F.col("v")).alias("v")).where(F.col("v").isNotNull())
    names, out = [x.split()[0] for x in schema.split(", ")], None
    for k in range(blocks):
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        rows = own.collect()  # of bounded size
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["v"] for r in rows], np.float64)))

        def run(batches, shared=shared):
            ids, m = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(y) for y in each(ids, m, part.column(0).to_pylist(), x)], names)

        got = c.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out


def _kinds(queries: DataFrame, candidates: DataFrame) -> tuple[str, str]:
    return queries.schema["query_id"].dataType.simpleString(), candidates.schema["id"].dataType.simpleString()


def similarities(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """queries (query_id, v) x candidates (id, v) -> (query_id, id, sim): all of them, for a stated query set."""
    q, c = _kinds(queries, candidates)

    def each(q_ids, m, ids, x):
        return np.repeat(np.array(q_ids, object), len(ids)).tolist(), list(ids) * len(q_ids), (m @ x.T).ravel()

    return in_blocks(queries, candidates, each, f"query_id {q}, id {c}, sim double")


def nearest(queries: DataFrame, candidates: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, id, sim, rank): each query's k most similar candidates, by the rounded similarity, ties by id. Of a batch of
    candidates only what can be among the k goes on."""
    q, c = _kinds(queries, candidates)

    def each(q_ids, m, ids, x):
        sim = np.round(m @ x.T, digits)
        order = np.argsort(np.array(ids), kind="stable")
        rows = [order[np.argsort(-s[order], kind="stable")[:k]] for s in sim]
        return [q for q, r in zip(q_ids, rows) for _ in r], [ids[i] for r in rows for i in r], np.concatenate([s[r] for s, r in zip(sim, rows)])

    return top(in_blocks(queries, candidates, each, f"query_id {q}, id {c}, sim double"), k)


def most_similar(queries: DataFrame, candidates: DataFrame, digits: int | None = None) -> DataFrame:
    """(id, sim): each candidate's highest similarity over all queries; a candidate that repeats has one row."""
    q, c = _kinds(queries, candidates)

    def each(q_ids, m, ids, x):
        best = (m @ x.T).max(axis=0)
        return ids, best if digits is None else np.round(best, digits)

    return best(in_blocks(queries, candidates, each, f"id {c}, sim double"))


def top(sims: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best(sims: DataFrame) -> DataFrame:
    """Each candidate's highest similarity over all queries."""
    return sims.groupBy("id").agg(F.max("sim").alias("sim"))


def rerank(pages: DataFrame, headings: DataFrame, page_sim: DataFrame, heading_sim: DataFrame, threshold: float, precision: float) -> tuple[DataFrame, DataFrame]:
    """pages (page) and headings (page, heading) with their best similarities. A page at both thresholds stands whole: its
    headings go. Headings are basic from the threshold on."""
    p = pages.join(page_sim.select(F.col("id").alias("page"), F.col("sim").alias("rerank_sim")), "page", "left")
    whole = p.where((F.col("rerank_sim") >= threshold) & (F.col("rerank_sim") >= precision)).select("page")
    h = headings.join(heading_sim.select(F.col("id").alias("heading"), F.col("sim").alias("rerank_sim")), "heading", "left").withColumn("is_basic", F.col("rerank_sim") >= threshold)
    return p, h.join(whole, "page", "left_anti")


def reranked_headings(headings: DataFrame, threshold: float, top_k: int | None = None) -> DataFrame:
    """Headings from the threshold on, precise from 0.2 above, best first in each page."""
    w = Window.partitionBy("page").orderBy(F.desc("rerank_sim"), "heading")
    out = headings.where(F.col("rerank_sim") >= threshold).withColumn("is_precision", F.col("rerank_sim") >= threshold + 0.2).withColumn("rank", F.row_number().over(w))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def quantile_cut(scored: DataFrame, score: str, ratio: float = 0.6, ties: str = "id") -> DataFrame:
    """The rows that score at least what the row at place int(n * ratio) scores, counted from the best.

    The place is found from counts of scores, of which only those at the cut matter: sums by score, then a running sum."""
    counts = scored.groupBy(score).agg(F.count("*").alias("__c"))
    n = scored.agg(F.count("*").alias("__n"))
    # Running sums within 1/64 of a score, and over those slices, of which there are few.
    parts = counts.withColumn("__s", F.floor(F.col(score) * 64))
    slices = parts.groupBy("__s").agg(F.sum("__c").alias("__t")).withColumn("__before", F.sum("__t").over(Window.orderBy(F.desc("__s"))) - F.col("__t"))
    run = parts.join(slices, "__s").withColumn("__upto", F.col("__before") + F.sum("__c").over(Window.partitionBy("__s").orderBy(F.desc(score))))
    cut = run.crossJoin(n).where(F.col("__upto") > F.least(F.floor(F.col("__n") * ratio), F.col("__n") - 1)).agg(F.max(score).alias("__cut"))
    return scored.crossJoin(F.broadcast(cut)).where(F.col(score) >= F.col("__cut")).drop("__cut")  # cut is one row


def merged_headings(rows: DataFrame) -> DataFrame:
    """Rows (doc_set, page, heading, bm25, ctx, source, pos) of several searches -> one row for each heading of a page, by its
    normal text: the best score's row, context and source filled in from the others; headings without text stay as they are."""
    key = T.normal_heading(F.col("heading"))
    rows = rows.withColumn("__key", F.when(key == "", F.concat(F.lit("\x00"), F.col("pos").cast("string"))).otherwise(key))
    w = Window.partitionBy("doc_set", "page", "__key").orderBy(F.desc(F.coalesce("bm25", F.lit(0.0))), "pos")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ctx = F.first(F.when(F.col("ctx") != "", F.col("ctx")), ignorenulls=True).over(every)
    lent = F.first(F.when(F.col("ctx") != "", F.col("source")), ignorenulls=True).over(every)
    out = rows.withColumns({"__n": F.row_number().over(w), "__ctx": ctx, "__lent": lent})
    gets = (F.coalesce("ctx", F.lit("")) == "") & F.col("__ctx").isNotNull()
    return out.where(F.col("__n") == 1).withColumn("source", F.when(gets & (F.col("__lent") == "FALLBACK_2"), F.col("__lent")).otherwise(F.col("source"))).withColumn("ctx", F.coalesce(F.when(F.col("ctx") != "", F.col("ctx")), "__ctx", F.lit(""))).drop("__n", "__ctx", "__lent", "__key")


def merged_pages(headings: DataFrame, precision: float = 0.7) -> DataFrame:
    """merged_headings' rows -> pages: counts, precise counts, the best score, whether any heading is precise."""
    return headings.groupBy("doc_set", "page").agg(
        F.count("*").alias("heading_count"),
        F.count_if(F.col("bm25") >= precision).alias("precision_count"),
        F.max(F.coalesce("bm25", F.lit(0.0))).alias("score"),
        F.bool_or(F.coalesce(F.col("bm25") >= precision, F.lit(False))).alias("is_precision"),
    )


def combined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two searches' heading rows, those of `first` leading: equal headings of a page are one, with first's values and
    second's context where it has none."""
    rows = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)))
    key = T.normal_heading(F.col("heading"))
    rows = rows.withColumn("__key", F.when(key == "", F.concat(F.lit("\x00"), F.col("__side").cast("string"), F.col("pos").cast("string"))).otherwise(key))
    w = Window.partitionBy("doc_set", "page", "__key").orderBy("__side", "pos")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ctx = F.first(F.when(F.col("ctx") != "", F.col("ctx")), ignorenulls=True).over(every)
    own = F.max(F.when(F.col("source") == "FALLBACK_2", F.col("source"))).over(every)
    out = rows.withColumns({"__n": F.row_number().over(w), "__ctx": ctx, "__own": own})
    return out.where(F.col("__n") == 1).withColumns({"ctx": F.coalesce("__ctx", F.lit("")), "source": F.coalesce("__own", "source")}).drop("__n", "__ctx", "__own", "__key", "__side")


def after_rerank(headings: DataFrame, threshold: float, least: int = 1) -> DataFrame:
    """Rows (page, page_sim, pos, heading, heading_sim) -> what stays: a page from the threshold on as one row without
    heading, else headings from it on; if fewer than `least` pages are left, the best headings once more, each with its page."""
    whole = headings.where(F.col("page_sim") >= threshold).select("page", "page_sim", F.lit(None).cast("string").alias("heading"), F.lit(None).cast("double").alias("heading_sim")).distinct()
    some = headings.where(F.coalesce(F.col("page_sim") < threshold, F.lit(True)) & (F.col("heading_sim") >= threshold)).select("page", "page_sim", "heading", "heading_sim")
    kept = whole.unionByName(some)
    n = kept.agg(F.count_distinct("page").alias("__pages"))
    more = some.orderBy(F.desc("heading_sim"), "page", "heading").limit(least).crossJoin(F.broadcast(n)).where(F.col("__pages") < least).drop("__pages")
    return kept.unionByName(more).distinct()


def first_pages(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """headings (heading) and pages (pos, page, heading) -> each heading with the first page that has one of the same text."""
    w = Window.partitionBy("heading").orderBy("pos", "page")
    first = pages.join(headings.select("heading").distinct(), "heading").withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1)
    return headings.join(first.select("heading", "page", "pos"), "heading")


def title_layers(titles: DataFrame, query: str, title_col: str = "title", k: int | None = 20, fuzzy: float | None = None) -> DataFrame:
    """`similarity` and `match_type`: equal 1, begins with 0.9, contains 0.7, and, from `fuzzy` on, the block ratio. Only
    titles that no layer takes are compared by ratio. Without k all matches are returned."""
    low, q = F.lower(T.normal_title(F.col(title_col))), query.strip().lower()
    kind = F.when(low == q, "exact").when(low.startswith(q), "prefix").when(low.contains(q), "partial")
    score = F.when(low == q, 1.0).when(low.startswith(q), 0.9).when(low.contains(q), 0.7)
    out = titles.withColumns({"match_type": kind, "similarity": score})
    if fuzzy is not None:
        r = similarity.ratio(F.lit(query), F.col(title_col))
        rest = out.where(F.col("match_type").isNull()).withColumn("similarity", r).where(F.col("similarity") >= fuzzy).withColumn("match_type", F.lit("fuzzy"))
        out = out.where(F.col("match_type").isNotNull()).unionByName(rest)
    out = out.where(F.col("match_type").isNotNull()).orderBy(F.desc("similarity"), title_col)
    return out if k is None else out.limit(k)


def match_titles(titles: DataFrame, query: str, mode: str = "exact", any_case: bool = True, threshold: float = 0.6, title_col: str = "title") -> DataFrame:
    """Titles that match by one mode: exact, case_insensitive, partial, fuzzy; best first."""
    fold = (lambda c: F.lower(F.trim(c))) if any_case or mode != "exact" else F.trim
    t, q = fold(F.col(title_col)), fold(F.lit(query))
    if mode == "fuzzy":
        return titles.withColumn("similarity", similarity.ratio(F.lit(query), F.col(title_col))).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), title_col)
    test = t.contains(q) if mode == "partial" else t == q
    return titles.where(test).withColumn("similarity", F.when(t == q, 1.0).otherwise(F.length(q) / F.greatest(F.length(t), F.lit(1)))).orderBy(F.desc("similarity"), title_col)


def first_mode_that_hits(titles: DataFrame, query: str, modes: tuple[str, ...] = ("exact", "case_insensitive", "partial", "fuzzy")) -> DataFrame:
    """The best title of the first mode that has any: all modes in one plan, the least mode first."""
    every = None
    for i, m in enumerate(modes):
        found = match_titles(titles, query, m, any_case=m != "exact").withColumn("mode_rank", F.lit(i)).withColumn("mode", F.lit(m))
        every = found if every is None else every.unionByName(found)
    return every.orderBy("mode_rank", F.desc("similarity"), "title").limit(1)


def best_of_title(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row for each title: that of the weightiest source, then the highest similarity."""
    w = Window.partitionBy("title").orderBy(F.desc(source_weight(F.col("source"), weights)), F.desc("similarity"), "match_type")
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def source_weight(source: Column, weights: dict[str, float] | None = None) -> Column:
    out = F.lit(0.5)
    for k, v in (weights or SOURCE_WEIGHTS).items():
        out = F.when(source == k, v).otherwise(out)
    return out


def composite(rows: DataFrame, query: str, weights: dict[str, float] | None = None) -> DataFrame:
    """`similarity` anew: 0.6 of it, 0.2 of the source's weight, 0.1 of the query's words in the title, 0.05 for each
    matched section up to 0.15; 1 at most."""
    asked = sorted(set(query.lower().split()))
    cover = F.size(F.array_intersect(F.array(*map(F.lit, asked)), F.split(F.lower("title"), r"\s+"))) / max(1, len(asked)) if asked else F.lit(0.0)
    boost = F.least(F.lit(0.15), F.coalesce(F.size("sections"), F.lit(0)) * 0.05)
    total = F.col("similarity") * 0.6 + source_weight(F.col("source"), weights) * 0.2 + cover * 0.1 + F.greatest(boost, F.lit(0.0))
    return rows.withColumn("similarity", F.least(F.lit(1.0), total))


def diverse(rows: DataFrame, boost: float = 0.1) -> DataFrame:
    """The first row of each source gets the boost, up to 1; the order stays that of before, in `rank`."""
    n = rows.agg(F.count("*").alias("__n"))
    first = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("similarity"), "title"))
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), "title"))  # after the caps, so of a few rows
    out = rows.withColumns({"rank": rank, "__f": first}).crossJoin(F.broadcast(n))
    return out.withColumn("similarity", F.when((F.col("__f") == 1) & (F.col("__n") > 1), F.least(F.lit(1.0), F.col("similarity") + boost)).otherwise(F.col("similarity"))).drop("__f", "__n")


def quality(rows: DataFrame) -> DataFrame:
    """One row: count, highest and mean similarity, sources and kinds of match, and whether that satisfies."""
    m = rows.agg(F.count("*").alias("count"), F.max("similarity").alias("max_similarity"), F.avg("similarity").alias("avg_similarity"), F.count_distinct("source").alias("source_diversity"), F.count_distinct("match_type").alias("match_type_diversity"))
    good = (F.col("count") >= 3) & (F.col("max_similarity") >= 0.7) & (F.col("source_diversity") >= 1)
    hint = F.when(F.col("count") == 0, "expand_search").when(good, F.lit(None).cast("string")).when(F.col("max_similarity") < 0.5, "lower_threshold").when(F.col("count") < 3, "expand_search")
    return m.withColumns({"satisfactory": F.coalesce(good, F.lit(False)), "suggestion": hint})


def preview_scores(rows: DataFrame, score: str, to: str) -> DataFrame:
    """`to`: 0.3 to 0.7, by the share of the best of all scores, which is one row."""
    most = rows.agg(F.max(score).alias("__most"))
    return rows.crossJoin(F.broadcast(most)).withColumn(to, F.when(F.col("__most") > 0, 0.3 + F.col(score) / F.col("__most") * 0.4).otherwise(0.3)).drop("__most")


def section_score(query: Column, heading: Column, content: Column) -> Column:
    """0.7 of the heading's ratio, 0.3 if the content has the query, a fifth more with a code block."""
    base = similarity.ratio(query, heading) * 0.7 + F.when(F.lower(content).contains(F.lower(query)), 0.3).otherwise(0.0)
    return base * F.when(content.contains("```"), 1.2).otherwise(1.0)


def toc_relevance(title: Column, query: str) -> Column:
    low, q = F.lower(title), query.lower()
    return F.when(low.startswith(q), 1.0).when(low.contains(q), 0.7).otherwise(similarity.ratio(F.lit(query), title))


def relaxed(threshold: Column, by: float = 0.1) -> Column:
    return F.round(F.greatest(F.lit(0.0), threshold - by), 2)
