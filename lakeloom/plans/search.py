"""Unified search over a corpus: ranking of tables of contents, two fallbacks, merging, reranking, final filter.

Pages and tables of contents are tables (doc_set, title, content). A search is one plan; what it finds are heading rows,
folded to pages at the end. Each doc set is a corpus of its own: counts are by doc set.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators import bm25
from lakeloom.operators import lines as L
from lakeloom.operators import ranking as R
from lakeloom.operators.cut import saved
from lakeloom.operators.retrieval import CAPS
from lakeloom.plans import config

SET = ["doc_set", "page"]


@dataclass(frozen=True)
class Options:
    page_threshold: float = 0.6
    heading_threshold: float = 0.25
    precision_threshold: float = 0.7
    least_pages: int = 2
    top_k: int = 100
    content_cap: int = CAPS["content"]
    context_lines: int = 100
    context_words: int = 100
    lang_threshold: float = 0.9
    lowest_level_only: bool = False
    serial: bool = False
    nouns: list[str] = field(default_factory=list)
    verbs: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    rerank_scopes: tuple[str, ...] = ()
    rerank_threshold: float = 0.6
    local_rerank_ratio: float = 0.8
    bm25: bm25.Params = field(default_factory=lambda: bm25.Params(stemmed=False))


class LanguageMismatch(ValueError):
    pass


def usable_queries(queries: list[str], o: Options) -> list[str]:
    """The queries without skipped words, which is done only if there are nouns; empty ones go, unless all would."""
    if not (o.nouns and o.skipped):
        return queries
    out = queries
    for w in o.skipped:
        if w.strip():
            out = [re.sub(re.escape(w.strip()), "", q, flags=re.I) for q in out]
    out = [re.sub(r"\s+", " ", q).strip() for q in out]
    return [q for q in out if q] or queries


def corpus_language(tocs: DataFrame, o: Options, sample: int = 5) -> DataFrame:
    """(doc_set, lang) by the headings of each set's first tables of contents."""
    w = Window.partitionBy("doc_set").orderBy("title")
    some = tocs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= sample)
    heads = F.filter(F.split("content", "\n"), lambda s: F.trim(s).startswith("#"))
    return some.groupBy("doc_set").agg(F.array_join(F.flatten(F.collect_list(heads)), " ").alias("t")).select("doc_set", T.language(F.col("t"), o.lang_threshold).alias("lang"))


def check_language(tocs: DataFrame, queries: list[str], o: Options) -> None:
    """Raises if a query is in another language than a doc set that is searched."""
    cjk = re.compile(T.CJK_RE)
    asked = {"zh" if q.strip() and len(cjk.findall(q)) / len(q.strip()) >= o.lang_threshold else "en" for q in queries}
    odd = [r["doc_set"] for r in corpus_language(tocs, o).where(~F.col("lang").isin(list(asked))).orderBy("doc_set").limit(10).collect()]
    if odd:
        raise LanguageMismatch(f"queries are in {sorted(asked)}, which is not the language of {odd}")  # the first ten of them


def recall(tocs: DataFrame, queries: DataFrame, o: Options) -> DataFrame:
    """Heading rows of pages whose table of contents ranks from the page threshold on for any query (q, query)."""
    p = o.bm25
    tocs = tocs.withColumnRenamed("title", "page")
    terms = bm25.exploded(tocs.withColumn("id", F.struct(*SET)), "id", "content", p).select("doc.doc_set", "doc.page", "term")
    tf = terms.groupBy(*SET, "term").agg(F.count("*").alias("tf"))
    dl = tocs.select(*SET).join(tf.groupBy(*SET).agg(F.sum("tf").alias("len")), SET, "left").fillna(0, ["len"])
    df = tf.groupBy("doc_set", "term").agg(F.count("*").alias("df"))
    stats = dl.groupBy("doc_set").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    asked = bm25.exploded(queries, "q", "query", p).groupBy(F.col("doc").alias("q"), "term").agg(F.count("*").alias("times"))
    part = F.col("times") * bm25.idf(F.col("n"), F.col("df")) * bm25.weight(F.col("tf"), F.col("len"), F.col("avg_len"), p)
    scored = tf.join(asked, "term").join(df, ["doc_set", "term"]).join(stats, "doc_set").join(dl, SET).groupBy(*SET, "q").agg(F.sum(part).alias("s"))
    pages = scored.groupBy(*SET).agg(F.max("s").alias("page_score")).where(F.col("page_score") >= o.page_threshold)
    pages = pages.withColumn("__n", F.row_number().over(Window.partitionBy("doc_set").orderBy(F.desc("page_score"), "page"))).where(F.col("__n") <= o.top_k).drop("__n")
    heads = L.toc(L.explode(tocs, "content")).join(pages.select(*SET), SET, "left_semi")
    own = bm25.own_scores(heads, [*SET, "line_no"], "text", queries, "q", "query", replace(p, stemmed=False))
    heads = heads.join(own, [*SET, "line_no"]).withColumnRenamed("score", "bm25").where(F.col("bm25") >= o.heading_threshold)
    heads = L.lowest_level_only(heads, SET) if o.lowest_level_only else heads
    kept = pages.join(heads.select(*SET, "text", "level", "bm25", F.col("line_no").alias("pos")), SET, "left")
    heading = F.when(F.col("text").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text")))
    return kept.select(*SET, heading.alias("heading"), "bm25", F.lit("").alias("ctx"), F.lit("BM25").alias("source"), F.coalesce("pos", F.lit(0)).alias("pos"), "page_score")


def rows_like(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_set string, page string, heading string, bm25 double, ctx string, source string, pos int, page_score double")


def by_keywords(tocs: DataFrame, queries: list[str], keywords: list[str]) -> DataFrame:
    """First fallback: headings of tables of contents that hold a keyword of the queries."""
    if not keywords:
        return rows_like(tocs.sparkSession)
    pattern = "(?iu)" + "|".join(re.escape(k) for k in keywords)
    found = L.explode(tocs.withColumnRenamed("title", "page"), "content").where(F.col("line").rlike(pattern) & F.trim("line").rlike(r"^#{1,6}\s+\S"))
    return found.select(*SET, T.strip_heading_url(F.trim("line"), keep_hash=True).alias("heading"), F.lit(0.0).alias("bm25"), F.lit("").alias("ctx"), F.lit("FALLBACK_1").alias("source"), F.col("line_no").alias("pos"), F.lit(None).cast("double").alias("page_score"))


def by_content(pages: DataFrame, o: Options) -> DataFrame:
    """Second fallback: lines that hold a noun, by the heading above them, with the context around; one row for each
    heading of a page, `content_cap` in all."""
    if not o.nouns:
        return rows_like(pages.sparkSession)
    pages = pages.withColumnRenamed("title", "page")
    pattern = "(?iu)" + "|".join(re.escape(n) for n in o.nouns)
    lines = L.with_heading_above(L.explode(pages, "content"), SET, o.context_lines)
    hits = lines.where(F.col("line").rlike(pattern) & F.col("heading").isNotNull())
    first = hits.withColumn("__n", F.row_number().over(Window.partitionBy(*SET, "heading").orderBy("line_no"))).where(F.col("__n") == 1)
    few = first.orderBy(*SET, "line_no").limit(o.content_cap).select(*SET, "heading", "line_no")
    ctx = few.join(pages.select(*SET, "content"), SET).withColumn("ctx", L.context(F.col("content"), F.col("line_no"), o.context_words))
    return ctx.select(*SET, "heading", F.lit(0.0).alias("bm25"), "ctx", F.lit("FALLBACK_2").alias("source"), F.col("line_no").alias("pos"), F.lit(None).cast("double").alias("page_score"))


def with_scores(rows: DataFrame, queries: DataFrame, o: Options) -> DataFrame:
    """Fallback headings scored against the queries by themselves; stems count here."""
    text = rows.select(*SET, "heading", F.regexp_replace("heading", r"^#+\s*", "").alias("t")).distinct()
    own = bm25.own_scores(text, [*SET, "heading"], "t", queries, "q", "query", replace(o.bm25, stemmed=True))
    return rows.drop("bm25").join(own, [*SET, "heading"], "left").withColumn("bm25", F.coalesce("score", F.lit(0.0))).drop("score")


def reranked(rows: DataFrame, queries: list[str], encode: Callable[[Column], Column], o: Options) -> DataFrame:
    """`page_sim` and `heading_sim` by an encoder (text -> unit vector), best over the queries; pages at both thresholds
    lose their headings if only page titles are compared."""
    spark = rows.sparkSession
    q = spark.createDataFrame([(i, t) for i, t in enumerate(queries)], "query_id int, t string").select("query_id", encode(T.for_rerank(F.col("t"), o.nouns, o.verbs, o.skipped)).alias("v"))

    def best(texts: Column) -> DataFrame:
        c = rows.select(texts.alias("id")).where(F.col("id").isNotNull()).distinct()
        return R.most_similar(q, c.select("id", encode(T.for_rerank(F.col("id"), o.nouns, o.verbs, o.skipped)).alias("v")))

    if "page_title" in o.rerank_scopes:
        rows = rows.join(best(F.col("page")).select(F.col("id").alias("page"), F.col("sim").alias("page_sim")), "page", "left")
    else:
        rows = rows.withColumn("page_sim", F.lit(None).cast("double"))
    if "headings" in o.rerank_scopes:
        return rows.join(best(F.col("heading")).select(F.col("id").alias("heading"), F.col("sim").alias("heading_sim")), "heading", "left")
    whole = (F.col("page_sim") >= o.rerank_threshold) & (F.col("page_sim") >= o.precision_threshold)
    return rows.withColumn("heading_sim", F.lit(None).cast("double")).withColumn("heading", F.when(~F.coalesce(whole, F.lit(False)), F.col("heading")))


def local_rerank(rows: DataFrame, queries: list[str], encode: Callable[[Column], Column], o: Options) -> DataFrame:
    """Of the second fallback's rows the best share by meaning of their contexts; other rows stay."""
    mine = rows.where((F.col("source") == "FALLBACK_2") & (F.col("ctx") != ""))
    rest = rows.where(~((F.col("source") == "FALLBACK_2") & (F.col("ctx") != "")))
    q = rows.sparkSession.createDataFrame([(i, t) for i, t in enumerate(queries)], "query_id int, t string").select("query_id", encode(F.col("t")).alias("v"))
    sims = R.most_similar(q, mine.select(F.col("ctx").alias("id")).distinct().select("id", encode(F.col("id")).alias("v")))
    cut = R.quantile_cut(mine.join(sims.withColumnRenamed("id", "ctx"), "ctx"), "sim", o.local_rerank_ratio)
    return rest.unionByName(cut.select(*rest.columns))


def folded(rows: DataFrame, o: Options) -> DataFrame:
    """Heading rows -> pages (doc_set, page_title, toc_path, score, flags, counts, headings), best first."""
    extra = [c for c in ("page_sim", "heading_sim") if c in rows.columns]
    one = F.struct("pos", F.col("heading").alias("text"), T.heading_level(F.col("heading")).alias("level"), F.col("bm25").alias("bm25_sim"), (F.col("bm25") >= o.heading_threshold).alias("is_basic"), (F.col("bm25") >= o.precision_threshold).alias("is_precision"), F.col("heading_sim" if extra else "bm25").cast("double").alias("rerank_sim") if extra else F.lit(None).cast("double").alias("rerank_sim"), F.col("ctx").alias("related_context"), "source")
    out = rows.groupBy(*SET).agg(
        F.greatest(F.max("page_score"), F.max(F.coalesce("bm25", F.lit(0.0)))).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("heading").isNotNull(), one))).alias("headings"),
        *([F.max("page_sim").alias("rerank_sim")] if extra else [F.lit(None).cast("double").alias("rerank_sim")]),
    )
    out = out.withColumns({"heading_count": F.size("headings"), "precision_count": F.size(F.filter("headings", lambda h: h["is_precision"])), "toc_path": F.concat_ws("/", "doc_set", "page", F.lit("docTOC.md"))})
    return out.withColumns({"is_basic": F.col("score") >= o.heading_threshold, "is_precision": F.col("score") >= o.precision_threshold}).withColumnRenamed("page", "page_title").orderBy(F.desc("score"), "doc_set", "page_title").limit(o.top_k)


def search(pages: DataFrame, tocs: DataFrame, queries: list[str], doc_sets: list[str] | None = None, options: Options | None = None, encode: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pages that answer the queries, with their headings.

    Both fallbacks always run and are merged with the ranking, whose headings lead; with `serial` a fallback runs only if
    there are fewer than least_pages so far. An encoder turns on what is compared by meaning.
    """
    o = options or Options()
    if doc_sets is not None:
        wanted = pages.sparkSession.createDataFrame([(d,) for d in doc_sets], "doc_set string")
        pages, tocs = pages.join(wanted, "doc_set", "left_semi"), tocs.join(wanted, "doc_set", "left_semi")
    queries = usable_queries(queries, o)
    check_language(tocs, queries, o)
    asked = pages.sparkSession.createDataFrame(list(enumerate(queries)), "q int, query string")
    words = [k for r in asked.select(T.keywords(F.col("query")).alias("k")).collect() for k in r["k"]]
    rows = saved(recall(tocs, asked, o))

    def enough() -> bool:
        return rows.select(*SET).distinct().limit(o.least_pages).count() >= o.least_pages

    for fallback in (lambda: by_keywords(tocs, queries, list(dict.fromkeys(words))), lambda: by_content(pages, o)):
        if o.serial and enough():
            break
        more = with_scores(saved(fallback()), asked, o)
        if encode is not None:
            more = local_rerank(more, queries, encode, o)
        scores = rows.groupBy(*SET).agg(F.max("page_score").alias("__p"))
        rows = R.combined(rows, R.merged_headings(more)).join(scores, SET, "left").withColumn("page_score", F.coalesce("page_score", "__p")).drop("__p")
        rows = saved(rows)
    rows = rows.where(F.col("heading").isNotNull() | F.col("page_score").isNotNull())
    if encode is not None and o.rerank_scopes:
        rows = reranked(rows, queries, encode, o)
    return saved(folded(rows, o))


def succeeded(found: DataFrame, o: Options | None = None) -> bool:
    return found.limit((o or Options()).least_pages).count() >= (o or Options()).least_pages


def with_paths(found: DataFrame, before: DataFrame) -> DataFrame:
    """`toc_path` put back where it is missing, from the results of an earlier phase, by doc set and page."""
    paths = before.select("doc_set", "page_title", F.col("toc_path").alias("__path")).dropDuplicates(["doc_set", "page_title"])
    have = F.nullif(F.col("toc_path"), F.lit("")) if "toc_path" in found.columns else F.lit(None).cast("string")
    return found.join(paths, ["doc_set", "page_title"], "left").withColumn("toc_path", F.coalesce(have, "__path")).drop("__path")


def heading_total(found: DataFrame) -> DataFrame:
    """One row (headings): all headings of all pages that were found."""
    return found.agg(F.coalesce(F.sum(F.greatest(F.size("headings"), F.lit(0))), F.lit(0)).alias("headings"))


def options_from(source: str | dict | None = None, **explicit) -> Options:
    """Options of a JSON file or dict; explicit ones win, and what neither names is as usual."""
    return config.options(Options, source, **explicit)


def projected(found: DataFrame, clear_rerank: bool = False) -> DataFrame:
    """The fields that later phases take."""
    h = F.transform("headings", lambda x: F.struct(x["text"].alias("text"), x["level"].alias("level"), F.when(F.lit(not clear_rerank), x["rerank_sim"]).alias("rerank_sim"), x["related_context"].alias("related_context")))
    return found.select("doc_set", "page_title", "toc_path", h.alias("headings"), F.when(F.lit(not clear_rerank), F.col("rerank_sim")).alias("rerank_sim"), "heading_count", "precision_count")


def to_rerank(found: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Pages for the reranker, and those that skip it: without headings, or with `most` and more."""
    n = F.size("headings")
    return found.where((n > 0) & (n < most)), found.where((n == 0) | (n >= most))


def options_of(found: dict, o: Options | None = None) -> Options:
    """Options from what the first phases give (see phases.py)."""
    return replace(o or Options(), nouns=list(found.get("domain_nouns") or []), verbs=list(found.get("predicate_verbs") or []), rerank_threshold=float(found.get("reranker_threshold", 0.63)))
