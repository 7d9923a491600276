"""Layered retrieval for a table of queries: titles, then headings, then previews, one plan for each layer.

A layer runs for all queries that those before did not satisfy; which these are is a table, and nothing of it comes to the
driver. Queries are (query_id, query) with distinct ids; blank ones find nothing. A title or heading that holds a query is
found by an equi-join on a gram of the query, that which fewest names hold; ratios are worked out only where bounds let them
reach the threshold. Equal names are compared once, however many pages share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import similarity
from lakeloom.functions import text as T
from lakeloom.operators import blockmax, bm25
from lakeloom.operators import lines as L
from lakeloom.operators import ranking as R
from lakeloom.operators.cut import saved
from lakeloom.operators.retrieval import CAPS

#: Characters of a gram: of a string that is asked, as many as it has room for. A longer gram is in fewer names.
GRAMS = (1, 2, 3, 8)
#: The least score of a name that holds a query, and what several relevant headings count more.
HELD, SEVERAL = 0.7, 0.1
FOUND = ["query_id", "doc_set", "title", "similarity", "match_type", "source", "sections", "preview"]


def grams(text: Column, size: Column | int) -> Column:
    """The distinct runs of `size` characters; none for shorter texts."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    return F.when((size > 0) & (last > 0), F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def holding(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (asked) and names (name), distinct strings -> (asked, name): the names that contain what is asked.

    Of the grams of an asked string that with the fewest names leads to them; if any of its grams is in no name, none holds
    it. Only grams that are asked for leave the names, and only of lengths that are asked for are they made.
    """
    size = F.lit(GRAMS[0])
    for n in GRAMS[1:]:
        size = F.when(F.length("asked") >= n, n).otherwise(size)
    some = asked.where(F.col("asked") != "").withColumn("size", size)
    a = some.select("asked", F.explode(grams(F.col("asked"), F.col("size"))).alias("gram"))
    sizes = sorted(r["size"] for r in some.select("size").distinct().collect()) or [GRAMS[0]]  # no more than GRAMS
    every = F.flatten(F.array(*[grams(F.col("name"), n) for n in sizes]))
    held = saved(names.select("name", F.explode(every).alias("gram")).join(a.select("gram").distinct(), "gram", "left_semi"))
    a = a.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    lead = a.groupBy("asked").agg(F.min(F.struct("n", "gram")).alias("lead"), F.bool_or(F.col("n").isNull()).alias("none")).where(~F.col("none"))
    return held.join(lead.select("asked", F.col("lead.gram").alias("gram")), "gram").where(F.col("name").contains(F.col("asked"))).select("asked", "name")


def alike(queries: DataFrame, names: DataFrame, folded: Column, score: Column, kind: Column, ratio: float | None, counter=None, best: int | None = None, below: float = 0.0, group_col: str | None = None) -> DataFrame:
    """(query, name, similarity, match_type) of distinct queries (query, asked) and names (name): `score` (HELD at least) and `kind`
    where `folded` of the name holds `asked`, and 'fuzzy' from `ratio` on for pairs where it does not. best, below and group_col: as
    similar_pairs() takes them; fuzzy pairs that cannot be among a query's best may be left out."""
    forms = names.select("name", folded.alias("form"))
    pairs = holding(queries.select("asked").distinct(), forms.select(F.col("form").alias("name")).distinct())
    inside = pairs.withColumnRenamed("name", "form").join(forms, "form").join(queries, "asked").select("query", "name", score.alias("similarity"), kind.alias("match_type"))
    if ratio is None:
        return inside
    inside = saved(inside)
    near = similarity.similar_pairs(queries.select(F.col("query").alias("asked")), names, "name", ratio, counter=counter, best=best, cap=HELD, below=below, group_col=group_col)
    near = near.select(F.col("asked").alias("query"), "name", "similarity").join(inside.select("query", "name"), ["query", "name"], "left_anti")
    return inside.unionByName(near.withColumn("match_type", F.lit("fuzzy")))


def _asked(queries: DataFrame, form: Column) -> DataFrame:
    return queries.where(F.trim(F.coalesce("query", F.lit(""))) != "").select("query", form.alias("asked")).distinct()


def _first(rows: DataFrame, k: int, *order) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def by_title(pages: DataFrame, queries: DataFrame, k: int = CAPS["titles"], fuzzy: float | None = 0.6, counter=None) -> DataFrame:
    """Equal titles 1, those that begin with the query 0.9, those that contain it 0.7, others by their ratio."""
    names = pages.select(F.col("title").alias("name")).where("name IS NOT NULL").distinct()
    low, q = F.col("form"), F.col("asked")
    score = F.when(low == q, 1.0).when(low.startswith(q), 0.9).otherwise(0.7)
    kind = F.when(low == q, "exact").when(low.startswith(q), "prefix").otherwise("partial")
    pairs = alike(_asked(queries, F.lower(F.trim("query"))), names, F.lower(T.normal_title(F.col("name"))), score, kind, fuzzy, counter, best=k)
    found = queries.join(pairs, "query").join(pages.select("doc_set", F.col("title").alias("name")), "name")
    return _row(_first(found.withColumnRenamed("name", "title"), k, F.desc("similarity"), "title", "doc_set"), "title")


def by_toc(tocs: DataFrame, queries: DataFrame, k: int = CAPS["toc"], sections: int = 20, least: float | None = 0.3, counter=None) -> DataFrame:
    """Pages by their most relevant headings: those that begin with the query 1, that contain it 0.7, others by their ratio
    from `least` on (without it they do not count). Several relevant ones count 0.1 more."""
    heads = L.toc(L.explode(tocs, "content")).select("doc_set", "title", "line_no", "text", F.trim(F.regexp_extract("line", r"^\s*#+\s+(.+)$", 1)).alias("name"))
    heads = saved(heads)
    score = F.when(F.col("form").startswith(F.col("asked")), 1.0).otherwise(0.7)
    names = heads.groupBy("name").agg(F.min(F.to_json(F.struct("doc_set", "title"))).alias("page"))
    # Only where a page has several headings can one that is less like the query bring it there.
    single = heads.groupBy("doc_set", "title").count().where("count > 1").isEmpty()
    pairs = alike(_asked(queries, F.lower("query")), names, F.lower("name"), score, F.lit("toc_section"), least, counter, best=k, below=0.0 if single else SEVERAL + 1e-9, group_col="page")
    pairs = pairs.select("query", "name", F.col("similarity").alias("rel"))
    if least is not None and not single:
        # Pages that may be among the best have all their headings, also those that alone would not have brought them there.
        pairs = saved(pairs)
        most = pairs.join(heads, "name").select("query", "doc_set", "title").distinct().join(heads.select("doc_set", "title", "name"), ["doc_set", "title"]).select("query", "name").distinct()
        rest = most.join(pairs, ["query", "name"], "left_anti").withColumn("rel", similarity.ratio(F.col("query"), F.col("name")))
        pairs = pairs.unionByName(rest.where(F.col("rel") >= least))
    rows = queries.join(pairs, "query").join(heads, "name")
    w = Window.partitionBy("query_id", "doc_set", "title").orderBy(F.desc("rel"), "line_no")
    ranked = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= sections)
    found = ranked.groupBy("query_id", "doc_set", "title").agg(F.max("rel").alias("best"), F.count("*").alias("c"), F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "text")))).alias("s"))
    found = found.withColumn("similarity", F.when(F.col("c") > 1, F.least(F.lit(1.0), F.col("best") + SEVERAL)).otherwise(F.col("best")))
    found = found.withColumns({"match_type": F.lit("toc_section"), "sections": F.col("s.text")})
    return _row(_first(found, k, F.desc("similarity"), "doc_set", "title"), "toc")


def by_preview(pages: DataFrame, queries: DataFrame, k: int = CAPS["previews"], lines: int = 50, least: float = 0.1) -> DataFrame:
    """Pages by BM25 over their first lines, blocks that cannot be among the k best unread; 0.3 to 0.7 by the share of the
    query's best score. A page is a doc set and a title."""
    p = saved(pages.select(F.struct("doc_set", "title").alias("id"), L.first_lines(F.col("content"), lines).alias("preview")).where(F.col("preview") != ""))
    ids = p.select("id").distinct().select(F.to_json("id").alias("key"), "id")
    keyed = p.select(F.to_json("id").alias("key"), "preview")
    index = bm25.build_for(queries, "query_id", "query", keyed, "key", "preview", bm25.Params(stemmed=False, most=None))
    found = blockmax.topk(index, queries, k).where(F.col("score") >= least)
    most = F.max("score").over(Window.partitionBy("query_id"))
    found = found.withColumn("similarity", F.when(most > 0, 0.3 + F.col("score") / most * 0.4).otherwise(0.3))
    short = F.when(F.length("preview") > 200, F.concat(F.left("preview", F.lit(200)), F.lit("..."))).otherwise(F.col("preview"))
    rows = found.select("query_id", F.col("doc").alias("key"), "similarity").join(ids, "key").join(keyed, "key")
    return _row(rows.select("query_id", "id.doc_set", "id.title", "similarity", F.lit("content_preview_bm25").alias("match_type"), short.alias("preview")), "preview")


def _row(df: DataFrame, source: str) -> DataFrame:
    none = {"sections": F.array().cast("array<string>"), "preview": F.lit(None).cast("string")}
    return df.withColumns({"source": F.lit(source), **{k: v for k, v in none.items() if k not in df.columns}}).select(*FOUND)


def satisfied(rows: DataFrame, least: int = 3, high: float = 0.7) -> DataFrame:
    """(query_id) of the queries whose rows satisfy: enough of them, a good one, several kinds of match or a very good one."""
    m = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max("similarity").alias("s"), F.count_distinct("match_type").alias("t"))
    return m.where((F.col("n") >= least) & (F.col("s") >= high) & ((F.col("t") >= 2) | (F.col("s") >= 0.8))).select("query_id")


def retrieve(pages: DataFrame, tocs: DataFrame, queries: DataFrame, counter=None) -> DataFrame:
    """The layers in turn, each for the queries that those before do not satisfy."""
    rows, left = None, queries.select("query_id", "query")
    for layer in (lambda q: by_title(pages, q, counter=counter), lambda q: by_toc(tocs, q, counter=counter), lambda q: by_preview(pages, q)):
        if rows is not None:
            left = saved(left.join(satisfied(rows), "query_id", "left_anti"))
        found = saved(layer(left))
        rows = found if rows is None else rows.unionByName(found)
    return rows


def rerank(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query one row a title, its composite score, and a boost for the first row of each source; `rank` is the order
    before the boost."""
    w = Window.partitionBy("query_id", "title").orderBy(F.desc(R.source_weight(F.col("source"))), F.desc("similarity"), "match_type", "doc_set")
    one = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")
    asked = F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda x: x != ""))
    words = queries.select("query_id", asked.alias("__words"))
    cover = F.size(F.array_intersect("__words", F.split(F.lower("title"), r"\s+"))) / F.greatest(F.size("__words"), F.lit(1))
    boost = F.least(F.lit(0.15), F.greatest(F.size("sections"), F.lit(0)) * 0.05)
    total = F.col("similarity") * 0.6 + R.source_weight(F.col("source")) * 0.2 + cover * 0.1 + boost
    out = one.join(words, "query_id").withColumn("similarity", F.least(F.lit(1.0), total)).drop("__words")
    by = Window.partitionBy("query_id")
    first = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("similarity"), "title"))
    out = out.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("similarity"), "title")), "__f": first, "__c": F.count("*").over(by)})
    more = (F.col("__f") == 1) & (F.col("__c") > 1)
    return out.withColumn("similarity", F.when(more, F.least(F.lit(1.0), F.col("similarity") + 0.1)).otherwise(F.col("similarity"))).drop("__f", "__c")


def expansions(query: Column, most: int = 2) -> Column:
    """Single words over three letters, then pairs of neighbours, in the order of the query; not the query itself."""
    words = T.words(query)
    # sequence() would count down for fewer than two words.
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) > 3), pairs))
    return F.slice(F.filter(every, lambda e: e != F.lower(query)), 1, most)


def good(rows: DataFrame) -> DataFrame:
    """(query_id) of the queries with at least three rows, of which one reaches 0.7."""
    m = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max("similarity").alias("s"))
    return m.where((F.col("n") >= 3) & (F.col("s") >= 0.7)).select("query_id")


def match(pages: DataFrame, tocs: DataFrame, queries: DataFrame, k: int = CAPS["final"], turns: int = 3) -> DataFrame:
    """Retrieve and rerank; queries that are not good yet are asked again by an expansion, one more in each turn."""
    asked = queries.select("query_id", "query")
    rows, more = retrieve(pages, tocs, asked), saved(asked.select("query_id", expansions(F.col("query"), max(0, turns - 1)).alias("more")))
    for turn in range(max(0, turns - 1)):
        left = more.join(good(rows), "query_id", "left_anti").select("query_id", F.get("more", F.lit(turn)).alias("query")).where("query IS NOT NULL")
        rows = rows.unionByName(retrieve(pages, tocs, saved(left)))
    return rerank(rows, asked).where(F.col("rank") <= k)
