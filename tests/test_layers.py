"""Layered retrieval for a table of queries, held against a plain loop with one query at a time."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lakeloom.catalog.plans import PAGES, TOCS
from lakeloom.operators import layers, retrieval

QUERIES = ["agent skills", "hook events", "skils", "x", "  ", "Guide"]


def asked(spark, queries=None):
    return spark.createDataFrame(list(enumerate(queries or QUERIES)), "query_id int, query string")


def rows(df):
    return sorted((r["doc_set"], r["title"], round(r["similarity"], 6), r["match_type"], r["source"], tuple(r["sections"] or ()), r["preview"]) for r in df.collect())


def test_equals_one_query_at_a_time(spark):
    pages, tocs = PAGES.df(spark), TOCS.df(spark)
    got = layers.retrieve(pages, tocs, asked(spark)).cache()
    for k, q in enumerate(QUERIES):
        mine = rows(got.where(F.col("query_id") == k))
        assert mine == (rows(retrieval.retrieve(pages, tocs, q)) if q.strip() else []), q


def test_match_equals_one_query_at_a_time(spark):
    pages, tocs = PAGES.df(spark), TOCS.df(spark)
    few = ["hook events", "guide", "skils"]
    got = layers.match(pages, tocs, asked(spark, few)).cache()
    for k, q in enumerate(few):
        want = [(r["title"], round(r["similarity"], 6), r["source"], r["rank"]) for r in retrieval.match(pages, tocs, q).collect()]
        mine = [(r["title"], round(r["similarity"], 6), r["source"], r["rank"]) for r in got.where(F.col("query_id") == k).orderBy("rank").collect()]
        assert mine == want, q


def test_holding(spark):
    names = ["abcabc", "bca", "x", "", "日本語の本", "aa", "the thing of things", "ab"]
    wanted = ["abc", "bc", "a", "日本", "本", "zz", "abcabcabc", "thing", "of ", "", "aa"]
    got = layers.holding(spark.createDataFrame([(w,) for w in wanted], "asked string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(map(tuple, got.collect())) == sorted((w, n) for w in wanted for n in names if w and w in n)


def test_holding_joins_by_grams(spark):
    a, n = spark.createDataFrame([("abc",)], "asked string"), spark.createDataFrame([("xabcx",)], "name string")
    plan = layers.holding(a, n)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_titles_of_pages(spark, data):
    """Titles of pages, mangled, and words of them, against all titles, as a plain loop has it; few pairs meet by ratio."""
    titles = sorted({r["t"] for r in spark.read.parquet(f"{data}/pages.parquet").select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t")).collect()})
    pages = spark.createDataFrame([("s", t, "") for t in titles], "doc_set string, title string, content string")
    queries = [t[3:] for t in titles[:10]] + [t.split(" ")[0] for t in titles[:10]]
    met = spark.sparkContext.accumulator(0)
    got = layers.by_title(pages, asked(spark, queries), k=5, counter=met).cache()
    for k, q in enumerate(queries):
        want, folded = [], q.strip().lower()
        for t in titles:
            low = " ".join(t.split()).lower()
            score = 1.0 if low == folded else 0.9 if low.startswith(folded) else 0.7 if folded in low else SequenceMatcher(None, folded, t.strip().lower()).ratio()
            if folded and score >= 0.6:
                want.append((-round(score, 9), t))
        mine = sorted((-round(r["similarity"], 9), r["title"]) for r in got.where(F.col("query_id") == k).collect())
        assert mine == sorted(want)[:5], q
    assert met.value < len(set(queries)) * len(titles) / 2


def test_empty_tables(spark):
    pages, tocs = PAGES.df(spark), TOCS.df(spark)
    assert layers.match(pages.limit(0), tocs.limit(0), asked(spark)).count() == 0
    assert layers.match(pages, tocs, asked(spark).limit(0)).count() == 0
    assert layers.match(pages, tocs, spark.createDataFrame([(1, None)], "query_id int, query string")).count() == 0


def test_expansions(spark):
    few = ["Hook events of agents", "a bc", "word", "", "same same"]
    got = [r["e"] for r in asked(spark, few).select("query_id", layers.expansions(F.col("query"), 3).alias("e")).orderBy("query_id").collect()]
    assert got == [retrieval.expansions(q, 3) for q in few]


def test_titles_are_extracted_with_few_reads_of_the_pages(spark):
    """Pages are read for their names and for what is found, however many modes there are."""
    from lakeloom.operators import retrieval

    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            counter.add(len(b))
            yield b

    rows = [(f"s{i % 2}", f"Guide number {i} of the hooks", "text") for i in range(20)]
    pages = spark.createDataFrame(rows, "doc_set string, title string, content string").mapInPandas(counted, "doc_set string, title string, content string")
    asked = spark.createDataFrame([("Guide number 1 of the hooks",), ("GUIDE NUMBER 2 OF THE HOOKS",), ("number 3 of",), ("Giude nunber 4 of the hooks",), ("zzz",)], "title string")
    got = {r["title"]: (r["mode"], r["page"]) for r in retrieval.extract(pages, asked).collect()}
    modes = ("exact", "case_insensitive", "partial", "fuzzy")
    assert got == {t[0]: (m, f"Guide number {i + 1} of the hooks") for i, (m, t) in enumerate(zip(modes, asked.take(4)))}
    assert counter.value <= 3 * len(rows)


def test_long_strings_are_led_by_long_grams(spark):
    """Of names that share every three characters with what is asked, only the one that holds it may be compared."""
    asked = spark.createDataFrame([("abcdefgh",), ("abc",), ("ab",), ("ü",)], "asked string")
    names = spark.createDataFrame([("abcdefgh",), ("xabcdefghx",), ("abcdefg bcdefgh",), ("ü",), ("",)], "name string")
    got = {(r["asked"], r["name"]) for r in layers.holding(asked, names).collect()}
    assert got == {(a, n) for (a,) in asked.collect() for (n,) in names.collect() if a in n}
    assert max(layers.GRAMS) > 3
