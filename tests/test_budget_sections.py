import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import lines as L


def fold(rows, budget):
    """Item by item: what fits is taken, and the first in any case."""
    out, used = set(), {}
    for g, o, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if g not in used or used[g] + (n or 0) <= budget:
            used[g] = used.get(g, 0) + (n or 0)
            out.add((g, o))
    return out


@pytest.mark.parametrize("fold_rows", [10**6, 0])
def test_packed_both_ways(spark, fold_rows):
    """The fold and the rounds give the same: ties of size, zeros and nulls, a first item beyond the budget, null groups."""
    rng = random.Random(1)
    rows = [(g, o, rng.choice([0, 1, 2, 3, 5, 8, 40, None])) for g in ("a", "b", "", None) for o in range(60)]
    rows += [("big", 0, 1000), ("big", 1, 1), ("big", 2, 0), ("one", 0, 5)]
    df = spark.createDataFrame(rows, "g string, o int, n int").repartition(5)
    for budget in (0, 7, 50, 10_000):
        got = L.packed(df, ["g"], ["o"], "n", budget, fold_rows=fold_rows)
        assert got.columns == ["g", "o", "n", "taken"] and got.count() == len(rows)
        assert {(r["g"], r["o"]) for r in got.where("taken").collect()} == fold(rows, budget)
    assert L.packed(df.limit(0), ["g"], ["o"], "n", 5, fold_rows=fold_rows).collect() == []


def test_a_group_of_a_million_rows(spark):
    """One group with nearly all rows is dealt over many parts, and nothing is gathered in a row."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("o"), "id", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(900)) + 1).alias("n"))
    got = L.packed(df, ["g"], ["o", "id"], "n", 50_000)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want, used = set(), 0
    for r in df.orderBy("o", "id").select("id", "n").toPandas().itertuples():
        if not want or used + r.n <= 50_000:
            used += r.n
            want.add(r.id)
    assert {r["id"] for r in got.where("taken").select("id").collect()} == want and used == 50_000


def nearest(levels):
    return [next((j for j in range(i + 1, len(levels)) if levels[j] <= v), None) for i, v in enumerate(levels)]


def test_section_ends(spark):
    rng = random.Random(2)
    pages = {p: [rng.choice([1, 2, 2, 3, 3, 3, 4, 9]) for _ in range(rng.randint(1, 40))] for p in range(30)}
    df = spark.createDataFrame([(p, i, v) for p, levels in pages.items() for i, v in enumerate(levels)], "p int, line_no int, level int")
    got = {(r["p"], r["line_no"]): r["section_end"] for r in L.with_section_end(df, ["p"]).collect()}
    assert got == {(p, i): e for p, levels in pages.items() for i, e in enumerate(nearest(levels))}
    assert L.with_section_end(df.limit(0), ["p"]).collect() == []


def test_page_of_many_headings(spark):
    """100,000 headings of one page, each section asked for: the work grows with the page and with what is returned."""
    n = 100_000
    level = F.when(F.col("id") % 1000 == 0, 1).when(F.col("id") % 10 == 0, 2).otherwise(3)
    lines = spark.range(n).select(F.lit("p").alias("page"), F.col("id").cast("int").alias("line_no"), F.concat(F.repeat(F.lit("#"), level), F.lit(" head "), F.col("id").cast("string"), F.lit("x")).alias("line"))
    wanted = spark.range(n).select(F.lit("p").alias("page"), F.concat(F.lit("head "), F.col("id").cast("string"), F.lit("x")).alias("title"))
    got = L.sections(lines, ["page"], wanted).groupBy("title").agg(F.count("*").alias("n"), F.min("line_no").alias("a"))
    by = {r["n"]: r["c"] for r in got.groupBy("n").agg(F.count("*").alias("c")).collect()}
    assert by == {1000: 100, 10: 9_900, 1: 90_000}
