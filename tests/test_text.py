import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.functions import html, similarity
from lakeloom.functions import text as T
from lakeloom.operators import lines as L


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows)]


def test_tokens(spark):
    got = one(spark, T.tokens, "The Quick-brown FOXES are running; 42 a b", None, "", "naïve Straße")
    assert got == [["quick", "brown", "fox", "runn", "42"], [], [], ["naïve", "straße"]]


def test_stems(spark):
    want = {"agents": "agent", "quickly": "quick", "cities": "city", "boxes": "box", "women": "woman", "agent": "agent", "is": "is", "agreed": "agree", "organization": "organize"}
    assert one(spark, T.stem, *want) == list(want.values())


def test_slug(spark):
    assert one(spark, T.slug, "Create Your First Skill", "  a -- b!? ", "") == ["create-your-first-skill", "a-b", ""]


@pytest.mark.parametrize("a,b,low,high", [("x", "x", 1, 1), ("Hello", "hello", 1, 1), ("hello", "hallo", 0.51, 0.99), ("abc", "xyz", 0, 0), ("", "a", 0, 0), (None, "a", 0, 0)])
def test_ratio(a, b, low, high):
    assert low <= similarity.ratio_of(a, b) <= high


def test_names(spark):
    assert one(spark, lambda c: T.safe_name(c, folder=True), 'a<b>:"c', "123", " .. ", "x" * 300) == ["abc", "dir_123", "untitled", "x" * 200]


def test_paths(spark):
    assert one(spark, T.page_of_path, "a@1/My page/docTOC.md", "a@1/P/docContent.md", "docTOC.md", "x/readme.md") == ["My page", "P", "Unknown", "Unknown"]
    assert one(spark, T.doc_set_version, "a@1.0@x", "a") == ["1.0@x", "latest"]


def test_noun_stems():
    assert [T.noun_stem(w) for w in ("hooks", "classes", "cities", "gas", "applied", "as")] == ["hook", "classe", "citie", "gas", "apply", "as"]


def test_markdown_is_tidied(spark):
    assert one(spark, T.clean_markdown, "a​b\n##\n\n  Title\n\n\n\nx") == ["ab\n## Title\n\nx"]
    assert one(spark, T.with_image_urls, "![a](http://h/i.png) t") == ["![a](http://h/i.png)\nhttp://h/i.png t"]
    assert one(spark, T.without_ansi, "\x1b[31mred\x1b[0m") == ["red"]


def slow_numbers(levels):
    count, out = {1: 0, 2: 0, 3: 0, 4: 0}, []
    for level in levels:
        for deeper in range(level + 1, 5):
            count[deeper] = 0
        count[level] += 1
        out.append(".".join(str(count[k]) for k in range(1, level + 1)))
    return out


@given(st.lists(st.integers(1, 4), max_size=30))
def test_numbers_by_fold(levels):
    assert html.numbered(levels) == slow_numbers(levels)


def test_numbers_by_windows(spark):
    r = random.Random(0)
    levels = {p: [r.randint(1, 4) for _ in range(40)] for p in range(8)}
    df = spark.createDataFrame([(p, i, v) for p, vs in levels.items() for i, v in enumerate(vs)], "page int, pos int, level int")
    got = {(x["page"], x["pos"]): x["number"] for x in L.numbered(df, ["page"]).collect()}
    assert all([got[p, i] for i in range(40)] == slow_numbers(vs) for p, vs in levels.items())


@given(st.text(alphabet="a#`\n ", max_size=120), st.integers(0, 12))
@settings(max_examples=80)
def test_truncation_keeps_code_and_headings(text, most):
    out = L.truncated(text, most)
    fenced, must = False, []
    for line in text.split("\n"):
        fence = line.strip().startswith("```")
        if fence or fenced or line.strip().startswith("#"):
            must.append(line)
        fenced ^= fence
    kept = out.split("\n")
    assert all(m in kept for m in must)


def test_context_grows_to_the_left_first():
    lines = ["## H", "one two", "three four", "HIT five", "six seven", "## Next", "eight"]
    assert L.grown(lines, 3, 6) == "one two\nthree four\nHIT five"
    assert L.grown(lines, 3, 100) == "one two\nthree four\nHIT five\nsix seven"
    assert L.grown(lines, 3, 1) == "HIT"
    assert L.grown(["## only"], 0, 5) == ""


def test_greedy_packing_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("p", 1, 5), ("p", 2, 7), ("p", 3, 3), ("q", 1, 50)], "g string, i int, n int")
    got = {(r["g"], r["i"]): r["taken"] for r in L.packed(df, ["g"], ["i"], "n", 9).collect()}
    assert got == {("p", 1): True, ("p", 2): False, ("p", 3): True, ("q", 1): True}


def test_json():
    assert similarity.json_in('x ```json\n{"a": [1,],}\n```') == '{"a":[1]}'
    assert similarity.json_in("{'a': True}") == '{"a":true}'
    assert similarity.json_in("none") is None
