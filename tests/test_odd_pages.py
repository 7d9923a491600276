"""Queries over pages whose titles are cut within a character reference, and pages that share a URL, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import rows

BODY = "<article><h1>{0}</h1><p>a &lt;b&gt; &copy; &amp c &quot;d&#x27;</p><a href='/one'>x</a></article>"
PAGES = [
    (0, "http://h.example.com/a/b", "Ends in &amp;&amp"), (100, "http://h.example.com/a/c", "token = &quot;0b96a8c8d"), (2, "http://h.example.com/a/d", "AT&T &copy; &lt;all&gt; &#x27;q"),
    (3, "http://g.example.com/", "one &quo"), (4, "http://g.example.com/e", "s in &amp;&amp at its end"), (5, "http://g.example.com/e", "ends twice"), (6, "http://g.example.com/f", "Plain"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    made = [(i, u, f"<html><head><title>{t}</title></head><body>{BODY.format(t)}<a href='/by{i}'>y</a></body></html>") for i, u, t in PAGES]
    spark.createDataFrame(made, "page_id long, url string, html string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, "s in"), (2, "token")], "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return at


def held(spark, folder, name):
    con = duckdb.connect()
    for t in ("pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, folder), con.execute(entry.oracle_sql()[name])
    return rows(got.columns, [tuple(r) for r in got.collect()]), rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", ["page_title", "page_text", "tree_pages", "convert_tally", "layered_retrieval", "crawl_pages", "crawl_paced"])
def test_against_sql(spark, folder, name):
    got, want = held(spark, folder, name)
    assert got == want


def test_pages_of_one_url_stand_in_the_order_of_their_ids(spark, folder):
    got = [r["text"].split(".")[0] for r in entry.queries()["toc_parse"](spark, folder).orderBy("page", "line_no").collect()]
    assert got == ["3", "4", "5", "6", "0", "100", "2"]


TITLES = ["a\rb", "ends in a return\r", "a\u2028b", "\u00a0Guide\u2003", "\u0391\u03a3 \u03a3\u0391\u03a3", "x\u000by", "a\u0085b", "[x\r](y)", "x: https://k.example.org/z\u000bw", "two\nlines", ""]


@pytest.mark.parametrize("name", ["toc_parse", "lowest_level"])
def test_returns_and_blanks_of_all_scripts_are_read_as_in_sql(spark, tmp_path, name):
    at = str(tmp_path)
    made = [(i, f"http://h.example.com/a/{i}", f"<title>{t}</title>") for i, t in enumerate(TITLES)]
    spark.createDataFrame(made, "page_id long, url string, html string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, "")], "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    got, want = held(spark, at, name)
    assert len(got[1]) == len(TITLES) - 1 and got == want
