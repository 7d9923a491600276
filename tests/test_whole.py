"""Queries do the whole of their job where SQL or small tables do not show it."""

from lakeloom import catalog
from lakeloom.plans.steps import rule_router


def test_title_layers_returns_every_match(spark, tmp_path):
    spark.range(100_003).selectExpr("id AS page_id", "concat('<title>the ', id, '</title>') AS html").write.parquet(str(tmp_path / "pages.parquet"))
    assert catalog.QUERIES["title_layers"](spark, str(tmp_path)).count() == 100_003


def test_model_steps_reads_whole_texts(spark, tmp_path):
    rows = [(1, "a word " * 40 + "how"), (2, "plain"), (3, "x" * 60 + " vs y")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r["item_id"]: r["answer"] for r in catalog.QUERIES["model_steps"](spark, str(tmp_path)).collect()} == {i: rule_router(t) for i, t in rows}


def test_context_growth_has_every_document(spark, tmp_path):
    docs = [(1, "a\nb\nc\nd\ne f\ng"), (2, "short"), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["context"] for r in catalog.QUERIES["context_growth"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and "e f" in got[1] and got[2] == got[3] == ""
