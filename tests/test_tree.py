"""Corpus trees as a data source: what is read, and that a write is there as a whole or not at all."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakeloom.sources import corpus, tree

ROWS = [("a@latest", "One", "# One\r\ntext"), ("a@latest", "Two", None), ("b@1.0", "One", "é")]
SHAPE = "doc_set string, title string, content string"


def files(base):
    return sorted(os.path.relpath(os.path.join(d, f), base) for d, _, fs in os.walk(base) for f in fs if not f.endswith(".crc"))


def test_round_trip(spark, tmp_path):
    base = str(tmp_path / "t")
    tree.write(spark.createDataFrame(ROWS, SHAPE).withColumn("Content2", F.lit(1)), base)
    assert files(base) == ["a@latest/One/docContent.md", "a@latest/Two/docContent.md", "b@1.0/One/docContent.md"]
    back = {tuple(r) for r in tree.read(spark, base).collect()}
    assert back == {("a@latest", "One", "# One\ntext"), ("a@latest", "Two", ""), ("b@1.0", "One", "é")}
    assert {r for r in back if r[2]} == {tuple(r) for r in corpus.pages(spark, base).collect()}  # Spark's text source has no row for an empty file


def test_files_join_and_replace(spark, tmp_path):
    base = str(tmp_path)
    tree.write(spark.createDataFrame(ROWS, SHAPE), base)
    tree.write(spark.createDataFrame([("a@latest", "One", "toc")], SHAPE), base, "docTOC.md")
    tree.write(spark.createDataFrame([("a@latest", "One", "new"), ("a@latest", "Three", "3"), ("c@1", "X", "x")], SHAPE), base)
    got = {(r["doc_set"], r["title"]): r["content"] for r in tree.read(spark, base).collect()}
    assert got == {("a@latest", "One"): "new", ("a@latest", "Two"): "", ("a@latest", "Three"): "3", ("b@1.0", "One"): "é", ("c@1", "X"): "x"}
    assert [tuple(r) for r in tree.read(spark, base, "docTOC.md").collect()] == [("a@latest", "One", "toc")]
    tree.write(spark.createDataFrame([("a@latest", "Only", "o")], SHAPE), base, overwrite=True)
    assert files(base) == ["a@latest/Only/docContent.md", "b@1.0/One/docContent.md", "c@1/X/docContent.md"]


@pytest.mark.parametrize("overwrite", [False, True])
def test_failed_task_leaves_nothing(spark, tmp_path, overwrite):
    base = str(tmp_path)
    tree.write(spark.createDataFrame(ROWS, SHAPE), base)
    before = files(base)
    many = spark.range(400).repartition(8, "id").select(F.lit("a@latest").alias("doc_set"), F.concat(F.lit("p"), "id").alias("title"), F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise("x").alias("content"))
    with pytest.raises(PySparkException):
        tree.write(many, base, overwrite=overwrite)
    assert [f for f in files(base) if not f.startswith(tree.STAGING)] == before
    assert {(r["doc_set"], r["title"]) for r in tree.read(spark, base).collect()} == {r[:2] for r in ROWS}
    # A task that was being killed may have written once more: that is hidden, and goes here.
    assert tree.recovered(spark, base) == 0 and files(base) == before


@pytest.mark.parametrize("row", [(None, "t", "x"), ("a@1", None, "x"), ("a@1", "", "x"), ("a@1", "..", "x"), ("a@1", "b/c", "x"), ("plain", "t", "x")])
def test_names_that_are_no_folders(spark, tmp_path, row):
    with pytest.raises(PySparkException):
        tree.write(spark.createDataFrame([row], SHAPE), str(tmp_path / "t"))
    assert not os.path.exists(tmp_path / "t") or files(tmp_path / "t") == []


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SHAPE)
    tree.write(none, str(tmp_path))
    assert files(tmp_path) == [] and tree.read(spark, str(tmp_path)).collect() == []
    with pytest.raises(PySparkException):
        tree.read(spark, str(tmp_path / "nowhere")).collect()


def test_only_asked_doc_sets_are_read(spark, tmp_path):
    base = str(tmp_path)
    tree.write(spark.createDataFrame(ROWS, SHAPE), base)
    os.remove(tmp_path / "a@latest/One/docContent.md")
    os.mkdir(tmp_path / "a@latest/One/docContent.md")  # to read it is an error
    with pytest.raises(PySparkException):
        tree.read(spark, base).collect()
    for df in (tree.read(spark, base).where("doc_set = 'b@1.0'"), tree.read(spark, base).where(F.col("doc_set").isin("b@1.0", "z@1")), tree.read(spark, base, doc_sets=["b@1.0"])):
        assert [r["title"] for r in df.collect()] == ["One"]
    assert tree.read(spark, base).where("doc_set = 'z@1'").collect() == []


def test_one_large_doc_set_is_split(spark, tmp_path):
    base = str(tmp_path)
    tree.write(spark.range(200).select(F.lit("big@1").alias("doc_set"), F.concat(F.lit("p"), "id").alias("title"), F.col("id").cast("string").alias("content")), base)
    df = tree.read(spark, base, splits=5)
    assert sorted(int(r["content"]) for r in df.collect()) == list(range(200))
    assert df.groupBy(F.spark_partition_id()).count().count() == 5


def test_writes_cut_short_are_finished_or_dropped(spark, tmp_path):
    base = str(tmp_path)
    tree.write(spark.createDataFrame(ROWS, SHAPE), base)

    def staged(name, note):
        for d, t, c in [("a@latest", "One", "later"), ("d@1", "New", "n")]:
            folder = tmp_path / (tree.STAGING + name) / d / t
            os.makedirs(folder)
            (folder / tree.PAGE).write_text(c)
        if note:
            (tmp_path / (tree.STAGING + name) / tree.MOVING).write_text(json.dumps({"doc_sets": ["a@latest", "d@1"], "overwrite": False}))

    staged("early", False)
    assert corpus.pages(spark, base).count() == 2 and tree.read(spark, base).count() == 3
    assert tree.recovered(spark, base) == 0 and tree.read(spark, base).count() == 3
    staged("late", True)
    os.rename(tmp_path / (tree.STAGING + "late") / "d@1", tmp_path / "d@1")  # the driver was lost after this move
    assert tree.recovered(spark, base) == 1 and tree.recovered(spark, base) == 0
    got = {(r["doc_set"], r["title"]): r["content"] for r in tree.read(spark, base).collect()}
    assert got[("a@latest", "One")] == "later" and got[("d@1", "New")] == "n" and len(got) == 4
