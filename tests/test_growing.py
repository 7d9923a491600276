"""An index that grows by batches against one that is built at once."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import bm25, growing
from lakeloom.streaming import indexing

P = bm25.Params()
SHAPE = "id string, text string"
FIRST = [("a", "Hooks run before steps"), ("b", "Deploy and wait, deploy again"), ("c", None), ("e", "")]
SECOND = [("d", "Hooks of a deploy"), ("b", "Only hooks now"), (None, "no id"), ("d", "Aaa")]
THIRD = [("a", None), ("c", "Steps of steps"), ("b", "Only hooks now")]


def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def tables(index):
    stats = index.stats.first()
    return {n: sorted(tuple(r) for r in getattr(index, n).select(*c).collect()) for n, c in {"tf": ["doc", "term", "tf"], "dl": ["doc", "len"], "df": ["term", "df"]}.items()} | {"stats": (stats["n"], round(stats["avg_len"], 9))}


def built(spark, *batches):
    last = {}
    for rows in batches:
        own = {}
        for i, t in rows:
            if i is not None:
                own[i] = max(own[i], t, key=lambda x: (x is not None, x or "")) if i in own else t
        last |= own
    return tables(bm25.build(docs(spark, list(last.items())), "id", "text", P))


def test_equal_to_built_at_once(spark, tmp_path):
    folder = str(tmp_path / "i")
    for n, rows in enumerate([FIRST, SECOND, THIRD]):
        assert growing.add(docs(spark, rows), folder, f"k{n}", "id", "text", P)
        assert tables(growing.index(spark, folder, P)) == built(spark, *[FIRST, SECOND, THIRD][: n + 1])


def test_replays_count_once(spark, tmp_path):
    folder = str(tmp_path / "i")
    growing.add(docs(spark, FIRST), folder, "k0", "id", "text", P)
    growing.add(docs(spark, SECOND), folder, "k1", "id", "text", P)
    want = tables(growing.index(spark, folder, P))
    assert not growing.add(docs(spark, SECOND), folder, "k1", "id", "text", P) and tables(growing.index(spark, folder, P)) == want
    # The writer was lost before the row of stats stood: nothing of the batch is seen, and it is written anew.
    growing.add(docs(spark, THIRD), folder, "k2", "id", "text", P)
    shutil.rmtree(f"{folder}/stats/batch=2")
    assert tables(growing.index(spark, folder, P)) == want
    assert growing.add(docs(spark, THIRD), folder, "k2", "id", "text", P)
    assert tables(growing.index(spark, folder, P)) == built(spark, FIRST, SECOND, THIRD)


def test_compacted_index_grows_on(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    growing.add(docs(spark, FIRST), a, "k0", "id", "text", P)
    growing.add(docs(spark, SECOND), a, "k1", "id", "text", P)
    growing.compacted(spark, a, b)
    assert os.listdir(f"{b}/tf") == ["batch=1"] and tables(growing.index(spark, b, P)) == built(spark, FIRST, SECOND)
    assert not growing.add(docs(spark, FIRST), b, "k0", "id", "text", P)
    assert growing.add(docs(spark, THIRD), b, "k2", "id", "text", P)
    assert tables(growing.index(spark, b, P)) == built(spark, FIRST, SECOND, THIRD)


def test_empty_batches(spark, tmp_path):
    folder = str(tmp_path / "i")
    with pytest.raises(ValueError):
        growing.index(spark, folder, P)
    growing.add(docs(spark, FIRST), folder, "k0", "id", "text", P)
    assert growing.add(docs(spark, []), folder, "none", "id", "text", P) and not growing.add(docs(spark, []), folder, "none", "id", "text", P)
    assert tables(growing.index(spark, folder, P)) == built(spark, FIRST)


def test_only_batches_that_change_are_read(spark, tmp_path):
    """Postings are read again of those batches only that hold a document that comes again."""
    folder = str(tmp_path / "i")
    for n in range(4):
        growing.add(docs(spark, [(f"x{n}", "some words"), (f"y{n}", "more")]), folder, f"k{n}", "id", "text", P)
    for n in (0, 2):
        for f in os.listdir(f"{folder}/tf/batch={n}"):
            if not f.startswith((".", "_")):
                with open(f"{folder}/tf/batch={n}/{f}", "wb") as out:
                    out.write(b"broken")
    assert growing.add(docs(spark, [("x1", "other")]), folder, "k4", "id", "text", P)


def test_stream_of_three_batches(spark, tmp_path, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    d.repartition(3, "doc_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = indexing.run(stream, str(tmp_path / "i"), str(tmp_path / "cp"), "doc_id", "text", P)
    q.awaitTermination(200)
    assert growing.sums(spark, str(tmp_path / "i")).count() == 3
    want = tables(bm25.build(d, "doc_id", "text", P))
    assert tables(growing.index(spark, str(tmp_path / "i"), P)) == want
    # The last batch is taken for not done by the checkpoint, though the index has it.
    os.remove(tmp_path / "cp" / "commits" / "2")
    crc = tmp_path / "cp" / "commits" / ".2.crc"
    if crc.exists():
        os.remove(crc)
    indexing.run(stream, str(tmp_path / "i"), str(tmp_path / "cp"), "doc_id", "text", P).awaitTermination(200)
    assert growing.sums(spark, str(tmp_path / "i")).count() == 3 and tables(growing.index(spark, str(tmp_path / "i"), P)) == want
    asked = spark.createDataFrame([(0, "the")], "query_id int, query string").union(d.where("text IS NOT NULL").limit(1).select(F.lit(1), F.substring("text", 1, 60)))
    a, b = (sorted((r["query_id"], r["rank"], r["doc"], round(r["score"], 6)) for r in bm25.search(i, asked).collect()) for i in (growing.index(spark, str(tmp_path / "i"), P), bm25.build(d, "doc_id", "text", P)))
    assert a == b and a


def test_parts_follow_the_text(spark, tmp_path, monkeypatch):
    """What one task sorts is bounded: twice the text makes twice the parts, and the index is the same."""
    monkeypatch.setattr(growing, "PART_BYTES", 1000)
    for n in (1, 2):
        rows = [(f"d{i}", f"hooks deploy {'deploy ' * 20}word{i % 7}") for i in range(50 * n)]
        folder = str(tmp_path / f"i{n}")
        growing.add(docs(spark, rows), folder, "k", "id", "text", P)
        size = sum(len(t) for _, t in rows)
        tf = spark.read.parquet(f"{folder}/tf/batch=0")
        parts = {r[0]: r[1] for r in tf.groupBy(F.input_file_name()).agg(F.count_distinct("doc")).collect()}
        assert len(parts) > size / 1000 / 2 and max(parts.values()) < 40
        assert tables(growing.index(spark, folder, P)) == built(spark, rows)


def test_terms_counted_in_their_row(spark):
    rows = [("b a b", 2), ("", 0), (None, 0), ("a", 1), ("c c c", 1), ("ü Ü x_1 x_1 é", 3)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string")
    split = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")
    got = {r["i"]: {t["term"]: t["tf"] for t in r["c"]} for r in df.select("i", bm25.counted(split).alias("c")).collect()}
    for i, (text, n) in enumerate(rows):
        words = [w for w in (text or "").lower().split(" ") if w]
        assert got[i] == {w: words.count(w) for w in words} and len(got[i]) == n
