import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import blockmax, bm25

PLAIN = bm25.Params(stemmed=False)


def naive(index, queries, k, id_col="query_id", text_col="query"):
    found = bm25.scores(index, queries, id_col, text_col).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc", "score", "rank")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc"], round(r["score"], 6)) for r in df.collect())


def test_equals_scoring_everything(spark, data):
    docs, asked = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    index = bm25.build_for(asked, "item_id", "text", docs, "doc_id", "text", PLAIN)
    for k, size in ((1, 16_384), (7, 30), (100, 16_384)):
        got = blockmax.topk(index, asked, k, id_col="item_id", text_col="text", digits=6, range_docs=size)
        assert rows(got) == rows(naive(index, asked, k, "item_id", "text"))


def test_few_are_scored(spark):
    """On 10,000 documents under a tenth of the documents that share a term with a query get a score."""
    big = "/root/testdata/sf0.1"
    docs, asked = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/benchmark.parquet")
    index = bm25.build_for(asked, "item_id", "text", docs, "doc_id", "text", PLAIN)
    index = bm25.Index(bm25.saved(index.tf), bm25.saved(index.dl), bm25.saved(index.df), bm25.saved(index.stats), PLAIN)
    found = bm25.saved(bm25.scores(index, asked, "item_id", "text").select("query_id", "doc", F.round("score", 6).alias("score")))
    every = found.count()
    counter = spark.sparkContext.accumulator(0)
    got = rows(blockmax.topk(index, asked, 10, id_col="item_id", text_col="text", digits=6, counter=counter))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    assert got == rows(found.withColumn("rank", F.row_number().over(order)).where("rank <= 10"))
    assert 0 < counter.value < every / 10


def test_random_postings():
    """Against plain sums, with many ties."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n_docs, n_terms = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        has = rng.random((n_terms, n_docs)) < rng.choice([0.02, 0.3, 0.9], n_terms)[:, None]
        w = np.round(rng.random((n_terms, n_docs)), int(rng.integers(1, 4))) + 0.1
        t, d = np.nonzero(has)
        p = blockmax.Postings(t, d, w[t, d], n_docs)
        asked = rng.choice(n_terms + 2, size=min(n_terms, 5), replace=False)
        shares = (rng.random(len(asked)) * 5 + 0.01).tolist()
        k = int(rng.integers(1, 20))
        at, score, _ = blockmax.walk(p, n_docs, asked.tolist(), shares, k, 1e-9)
        full = sum((c * np.where(has[a], w[a], 0) for a, c in zip(asked, shares) if a < n_terms), np.zeros(n_docs))
        want = sorted(((-s, i) for i, s in enumerate(full.tolist()) if s > 0))[:k]
        got = sorted((-s, i) for i, s in zip(at.tolist(), score.tolist()))
        assert [s for s, _ in got[:k]] == pytest.approx([s for s, _ in want])
        assert {i for s, i in want if -s > -want[-1][0] + 1e-8} <= set(at.tolist())


def test_odd_queries(spark):
    """Empty and null queries find nothing, repeated terms count again, queries are dealt to several passes, ids may be text."""
    docs = spark.createDataFrame([("a", "red green blue"), ("b", "red red"), ("c", None), ("d", ""), ("e", "red red")], "doc string, text string")
    index = bm25.build(docs, "doc", "text", PLAIN)
    asked = spark.createDataFrame([("q1", "red"), ("q2", "red red blue"), ("q3", ""), ("q4", None), ("q5", "unknown")], "query_id string, query string")
    for mb in (16, 1e-5):
        got = blockmax.topk(index, asked, 2, digits=6, terms_mb=mb)
        assert rows(got) == rows(naive(index, asked, 2)) and {r["query_id"] for r in got.collect()} == {"q1", "q2"}
    assert blockmax.topk(index, asked.limit(0), 2).collect() == []
    assert blockmax.topk(bm25.build(docs.limit(0), "doc", "text", PLAIN), asked, 2).collect() == []


def test_ranges_follow_the_postings(spark, monkeypatch):
    """Long documents make more ranges, so a task holds no more of them, and the result is the same."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 9 + 1))) for i in range(40)], "doc int, text string")
    asked = spark.createDataFrame([(1, "w0 w3 w5"), (2, "w8")], "query_id int, query string")
    index, got = bm25.build(docs, "doc", "text", PLAIN), []
    pmod, dealt = blockmax.F.pmod, []
    monkeypatch.setattr(blockmax.F, "pmod", lambda x, n: dealt.append(str(n)) or pmod(x, n))
    for most, ranges in ((500_000, "'1'"), (20, "'5'")):
        monkeypatch.setattr(blockmax, "POSTINGS", most)
        top = blockmax.topk(index, asked, 3, text_col="query", digits=6)
        assert ranges in dealt[-1]  # the last is that by ranges; 85 postings are asked for
        got.append(sorted(map(tuple, top.collect())))
    assert got[0] == got[1] and len(got[0]) == 6
