import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SCHEMA)


def asked():
    return F.col("vec_id") % 100 == 0



def brute(rows, k=10):
    """(query id, rank, id, distance): each row is a query of its own, and no candidate for itself."""
    rows = [(i, np.float32(v).astype(float)) for i, v in rows]
    out = []
    for a, (q, v) in enumerate(rows):
        if q % 100 == 0:
            d = sorted((math.dist(v, x), i) for b, (i, x) in enumerate(rows) if a != b and len(x) == len(v))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d[:k])]
    return sorted(out)


def same(got, want):
    got = sorted(tuple(r) for r in got)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14, atol=1e-12)


def recall(got, want):
    """By distances, as of equal ones any may be found."""
    far = {}
    for q, _, _, s in want:
        far[q] = max(far.get(q, 0.0), s)
    return sum(s <= far[q] * (1 + 1e-12) for q, _, _, s in got) / len(want)


def test_odd_vectors(spark):
    good = [(100, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [-1.0, 5.0]), (200, [0.0, 2.0]), (4, [1.0, 0.0]), (300, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 4.0])]
    bad = [(5, None), (6, []), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0]), (10, [float("inf"), 1.0]), (None, [1.0, 1.0]), (400, None)]
    same(ann.search(table(spark, good + bad), asked()).collect(), brute(good))


def test_rows_that_repeat(spark):
    """A query id that comes twice has its ranks twice, and each of its rows is a candidate for the other."""
    rows = [(100, [1.0, 0.0]), (100, [0.9, 0.0]), (1, [0.5, 0.0]), (2, [0.2, 0.0]), (2, [0.2, 0.0]), (200, [1.0, 0.0])]
    got = ann.search(table(spark, rows), asked()).collect()
    same(got, brute(rows))
    assert sorted(r["rank"] for r in got if r["query_id"] == 100) == sorted([1, 2, 3, 4, 5] * 2)


def test_huge_and_tiny_components(spark):
    rows = [(100, [1e200, 0.0]), (1, [0.0, 1e200]), (2, [1e200, 1e190]), (3, [-1e308, 1e308]), (200, [1e-200, 0.0]), (4, [0.0, 1e-200]), (5, [1e-200, 1e-210]), (300, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.search(df, asked()).collect()}
    assert len(got) == 3 * 7
    assert got[100, 1] == pytest.approx(2**0.5 * 1e200) and got[100, 2] == pytest.approx(1e190) and got[100, 4] == 1e200
    assert got[200, 4] == pytest.approx(2**0.5 * 1e-200) and got[200, 5] == pytest.approx(1e-210) and got[200, 300] == pytest.approx(2**0.5)


def test_empty_tables(spark):
    assert ann.search(table(spark, []), asked()).collect() == []
    assert ann.search(table(spark, [(100, [1.0, 2.0])]), asked()).collect() == []


def clustered(n, d, centres, seed=2):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d)) * 2
    return (c[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * 0.5).astype(np.float32)


def test_recall_and_blocks(spark):
    x = clustered(3000, 16, 12)
    x[1000:1200] = x[1000]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df, want = table(spark, rows), brute(rows)
    for block in (20_000, 100):
        got = ann.search(df, asked(), sample=1500, leaf=300, block=block).collect()
        assert len(got) == len(want) and recall(got, want) >= 0.9


def test_routing_prunes(spark, monkeypatch):
    """On clustered vectors less than a quarter of the table is compared, in partitions of two levels, and recall holds."""
    x = clustered(40_000, 24, 150)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    trees = []
    grow = ann.grow
    monkeypatch.setattr(ann, "grow", lambda *a: trees.append(grow(*a)) or trees[0])
    least = []
    threshold = ann.threshold
    monkeypatch.setattr(ann, "threshold", lambda *a: least.append(threshold(*a)) or least[0])
    got = ann.search(df, asked(), leaf=400, fan=12).collect()
    tree, x = trees[0], x.astype(float)
    home = tree.leaf("24", x)
    names, size = np.unique(home, return_counts=True)
    assert len(names) > 40 and any(n.count(".") == 2 for n in names) and size.max() < 4_000
    row, name, _ = tree.leaves("24", x[::100], least[0])
    share = sum(dict(zip(names, size.tolist())).get(n, 0) for n in name) / (len(x[::100]) * len(x))
    assert share < 0.25 and set(row) == set(range(400))
    ok = 0
    by = {}
    for q, _, i, s in got:
        by.setdefault(q, []).append(s)
    for q in range(0, 40_000, 100):
        d = np.sort(((x - x[q]) ** 2).sum(axis=1))[1:11]
        ok += sum(s * s <= d[-1] * (1 + 1e-9) for s in by[q])
    assert ok >= 0.9 * 4_000


def test_partitions_grow_with_the_table(spark):
    """Four times the rows, about four times the partitions of the same size."""
    n = []
    for rows in (5_000, 20_000):
        df = spark.createDataFrame([(i, i, 8, v.tolist()) for i, v in enumerate(clustered(rows, 8, 60))], "row long, id long, d int, v array<double>")
        tree = ann.grow(df, {8: rows}, 250, 8, 2_000, 1 << 28)
        n.append(len({k for k in df.select(ann.leaf_of(spark.sparkContext.broadcast(tree)).alias("k")).distinct().collect()}))
    assert 2.5 < n[1] / n[0] < 6


def test_query_recall(spark, data):
    want = brute([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()])
    assert recall([tuple(r) for r in ann.query(spark, data).collect()], want) >= 0.9


def test_query_recall_where_partitions_are_many(spark):
    big = "/root/testdata/sf0.1"
    x = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{big}/embeddings.parquet").collect()}
    want = brute(list(x.items()))
    assert recall([tuple(r) for r in ann.query(spark, big).collect()], want) >= 0.9


def test_partitions_are_balanced():
    x = np.random.default_rng(0).normal(size=(600, 8))
    part = ann.balanced(ann.neighbour_graph(x, 10), x, 6)
    assert np.bincount(part).max() <= np.ceil(1.05 * 100)


def test_vectors_far_out_have_k_neighbours(spark):
    """A query that is alone in its partition, or with few others, gets k rows all the same."""
    rng = np.random.default_rng(0)
    for scaled in ({0: 1e6}, {0: 1e6, 100: 1e6}, {0: 1e4, 1: 1e4, 2: 1e4}):
        x = rng.normal(size=(2000, 16)).astype(np.float32)
        if len(scaled) == 3:
            x[1] = x[2] = x[0]
        for i, by in scaled.items():
            x[i] *= np.float32(by)
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got, want = ann.search(table(spark, rows), asked()).collect(), brute(rows)
        n = {}
        for r in got:
            n[r["query_id"]] = n.get(r["query_id"], 0) + 1
        assert n == {q: 10 for q in range(0, 2000, 100)} and recall([tuple(r) for r in got], want) >= 0.9
        for q in scaled:
            if q % 100 == 0 and len(scaled) == 3:
                assert sorted(r["vec_id"] for r in got if r["query_id"] == q and r["score"] == 0) == [1, 2]


def test_fewer_candidates_than_k(spark):
    rows = [(i, [float(i), 1.0]) for i in range(0, 800, 100)]
    same(ann.search(table(spark, rows), asked()).collect(), brute(rows))


def test_worst_query(spark):
    """Not only the mean: each query finds at least half of its neighbours."""
    x = clustered(3000, 16, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows)
    far, hits = {}, {}
    for q, _, _, s in want:
        far[q] = max(far.get(q, 0.0), s)
    for q, _, _, s in ann.search(table(spark, rows), asked(), sample=1500, leaf=300).collect():
        hits[q] = hits.get(q, 0) + (s <= far[q] * (1 + 1e-12))
    assert min(hits[q] for q in far) >= 5
