from itertools import combinations

import numpy as np
import pytest
from cases import none, odd, same_columns

from lakeloom.llm import packing


def least_padding(lengths, buckets):
    tops = sorted(set(lengths))
    best = None
    for k in range(1, min(buckets, len(tops)) + 1):
        for ends in combinations(tops[:-1], k - 1):
            edge = [*ends, tops[-1]]
            pad = sum(next(e for e in edge if e >= n) - n for n in lengths)
            best = pad if best is None else min(best, pad)
    return best


@pytest.mark.parametrize("seed", range(25))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 40, rng.integers(1, 30)).tolist()
    tops, count = np.unique(lengths, return_counts=True)
    for buckets in (1, 2, 3, 5):
        ends, pad = packing.boundaries(tops, count, tops * count, buckets)
        assert pad == least_padding(lengths, buckets) == sum(next(e for e in ends if e >= n) - n for n in lengths)
        assert ends == sorted(ends) and ends[-1] == max(lengths)


def check(rows, n_rows, budget):
    assert len(rows) == n_rows
    by = {}
    for r in rows:
        assert r["n_tokens"] + r["padding"] == r["bucket_len"] and r["padding"] >= 0
        by.setdefault((r["bucket"], r["batch"]), []).append(r)
    last = {}
    for (b, batch), own in by.items():
        each = max(1, budget // max(1, own[0]["bucket_len"]))
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and len(own) <= each
        last[b] = max(last.get(b, -1), batch)
    for (b, batch), own in by.items():
        assert batch == last[b] or len(own) == max(1, budget // max(1, own[0]["bucket_len"]))
    assert all({k[1] for k in by if k[0] == b} == set(range(n + 1)) for b, n in last.items())


def test_odd_rows(spark):
    docs = odd(spark)
    out = packing.pack(docs, budget=200)
    same_columns(out, docs, ["n_tokens", "bucket", "bucket_len", "batch", "slot", "padding"])
    rows = out.collect()
    check(rows, docs.count(), 200)
    assert {r["n_tokens"] == len((r["text"] or "").encode().split()) for r in rows} == {True}


def test_empty_table(spark):
    assert packing.pack(none(spark)).collect() == []


def test_query(spark, data):
    rows = packing.query(spark, data).collect()
    check(rows, spark.read.parquet(f"{data}/documents.parquet").count(), 32_768)
    lengths = [r["n_tokens"] for r in rows]
    tops, count = np.unique(lengths, return_counts=True)
    assert len({r["bucket"] for r in rows}) == 16
    assert sum(r["padding"] for r in rows) == packing.boundaries(tops, count, tops * count, 16)[1]


def test_bins(spark):
    from pyspark.sql import functions as F

    n = [0, 1, 2047, 2048, 2049, 4095, 4096, 100_003, 10**9]
    rows = spark.createDataFrame([(x,) for x in n], "n long").select("n", packing.bin_of(F.col("n"), 1024).alias("b")).collect()
    assert all(r["b"] <= r["n"] and r["n"] - r["b"] <= r["n"] / 1000 for r in rows)
    assert [r["b"] for r in rows[:3]] == [0, 1, 2047]


def test_own_lengths(spark):
    from pyspark.sql import functions as F

    rows = packing.pack(spark.createDataFrame([(i, None, i % 7) for i in range(100)], "doc_id long, text string, tok int"), length=F.col("tok"), buckets=7, budget=12).collect()
    check(rows, 100, 12)
    assert sum(r["padding"] for r in rows) == 0


def test_long_lengths_are_exact(spark):
    """Lengths beyond any bin give the least padding there is; bins on request give nearly that."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    lengths = rng.integers(2_048, 60_000, 3_000)
    docs = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, n long")
    tops, count = np.unique(lengths, return_counts=True)
    cost = np.full(len(tops) + 1, np.inf)
    cost[0], c, s = 0, np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(tops * count)))
    for _ in range(8):  # all splits, one layer after the other
        cost = np.concatenate(([0], [min((cost[:j] + tops[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])).min(), np.inf) for j in range(1, len(tops) + 1)]))
    got = [packing.pack(docs, length=F.col("n"), buckets=8, **more).agg(F.sum("padding")).first()[0] for more in ({}, {"fine": 64})]
    assert got[0] == cost[-1] < got[1] < 1.05 * cost[-1]


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 3_000_000), (2, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in packing.packed(docs).collect()} == {1: 3_000_000, 2: 1}
