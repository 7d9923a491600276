"""The corpus pipeline against brute force, stage by stage and as a whole; odd rows through every stage."""

import os
import shutil

import corpus_pipeline as cp
import numpy as np
import pytest
from cases import none, odd
from test_decontaminate import brute as hits
from test_line_dedup import brute as lines
from test_packing import check
from test_jaccard import brute as pairs
from test_jaccard import closure
from test_simhash import brute as near

from lakeloom.llm import decontaminate, packing, quality


def brute_run(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in quality.query(spark, data).where("predicted = 1").collect()}
    docs = {i: t for i, t in docs.items() if i in kept}
    docs = {i: t for i, _, _, t in lines(list(docs.items()))}
    docs = {i: docs[i] for i, _, root in near(list(docs.items()), each=5) if i == root}
    docs = {i: t for i, t in docs.items() if i not in closure(pairs(list(docs.items())))}
    bench = sorted((str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect())
    items = [decontaminate.words_of(t.encode()) for _, t in bench]
    out = {}
    for i, t in docs.items():
        hit = np.array(hits(t, items, 10)[0], bool)
        if not hit.any() or hit.sum() < cp.MOST_COVERED * len(hit):
            out[i] = decontaminate.cut(t.encode(), hit).decode() if hit.any() else t
    return out


def test_run(spark, data):
    want = brute_run(spark, data)
    rows = cp.run(spark, data).collect()
    check(rows, len(want), 32_768)
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(t.encode().split()) for i, t in want.items()}
    n = sorted(len(t.encode().split()) for t in want.values())
    tops, count = np.unique(n, return_counts=True)
    assert sum(r["padding"] for r in rows) == packing.boundaries(tops, count, tops * count, 16)[1]


def test_clean_documents_stay(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = cp.quality_stage(spark, docs, data)
    assert out.columns == cp.COLUMNS
    good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    assert len(good & {r["doc_id"] for r in out.collect()}) >= 0.98 * len(good)


@pytest.fixture
def odd_data(spark, data, tmp_path):
    for t in ("labels", "benchmark"):
        shutil.copy(f"{data}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("rows", [odd, none])
def test_odd_rows_in_every_stage(spark, odd_data, rows):
    docs = rows(spark).drop("score", "n_words", "kept_text").selectExpr("*", "1 AS score", "2 AS bucket")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, odd_data)
        if name != "packing":
            assert out.columns == cp.COLUMNS
            got = out.collect()
            assert {r["doc_id"] for r in got} <= ids and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) or name in ("quality classifier", "SimHash near-dedup") for r in got)
        else:
            check(out.collect(), docs.count(), 32_768)


def test_stages_in_a_row_on_odd_rows(spark, odd_data):
    docs = odd(spark)
    for k, (_, stage) in enumerate(cp.STAGES):
        path = os.path.join(odd_data, f"out{k}")
        stage(spark, docs, odd_data).write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0


def test_near_copies_leave_one(spark, odd_data):
    docs = odd(spark).select(*cp.COLUMNS)
    out = [r["doc_id"] for r in cp.near_stage(spark, docs, odd_data).collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {i for i, _, root in near(rows, each=5) if i == root}
    want -= set(closure(pairs([(i, t) for i, t in rows if i in want])))
    assert {i for i in out if i is not None} == want and out.count(None) == 2
