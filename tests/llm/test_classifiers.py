import zlib

import numpy as np
from cases import none, odd, same_columns

from lakeloom.llm import langid, quality

BIG = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    rows = {r["doc_id"]: r for r in quality.query(spark, BIG).collect()}
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{BIG}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = ([r["score"] for r, q in held if q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.95


def test_quality_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0), (7, 0, 0), (9, None, 0), (None, 1, 0), (12, 1, 0), (10, 0, 0), (11, 5, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, docs, labels)
    same_columns(out, docs, ["score", "predicted"])
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == docs.count()


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(odd(spark), odd(spark), labels).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(odd(spark), odd(spark), one).collect()} == {1.0}
    assert quality.classify(none(spark), none(spark), labels).collect() == []


def test_quality_of_long_texts():
    """A text of many MB is read whole: what stands at its end counts."""
    stats, words, junk = quality.Stats(), "some plain words that follow one another. " * 100_000, "#%% $$ !! @@ " * 100_000
    assert len(words) > 4_000_000 and list(stats.of(None)) == list(stats.of(""))
    plain, late, early = stats.of(words), stats.of(words + junk), stats.of(junk + words)
    assert np.allclose(late, early) and np.abs(late - plain).max() > 1 and np.isfinite(late).all()


def test_densities():
    """Scores by Cholesky factors equal those by inverses and determinants."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, quality.STATS))
    model = {"middle": np.zeros(quality.STATS), "scale": np.ones(quality.STATS), "mean": rng.normal(size=(2, quality.STATS)), "chol": [], "logdet": [], "prior": 0.3}
    covs = []
    for _ in range(2):
        a = rng.normal(size=(quality.STATS, quality.STATS))
        c = a @ a.T + np.eye(quality.STATS)
        covs.append(c)
        model["chol"].append(np.linalg.inv(np.linalg.cholesky(c)))
        model["logdet"].append(np.linalg.slogdet(c)[1])
    d = [np.array([(v - model["mean"][k]) @ np.linalg.inv(covs[k]) @ (v - model["mean"][k]) for v in x]) + np.linalg.slogdet(covs[k])[1] for k in (0, 1)]
    want = 1 / (1 + np.exp(-np.clip(((d[0] - d[1]) / 2 + 0.3) / np.sqrt(quality.STATS), -30, 30)))
    assert np.allclose(quality.scores(model, x), want)


def test_quality_in_plain_numpy(spark):
    """The model is that of the sample covariances of all labelled rows, and the query's scores follow from it."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    x, y = [], []
    for r in spark.read.parquet(f"{BIG}/labels.parquet").collect():
        if r["doc_id"] in rows and zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["quality"] in (0, 1):
            x.append(quality.Stats().of(rows[r["doc_id"]]))
            y.append(r["quality"])
    x, y = np.array(x), np.array(y)
    own = [x[y == k] for k in (0, 1)]
    cov = [np.cov(o.T, bias=True) for o in own]
    pooled = (len(own[0]) * cov[0] + len(own[1]) * cov[1]) / len(x)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    far = []
    every = np.array([quality.Stats().of(t) for t in rows.values()])
    for k in (0, 1):
        c = (0.7 * cov[k] + 0.3 * pooled) / np.outer(scale, scale)
        c = 0.95 * c + 0.05 * np.trace(c) / len(c) * np.eye(len(c))
        d = (every - own[k].mean(axis=0)) / scale
        far.append(np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1])
    odds = ((far[0] - far[1]) / 2 + np.log(len(own[1]) / len(own[0]))) / np.sqrt(x.shape[1])
    want = dict(zip(rows, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))))
    got = {r["doc_id"]: r["score"] for r in quality.query(spark, BIG).collect()}
    assert set(got) == set(want) and np.allclose([got[i] for i in want], list(want.values()), atol=1e-6)


def test_language_held_out(spark):
    rows = {r["doc_id"]: r for r in langid.query(spark, BIG).collect()}
    docs = spark.read.parquet(f"{BIG}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(rows[r["doc_id"]]["held_out"] for r in held) and sum(r["held_out"] for r in rows.values()) == len(held)
    assert np.mean([rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held if r["text"]]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_odd_rows(spark):
    docs = odd(spark)
    out = langid.identify(docs, docs)
    same_columns(out, docs, ["lang_pred", "score"])
    for r in out.collect():
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and r["lang_pred"] in {"und", "en", "de", "fr", "es"}


def test_language_without_labels(spark):
    docs = odd(spark)
    assert {r["lang_pred"] for r in langid.identify(docs, docs.where("lang = 'xx'")).collect()} == {"und"}
    assert langid.identify(none(spark), none(spark)).collect() == []


def test_elastic_net_leaves_gaps():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        y = i % 2
        s = np.unique(np.concatenate(([10 + y], rng.integers(100, 400, 8))))
        rows.append((s, np.ones(len(s)) / np.sqrt(len(s)), y))
    w = langid.fit_ftrl(rows, 2, l1=0.5)
    assert w[10, 0] > 0 > w[10, 1] or w[11, 1] > 0
    assert (w[:langid.SLOTS] == 0).mean() > 0.99


def test_temperature():
    rng = np.random.default_rng(0)
    true = rng.normal(size=(4000, 3))
    p = langid.softmax(true)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert 3.0 < langid.calibrate(true * 4, y) < 5.5
