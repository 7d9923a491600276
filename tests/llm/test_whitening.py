import math

import numpy as np
import pytest

from lakeloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, x int, out int, whitened string"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "clash", 1, 2, "clash") for i, v in rows], SCHEMA.replace("float", kind))


def brute(rows, scale=256, k=4):
    """{row number: (n, deviation, whitened, explained)} by plain integers and numpy's covariance."""
    good = {r: [math.floor(float(np.float32(c)) * scale) for c in v] for r, (_, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(x) for x in good.values()})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.cov(np.array(fit, float).T, bias=True).reshape(len(s), len(s))
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return {r: (n, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array(x) - np.array(s) / n) @ v / np.sqrt(e), e / np.trace(cov)) for r, x in good.items()}


def same(got, want):
    assert len(got) == len(want)
    signs = None
    for g, (n, deviation, whitened, explained) in zip(got, want):
        assert (g["n"], int(g["deviation"])) == (n, deviation)
        assert np.allclose(g["explained"], explained, rtol=1e-9) and g["identity_error"] < 1e-9
        ratio = np.array(g["whitened"]) / whitened
        signs = np.sign(ratio) if signs is None else signs
        assert np.allclose(ratio, signs, rtol=1e-6)


def test_against_plain_integers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.2] + 1).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # a hot vector counts once
    rows += [(None, rows[1][1]), (5, rows[2][1]), (5, None), (6, [1.0] * 5 + [None]), (7, [float("nan")] * 6), (8, [float("inf")] + [0.0] * 5)]
    want = brute(rows)
    got = whitening.whiten(frame(spark, rows).repartition(5))
    assert got.columns == ["vec_id", "embedding", "x", "out", "n", "deviation", "whitened", "explained", "identity_error"]
    key = lambda i, v: (i is None, i or 0, v)
    order = sorted(want, key=lambda r: key(rows[r][0], rows[r][1]))
    same(sorted(got.collect(), key=lambda r: key(r["vec_id"], r["embedding"])), [want[r] for r in order])


def test_query(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()]
    want, got = brute(rows), {}
    for r in whitening.query(spark, data).collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert sorted(got) == [rows[r][0] for r in want]
    signs = None
    for r, (n, deviation, whitened, explained) in want.items():
        mine = sorted(got[rows[r][0]], key=lambda x: x["component"])
        assert [x["component"] for x in mine] == [1, 2, 3, 4] and all((x["n"], x["deviation"]) == (n, deviation) and x["identity_error"] < 1e-4 for x in mine)
        assert np.allclose([x["explained"] for x in mine], explained, rtol=1e-9)
        ratio = np.array([x["whitened"] for x in mine]) / whitened
        signs = np.sign(ratio) if signs is None else signs
        assert np.allclose(ratio, signs, rtol=1e-6)


def test_no_spread(spark):
    """One distinct vector has no component; vectors on a line have one; lengths are fitted apart, empty vectors have none."""
    got = whitening.whiten(frame(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, [], [], None)] * 2
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)] + [(20 + i, [float(i), float(i * i)]) for i in range(4)] + [(30, [])]
    got = {r["vec_id"]: r for r in whitening.whiten(frame(spark, rows)).collect()}
    assert all(len(got[i]["whitened"]) == 1 and got[i]["n"] == 9 and got[i]["explained"][0] == pytest.approx(1) for i in range(9))
    assert all(len(got[20 + i]["whitened"]) == 2 and got[20 + i]["n"] == 4 for i in range(4))
    assert got[30]["whitened"] == [] and got[30]["n"] is None


def test_empty_table(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []


def test_large_components(spark):
    """Sums and deviations are exact where doubles are not; what no long or decimal holds is its nearest value, or null."""
    rows = [(0, [2.0**45, 1.0]), (1, [2.0**45 + 2.0**24, -1.0]), (2, [-(2.0**44), 0.5])]
    want = brute(rows)
    got = sorted(whitening.whiten(frame(spark, rows, "double")).collect(), key=lambda r: r["vec_id"])
    assert [int(r["deviation"]) for r in got] == [want[i][1] for i in range(3)]
    got = sorted(whitening.whiten(frame(spark, [(0, [1e300]), (1, [-1e300]), (2, [0.0])], "double")).collect(), key=lambda r: r["vec_id"])
    assert int(got[2]["deviation"]) == 1 and got[0]["deviation"] is None and [round(r["whitened"][0], 6) for r in got] == [1.224745, -1.224745, 0.0]
