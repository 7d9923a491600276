"""Embedding whitening by a covariance in two passes.

Vectors are scaled to integers, so sums are exact in any order. The fit list, each distinct vector once, is written to the
shared folder and read by each pass: the first sums integers, which gives the mean; the second sums outer products of
centred rows by matrix products, a matrix for each task, which treeAggregate merges. LAPACK's symmetric eigensolver runs
on the driver on one matrix; its vectors, scaled, are broadcast and applied to all rows. A third pass over the fit list
measures the covariance of what came out. Nothing but sums and matrices of the vectors' length leaves the tasks.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lakeloom.llm.common import free, table, written

ADDED = ["n", "deviation", "whitened", "explained", "identity_error"]
KIND = "struct<n: bigint, deviation: decimal(38,0), whitened: array<double>, explained: array<double>, identity_error: double>"
DIGITS = 10**38


@dataclass
class Model:
    """What is known of the vectors of one length. mean_floor and mean_rest: sums divided by n, as quotients and remainders."""

    n: int
    mean_floor: list[int]
    mean_rest: list[int]
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float | None = None

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """x less the floor of the mean, exactly."""
        far = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), *map(abs, self.mean_floor), 0)
        if far >= 1 << 62:
            return x.astype(object) - np.array(self.mean_floor, object)
        return x - np.array(self.mean_floor, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(np.float64) - np.array([r / self.n for r in self.mean_rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n * x - S)^2) of each row, exactly: with x = floor + d and S = n * floor + r it is n^2 sum(d^2) - 2 n sum(d r) + sum(r^2)."""
        d = self.offsets(x)
        r, most = np.array(self.mean_rest, object), int(np.abs(d).max(initial=0))
        if most * max(most, self.n) * max(1, d.shape[1]) < 1 << 63:
            r = r.astype(np.int64)
        else:
            d = d.astype(object)
        squares, mixed, rest = (d * d).sum(axis=1).tolist(), (d * r).sum(axis=1).tolist(), sum(v * v for v in self.mean_rest)
        return [self.n * self.n * a - 2 * self.n * b + rest for a, b in zip(squares, mixed)]


def by_length(column: pa.ListArray):
    """(length, row numbers, matrix) of the vectors, those of one length together."""
    length, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(length) - length
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield int(d), at, flat[begin[at][:, None] + np.arange(d)]


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns of longs, by halves of 32 bits, so that nothing overflows."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(a) << 32) + int(b) for a, b in zip(high, low)]


def tree_sum(fit: DataFrame, part) -> dict:
    """Sums over the fit list: part(length, matrix) -> a tuple of what can be added. One state for each task and length."""

    def add(a: dict, b: dict) -> dict:
        for d, new in b.items():
            a[d] = tuple(x + y if not isinstance(x, list) else [u + v for u, v in zip(x, y)] for x, y in zip(a[d], new)) if d in a else new
        return a

    def partial(batches):
        state = {}
        for batch in batches:
            add(state, {d: part(d, x) for d, _, x in by_length(batch.column(0))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    return fit.mapInArrow(partial, "state binary").rdd.map(lambda r: pickle.loads(r[0])).treeAggregate({}, add, add)


def fitted(fit: DataFrame, components: int, least: float) -> dict[int, Model]:
    """A model for each length of vectors. Components whose eigenvalue is under `least` of the greatest have no spread."""
    sc = fit.sparkSession.sparkContext
    sums = tree_sum(fit, lambda d, x: (len(x), exact_sums(x)))
    models = {d: Model(n, [v // n for v in s], [v % n for v in s]) for d, (n, s) in sums.items() if d}
    shared = sc.broadcast(models)

    def outer(d: int, x: np.ndarray) -> tuple:
        if not d:
            return (0.0,)
        z = shared.value[d].centred(x)
        return (z.T @ z,)

    for d, (products,) in tree_sum(fit, outer).items():
        if d:
            m, cov = models[d], products / models[d].n
            values, vectors = np.linalg.eigh((cov + cov.T) / 2)
            m.trace = float(np.trace(cov))
            order = [i for i in range(d - 1, -1, -1) if values[i] > least * values[-1] and values[i] > 0][:components]
            m.values, m.vectors = values[order], vectors[:, order]
            sign = np.sign(m.vectors[np.abs(m.vectors).argmax(axis=0), np.arange(len(order))])
            m.vectors = m.vectors * sign
    shared = sc.broadcast(models)

    def moments(d: int, x: np.ndarray) -> tuple:
        if not d:
            return (0.0, 0.0)
        w = shared.value[d].whitened(x)
        return (w.sum(axis=0), w.T @ w)

    for d, (total, products) in tree_sum(fit, moments).items():
        if d and len(models[d].values):
            mean = total / models[d].n
            models[d].identity_error = float(np.abs(products / models[d].n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return models


def scaled(vec: Column, scale: int) -> Column:
    """Each component c as floor(scale * c), a long; beyond the range of a long, its nearest value."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def finite(vec: Column) -> Column:
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def whiten(vectors: DataFrame, *, vec_col: str = "embedding", scale: int = 256, components: int = 4, least: float = 1e-12) -> DataFrame:
    """The input's rows and columns with n, deviation, whitened, explained and identity_error; columns of these names are replaced.

    n: distinct scaled vectors; deviation: sum((n * x - S)^2), exact, null beyond 38 digits; whitened: the row projected on
    the first `components` components, each with variance 1 over the distinct vectors; explained: each component's share of
    the variance; identity_error: the largest absolute entry of whitened's covariance less the identity, as measured.

    Rows whose vector is null or holds a null or a non-finite entry are left out; rows that repeat are counted once in the
    fit and each returned. A vector without spread (one distinct vector, or fewer directions than components) has fewer
    components: those whose eigenvalue is under `least` of the greatest are not given. Vectors of another length have a
    fit of their own; an empty vector has no components. An empty table gives an empty table.
    """
    vectors = vectors.drop(*ADDED) if vec_col not in ADDED else vectors.drop(*(set(ADDED) - {vec_col}))
    x, out = free([*vectors.columns, *ADDED], "x", "out")
    rows = vectors.where(finite(F.col(vec_col))).withColumn(x, scaled(F.col(vec_col), scale))
    shared = vectors.sparkSession.sparkContext.broadcast(fitted(written(rows.select(x).distinct(), "vectors"), components, least))

    @arrow_udf(KIND)
    def apply(column: pa.Array) -> pa.Array:
        result = [None] * len(column)
        for d, at, part in by_length(column):
            m = shared.value.get(d)
            if m is None:
                for i in at:
                    result[i] = {"n": None, "deviation": None, "whitened": [], "explained": [], "identity_error": None}
                continue
            explained = (m.values / m.trace).tolist() if m.trace > 0 else []
            for i, far, w in zip(at.tolist(), m.deviations(part), m.whitened(part).tolist()):
                result[i] = {"n": m.n, "deviation": Decimal(far) if far < DIGITS else None, "whitened": w, "explained": explained, "identity_error": m.identity_error}
        return pa.array(result, TYPE)

    rows = rows.withColumn(out, apply(F.col(x)))
    kept = [c for c in vectors.columns if c not in ADDED]
    return rows.select(*kept, *[F.col(out)[c].alias(c) for c in ADDED])


TYPE = pa.struct([("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64())), ("identity_error", pa.float64())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    out = out.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", each)
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
