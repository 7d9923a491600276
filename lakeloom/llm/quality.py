"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole documents.

Class means and covariances come from exact sums over all labelled training rows. Covariances shrink towards the pooled
one and its mean variance; the score is a sigmoid of the difference of Mahalanobis log-densities, by Cholesky factors
that are computed once and broadcast.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lakeloom.llm.common import held_out, table

MARKS = b"!#$%&*|@~^<>={}[]\\/_+"
STATS = 20


class Stats:
    """STATS transformed statistics of a text; a null text is an empty one."""

    def __init__(self):
        kind = np.zeros(256, np.int64)
        for name, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", MARKS, b".,;:?'\"()-"), 1):
            kind[list(chars)] = name
        kind[128:192], kind[192:] = 8, 9
        self.kind, self.twice = kind, re.compile(rb"([!#$%&*|@~^?.])\1")

    def of(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        other, low, up, digit, blank, line, mark, stop, more, high = np.bincount(self.kind, by_byte, minlength=10)
        chars = len(raw) - more
        letters = low + up + high
        words = raw.split()
        n = len(words)
        size = np.fromiter(map(len, words), np.float64, n)
        lines = raw.split(b"\n")
        distinct, distinct_lines = len(set(words)), len(set(lines))
        share = lambda a, b: math.log((a + 0.5) / (b - a + 0.5)) if b > a else math.log((a + 0.5) / 0.5)
        top = by_byte[97:123]
        total = max(1, int(top.sum()))
        p = top[top > 0] / total
        marks = by_byte[list(b"!#$%&*|")]
        doubled = len(self.twice.findall(raw))
        return np.array([
            math.log1p(chars), math.log1p(n), math.log1p(len(lines)),
            math.log1p(float(size.mean()) if n else 0.0), math.log1p(float(size.std()) if n else 0.0), math.log1p(float(size.max()) if n else 0.0),
            share(up, letters), share(digit, chars), share(mark, chars), share(stop, chars), share(blank, chars), share(other, chars),
            share(distinct, n), share(distinct_lines, len(lines)), math.log1p(chars / len(lines)),
            float(-(p * np.log(p)).sum()) if len(p) else 0.0,
            share(int(marks.max()), chars), share(min(doubled, n), n), math.sqrt(mark / (chars + 1)), math.sqrt(up / (letters + 1)),
        ])


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of each row with an id."""
    use = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches):
        stats = Stats()
        for b in batches:
            x = [stats.of(t) for t in b.column(1).to_pylist()]
            flat = np.concatenate(x) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * STATS, pa.int32()), pa.array(flat, pa.float64()))], ["id", "x"])

    return use.mapInArrow(run, f"id {use.schema['id'].dataType.simpleString()}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", lean: float = 0.3, ridge: float = 0.05) -> dict:
    """Rows of docs with a label 0 or 1 are learned from, all of them; other labels and nulls are not. Labels that repeat
    count once, a document with both labels counts for both classes, and rows that repeat an id count one by one.

    lean: the share of the pooled covariance in each class's; ridge: then that of the mean variance. With only one class,
    or none, the model is constant.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    rows = statistics(docs, id_col, text_col).join(known, "id").select("y", "x")

    def sums(batches):
        s = np.zeros((2, 1 + STATS + STATS * STATS))
        for b in batches:
            y, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, STATS)
            for k in (0, 1):
                own = x[y == k]
                s[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        k, i = np.divmod(np.arange(s.size), s.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(s.ravel())], ["y", "i", "v"])

    s = np.zeros((2, 1 + STATS + STATS * STATS))
    for r in rows.mapInArrow(sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        s[r["y"], r["i"]] = r["v"]
    n = s[:, 0]
    if n.min() < 2:
        return {"constant": 0.5 if not n.sum() else float(n[1] / n.sum())}
    mean = s[:, 1 : 1 + STATS] / n[:, None]
    cov = s[:, 1 + STATS :].reshape(2, STATS, STATS) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (n[:, None, None] * cov).sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    cov, pooled, middle = cov / np.outer(scale, scale), pooled / np.outer(scale, scale), mean.mean(axis=0)
    model = {"middle": middle, "scale": scale, "mean": (mean - middle) / scale, "chol": [], "logdet": [], "prior": math.log(n[1] / n[0])}
    for k in (0, 1):
        c = (1 - lean) * cov[k] + lean * pooled
        c = (1 - ridge) * c + ridge * np.trace(c) / STATS * np.eye(STATS)
        chol = np.linalg.cholesky(c)
        model["chol"].append(np.linalg.inv(chol))
        model["logdet"].append(2 * float(np.log(np.diag(chol)).sum()))
    return model


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Sigmoid of the log-density difference for each statistic, so that it stays within what a double tells apart."""
    if "constant" in model:
        return np.full(len(x), model["constant"])
    z = (x - model["middle"]) / model["scale"]
    far = [(((z - model["mean"][k]) @ model["chol"][k].T) ** 2).sum(axis=1) + model["logdet"][k] for k in (0, 1)]
    odds = (far[0] - far[1]) / 2 + model["prior"]
    return 1 / (1 + np.exp(-np.clip(odds / math.sqrt(STATS), -30, 30)))


def score(spark: SparkSession, model: dict, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        stats = Stats()
        return pd.Series(scores(shared.value, np.array([stats.of(t) for t in texts]).reshape(-1, STATS)))

    return run(text)


def classify(docs: DataFrame, train: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The input's rows and columns, with score and predicted (1 if score >= threshold); columns of these names are replaced.

    Each row is scored by its whole text alone, however long, so rows that repeat get equal scores; a null text is an
    empty one, and both have a score. An empty table gives an empty table; without labels of both classes on two rows
    each, all rows get the share of label 1 among what is labelled (0.5 if nothing is).
    """
    model = fit(train, labels, text_col=text_col, **options)
    return docs.withColumn("score", score(docs.sparkSession, model, F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"), 5, 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, training(docs), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
