"""Dense vectors as arrays: norm, scaling, dot product, cosine, all inside the JVM, in double precision; encoders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n != 0, n))


def encoder(encode: Callable[[list[str]], object], batch: int = 32) -> Callable[[Column], Column]:
    """A function of a text column, from one that gives vectors for a list of texts, such as a model's: it is called with
    `batch` texts at a time, each distinct one of an Arrow batch once. Vectors are scaled to length 1; null texts stay null."""

    @pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, list[float]] = {}
        todo = [t for t in dict.fromkeys(texts) if t is not None]
        for at in range(0, len(todo), batch):
            part = todo[at : at + batch]
            v = np.asarray(encode(part), np.float64)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            known.update(zip(part, (v / np.where(size > 0, size, 1.0)).tolist()))
        return pd.Series([None if t is None else known[t] for t in texts])

    return run
