"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

n-grams of one to three characters are hashed to a fixed number of slots. Document frequencies are counted over all
labelled rows; the regression is fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample
of them (`sample` rows), and a temperature is then calibrated on a part of the sample that was not fitted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lakeloom.llm.common import free, held_out, table

SLOTS = 1 << 15
STEP = 1 << 20


class Grams:
    """Counts of hashed n-grams of a whole text, STEP characters at a time."""

    def __init__(self, step: int = STEP):
        self.alpha = np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)
        self.step = step

    def letters(self, text: str) -> np.ndarray:
        """Code points of the text, 32 for all that is no letter."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = c < 1 << 16
        letter = self.alpha[np.where(small, c, np.uint32(0))]
        if not small.all():
            beyond, which = np.unique(c[~small], return_inverse=True)
            letter[~small] = np.array([chr(i).isalpha() for i in beyond.tolist()])[which]
        return np.where(letter, c, np.uint32(32))

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """(slots, counts, whether there is a letter). Letters are lower-cased, runs of all else are one blank. The last
        two characters of a step are carried into the next, where only n-grams that end in the new part are counted."""
        total, any_letter, held = np.zeros(SLOTS, np.int64), False, np.zeros(0, np.uint32)
        text = text.lower()  # as a whole, as some letters depend on what follows
        for at in range(0, len(text), self.step):
            new = self.letters(text[at : at + self.step])
            any_letter = any_letter or bool((new != 32).any())
            before = held[-1:] if len(held) else np.full(1, 0, np.uint32)
            new = new[(new != 32) | (np.concatenate((before, new[:-1])) != 32)]
            c, old = np.concatenate((held, new)), len(held)
            x = c * np.uint32(2654435761)
            grams = [x[old:]]
            if len(c) > 1:
                two = (x[:-1] ^ (x[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[1:] * np.uint32(3266489917)
                grams.append(two[max(0, old - 1) :])
            if len(c) > 2:
                three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(668265263) + c[2:] * np.uint32(374761393)
                grams.append(three[max(0, old - 2) :])
            h = np.concatenate(grams)
            h ^= h >> np.uint32(16)
            total += np.bincount((h * np.uint32(2146121005)) >> np.uint32(32 - 15), minlength=SLOTS)
            held = c[-2:]
        slots = np.flatnonzero(total)
        return slots, total[slots], any_letter


def weigh(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[slots]
    return v / max(1e-12, math.sqrt(float(v @ v)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3) -> np.ndarray:
    """FTRL-proximal by coordinate; the last row of the weights is the intercept, which neither penalty touches."""
    z, n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))

    first, second = np.full((SLOTS + 1, 1), l1), np.full((SLOTS + 1, 1), l2)
    first[SLOTS] = second[SLOTS] = 0

    def weights(i):
        lean = np.sign(z[i]) * np.maximum(np.abs(z[i]) - first[i], 0)
        return -lean / ((beta + np.sqrt(n[i])) / alpha + second[i])

    for _ in range(epochs):
        for slots, v, y in rows:
            i, x = np.append(slots, SLOTS), np.append(v, 0.1)
            w = weights(i)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / alpha * w
            n[i] = more
    return weights(slice(None))


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden sections of its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: float(-np.log(softmax(logits / math.exp(t))[np.arange(len(y)), y] + 1e-15).mean())
    a, b, r = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = 4000) -> dict:
    """Learns from rows with text, language and id. Frequencies come from all of them; `sample` rows, as many of each
    language as there are, chosen by a hash of the id, are fitted on. Without such rows there are no languages."""
    use = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("lang"), F.col(id_col).alias("i"))

    def frequencies(batches):
        grams, df, langs = Grams(), np.zeros(SLOTS, np.int64), {}
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                df[grams.counts(t)[0]] += 1
                langs[lang] = langs.get(lang, 0) + 1
        i = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(i) + list(langs), pa.string()), pa.array(i.tolist() + [-1] * len(langs), pa.int32()), pa.array(df[i].tolist() + list(langs.values()), pa.int64())], ["lang", "slot", "n"])

    got = use.select("t", "lang").mapInArrow(frequencies, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    langs = {r["lang"]: r["n"] for r in got if r["slot"] < 0}
    if not langs:
        return {"langs": []}
    df = np.zeros(SLOTS)
    for r in got:
        if r["slot"] >= 0:
            df[r["slot"]] = r["n"]
    rows_in_all = sum(langs.values())
    idf = np.log((1 + rows_in_all) / (1 + df)) + 1
    names, each, wide = sorted(langs), max(1, sample // len(langs)), 1 << 40
    share = F.create_map(*[F.lit(x) for k, n in langs.items() for x in (k, min(wide, int(wide * 1.1 * each / n) + 1))])
    order = F.pmod(F.xxhash64("i"), F.lit(wide))
    picked = use.withColumn("o", order).where(F.col("o") < share[F.col("lang")]).select("t", "lang", "o")

    def features(batches):
        grams = Grams()
        for b in batches:
            t, lang, o = (b.column(k).to_pylist() for k in range(3))
            f = [grams.counts(x)[:2] for x in t]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(o, pa.int64()), pa.array([x[0].astype(np.int32).tobytes() for x in f], pa.binary()), pa.array([x[1].astype(np.int32).tobytes() for x in f], pa.binary())], ["lang", "o", "slots", "counts"])

    taken, fitted, kept = {k: 0 for k in names}, [], []
    for r in sorted(picked.mapInArrow(features, "lang string, o long, slots binary, counts binary").collect(), key=lambda r: (r["o"], r["lang"], r["slots"])):
        if taken[r["lang"]] < each:
            taken[r["lang"]] += 1
            slots = np.frombuffer(r["slots"], np.int32)
            row = (slots, weigh(slots, np.frombuffer(r["counts"], np.int32), idf), names.index(r["lang"]))
            (kept if taken[r["lang"]] % 5 == 0 else fitted).append(row)
    w = fit_ftrl(fitted, len(names))
    logits = np.array([v @ w[s] + 0.1 * w[SLOTS] for s, v, _ in kept]).reshape(-1, len(names))
    heat = calibrate(logits, np.array([y for _, _, y in kept], np.int64))
    used = np.flatnonzero(w[:SLOTS].any(axis=1))
    return {"langs": names, "idf": idf.astype(np.float32), "slots": used, "weights": w[used].astype(np.float32), "bias": 0.1 * w[SLOTS], "heat": heat}


def predict(spark: SparkSession, model: dict, text: Column) -> Column:
    """struct(lang, score): `und` with score 0 for null texts, texts without a letter, and where no language was learned."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        m, grams, out = shared.value, Grams(), []
        if m["langs"]:
            w = np.zeros((SLOTS, len(m["langs"])))
            w[m["slots"]] = m["weights"]
            idf = m["idf"].astype(np.float64)
        for t in texts:
            slots, counts, letters = grams.counts(t) if t and m["langs"] else ((), (), False)
            if not letters:
                out.append(("und", 0.0))
                continue
            p = softmax((weigh(slots, counts, idf) @ w[slots] + m["bias"]) / m["heat"])
            k = int(p.argmax())
            out.append((m["langs"][k], float(p[k])))
        return pd.DataFrame(out, columns=["lang", "score"])

    return guess(text)


def identify(docs: DataFrame, train: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The input's rows and columns, with lang_pred and score; columns of these names are replaced. Options: see fit().

    Each row is judged by its text alone: rows that repeat are each judged, alike. A null text, an empty one and one
    without a letter are `und` with score 0; of languages with equal scores the first by name is taken. Texts of any
    length are read whole, STEP characters at a time. An empty table gives an empty table; without a row to learn from,
    all rows are `und`.
    """
    model = fit(train, text_col=text_col, **options)
    (p,) = free(docs.columns, "p")
    got = F.col(f"`{p}`")
    return docs.withColumn(p, predict(docs.sparkSession, model, F.col(text_col))).withColumns({"lang_pred": got["lang"], "score": got["score"]}).drop(p)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    away = held_out(F.col("doc_id"), 4, 2)
    return identify(docs.select("doc_id", "text"), docs.where(~away).select("doc_id", "text", "lang")).select("doc_id", away.alias("held_out"), "lang_pred", "score")
