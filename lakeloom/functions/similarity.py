"""String functions that SQL cannot state, in Arrow batches: matching-block ratio, compatible characters, JSON repair."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def ratio_of(a: str | None, b: str | None) -> float:
    """The share of matching blocks of the trimmed, lower-cased strings; 0 if either is empty."""
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def ratio(a: Column, b: Column) -> Column:
    @pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio_of(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


class Grams:
    """Counts of the characters and of the pairs of characters of trimmed, lower-cased strings, in hashed bins; they bound
    the ratio of two strings from above."""

    ONES, TWOS = 64, 128

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        folded = [(t or "").strip().lower() for t in texts]
        self.length = np.array([len(t) for t in folded], np.int64)
        self.ones, self.twos = np.zeros((len(texts), self.ONES), np.int32), np.zeros((len(texts), self.TWOS), np.int32)
        for row, t in enumerate(folded):
            if t:
                c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
                self.ones[row] = np.bincount(c % self.ONES, minlength=self.ONES)
                self.twos[row] = np.bincount((c[:-1] * 31 + c[1:]) % self.TWOS, minlength=self.TWOS)

    def bounds(self, other: Grams, row: int) -> np.ndarray:
        """The greatest ratio that each string here can have with that row of the other.

        Matching blocks hold m characters that both have, so m is bounded by the common characters. Between two blocks at
        least one character is not matched, so there are la + lb - 2 m + 1 blocks at most, and m less the number of blocks
        by the common pairs: 3 m <= pairs + la + lb + 1.
        """
        total = self.length + other.length[row]
        m = np.minimum(np.minimum(self.ones, other.ones[row]).sum(axis=1), (np.minimum(self.twos, other.twos[row]).sum(axis=1) + total + 1) // 3)
        return np.where((self.length > 0) & (other.length[row] > 0), 2 * m / np.maximum(total, 1), 0.0)

    #: Longer strings are bounded by counts alone.
    LONG = 256

    @cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """(the characters that occur, sorted; for each string up to LONG the places of its characters among them, filled up)."""
        folded = [(t or "").strip().lower() for t in self.texts]
        points = [np.frombuffer((t if len(t) <= self.LONG else "").encode("utf-32-le"), np.uint32) for t in folded]
        known = np.unique(np.concatenate([*points, np.zeros(0, np.uint32)]))
        table = np.full((max((len(p) for p in points), default=0), len(points)), len(known), np.int32)
        for i, p in enumerate(points):
            table[: len(p), i] = np.searchsorted(known, p)
        return known, table

    def in_order(self, rows: np.ndarray, other: Grams, row: int) -> np.ndarray:
        """Bounds for these rows by the longest common subsequence, as matching blocks stand in the same order in both; by bits,
        a word for each string here. 1 where a string is too long for that."""
        text = (other.texts[row] or "").strip().lower()
        known, table = self.codes
        out = np.ones(len(rows))
        if not text or len(text) > 64 or not len(rows):
            return out
        masks = np.zeros(len(known) + 1, np.uint64)
        for i, c in enumerate(text):
            at = np.searchsorted(known, ord(c))
            if at < len(known) and known[at] == ord(c):
                masks[at] |= np.uint64(1 << i)
        size = self.length[rows]
        short = size <= self.LONG
        at = rows[short]
        v = np.full(len(at), ~np.uint64(0))
        for place in table[: int(size[short].max(initial=0))]:
            m = masks[place[at]]
            u = v & m
            v = (v + u) | (v & ~m)
        common = np.bitwise_count(~v & np.uint64((1 << len(text)) - 1))
        out[short] = 2 * common / (size[short] + len(text))
        return out

    def may_reach(self, other: Grams, row: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(the rows whose ratio with that row of the other can be `least`, their bounds)."""
        bounds = self.bounds(other, row)
        rows = np.flatnonzero(bounds >= least)
        bounds = np.minimum(bounds[rows], self.in_order(rows, other, row))
        return rows[bounds >= least], bounds[bounds >= least]


def similar_pairs(asked: DataFrame, names: DataFrame, title_col: str, least: float, block_mb: float = 16, counter=None, best: int | None = None, cap: float = 1.0, below: float = 0.0, group_col: str | None = None) -> DataFrame:
    """asked (asked) against names: the columns of names with `asked` and `similarity`, where ratio() is `least` or more.

    What is asked is broadcast in blocks of block_mb, with a pass over the names for each. Only pairs whose bounds by lengths,
    common characters, common pairs of characters and the longest common subsequence reach `least` are compared. counter: an
    accumulator of how many.
    best: what is less like it than the `best` most similar names may be left out; equally similar ones stay. These are found in a
    pass of their own over the names in which those with the greatest bounds are compared. Ratios over `cap` count as cap there,
    names with one value of group_col as one, and what is less by up to `below` stays.
    """
    spark = names.sparkSession
    size = asked.agg(F.sum(F.octet_length("asked") + 1024)).first()[0] or 0
    blocks, out = max(1, math.ceil(size / (block_mb * 1e6))), None
    schema = T.StructType([*names.schema.fields, T.StructField("asked", T.StringType()), T.StructField("similarity", T.DoubleType())])
    at, group = names.columns.index(title_col), names.columns.index(group_col or title_col)
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == k).collect()  # bounded by block_mb
        texts = [r["asked"] for r in rows]
        floors = np.full(len(texts), least)
        if best is not None and texts:
            shared = spark.sparkContext.broadcast(texts)
            tops = names.mapInArrow(_seeker(shared, at, group, least, best, cap, counter), "q int, grp string, score double")
            tops = tops.groupBy("q", "grp").agg(F.max("score").alias("score")).groupBy("q").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
            for r in tops.where(F.size("s") >= best).select("q", F.get("s", F.lit(best - 1)).alias("s")).collect():  # a row for each asked
                floors[r["q"]] = max(least, r["s"] - below)
        shared = spark.sparkContext.broadcast((texts, floors))
        found = names.mapInArrow(_comparer(shared, at, counter), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _seeker(shared, at: int, group: int, least: float, best: int, cap: float, counter, step: int = 2048):
    """For each text that is asked the `best` greatest ratios (up to cap) among the task's names, of each group once: of every part
    of the names those with the greatest bounds are compared."""

    def run(batches):
        queries = Grams(shared.value)
        tops: list[dict] = [{} for _ in queries.texts]
        floors = [least] * len(tops)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                own, groups = Grams(part.column(at).to_pylist()), part.column(group).to_pylist()
                for q, text in enumerate(queries.texts):
                    rows, bounds = own.may_reach(queries, q, floors[q])
                    for row in rows[np.argsort(-bounds, kind="stable")[: 2 * best]].tolist():
                        if counter is not None:
                            counter.add(1)
                        score = min(cap, ratio_of(text, own.texts[row]))
                        if score > tops[q].get(groups[row], 0) and score >= least:
                            tops[q][groups[row]] = score
                    if len(tops[q]) > best:
                        tops[q] = dict(sorted(tops[q].items(), key=lambda x: -x[1])[:best])
                    if len(tops[q]) == best:
                        floors[q] = max(least, min(tops[q].values()))
        flat = [(q, g, s) for q, t in enumerate(tops) for g, s in t.items()]
        columns = [pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.int32(), pa.string(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["q", "grp", "score"])

    return run


def _comparer(shared, at: int, counter, step: int = 2048):
    def run(batches):
        asked, floors = shared.value
        queries = Grams(asked)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                own, rows, texts, scores = Grams(part.column(at).to_pylist()), [], [], []
                for q, text in enumerate(queries.texts):
                    for row in own.may_reach(queries, q, floors[q])[0].tolist():
                        if counter is not None:
                            counter.add(1)
                        score = ratio_of(text, own.texts[row])
                        if score >= floors[q]:
                            rows.append(row)
                            texts.append(text)
                            scores.append(score)
                kept = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string()), pa.array(scores, pa.float64())], [*kept.schema.names, "asked", "similarity"])

    return run


def normalised(text: Column) -> Column:
    """NFKC."""

    @pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return run(text)


def json_in(raw: str | None) -> str | None:
    """The JSON of a fenced block or between the outermost braces, mended where commas are left over, quotes are single or
    keys are bare; null if there is none."""
    raw = raw or ""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", raw, re.S)
    text = fenced[1] if fenced else raw
    a, b = text.find("{"), text.rfind("}")
    if a < 0 or b < a:
        return None
    text = text[a : b + 1]
    for mend in (lambda t: t, lambda t: re.sub(r",\s*([}\]])", r"\1", t), lambda t: re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', t), lambda t: t.replace("'", '"'), lambda t: t.replace("None", "null").replace("True", "true").replace("False", "false")):
        text = mend(text)
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            pass
    return None


def extract_json(raw: Column) -> Column:
    """JSON text, to be read by from_json with the schema that is expected."""

    @pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(json_in)

    return run(raw)
