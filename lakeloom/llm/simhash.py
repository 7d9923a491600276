"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are 64-bit SimHashes of word shingles. Two of them at most `radius` bits apart agree on at least m of
radius + m bit groups, so each distinct fingerprint is put under every choice of m groups; m grows with the number of
fingerprints, so that a bucket of evenly spread ones stays within a block of 64. Within a bucket they are compared as
vertical bit planes: 64 fingerprints to a machine word, distances kept by carry-save counters, a block left as soon as
all its distances exceed the radius. A bucket sends a chain of its links, not its pairs; buckets beyond `tile` rows are
compared by pairs of tiles. Components come from star contractions (graph.py).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lakeloom.llm.common import saved, table
from lakeloom.llm.graph import components


def fingerprint_of(text: bytes, words_each: int = 4, seed: int = 42, step: int = 1 << 16) -> int:
    """The SimHash of A-Z-folded words split at ASCII blanks; a text's shingles are hashed `step` at a time."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - words_each + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[min(words_each, len(words)) - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, step):
        h = [digest(joined[a:b], seed) for a, b in zip(starts[at : min(at + step, n)].tolist(), ends[at : at + step].tolist())]
        bits = np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text_col, words_each: int = 4, seed: int = 42):
    """A column with the fingerprint as a signed long; null and blank texts get 0."""

    @pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        got = np.fromiter((fingerprint_of((t or "").encode(), words_each, seed) for t in texts), np.uint64, len(texts))
        return pd.Series(got.view(np.int64))

    return fp(text_col)


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, blocks) words: bit k of word (j, b) is bit j of fingerprint 64 b + k; the last block is filled with its first one."""
    full = np.resize(fps, 0) if not len(fps) else np.concatenate((fps, np.full(-len(fps) % 64, fps[0], np.uint64)))
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").transpose(2, 0, 1)).view(np.uint64)[:, :, 0]


def near(queries: np.ndarray, base: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with queries[i] and base[j] at most `radius` bits apart.

    For all pairs of a query and a block of 64: counter planes are added to bit by bit with carries; what overflows
    2^c - 1 >= radius + 1 stays marked. Every eight planes, pairs whose 64 distances all exceed the radius are left.
    """
    if not len(queries) or not len(base):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plane = planes(base)
    blocks, c = plane.shape[1], (radius + 1).bit_length()
    start = (1 << c) - 1 - radius  # the counters start here, so that the first distance beyond the radius overflows
    q, b = np.repeat(np.arange(len(queries)), blocks), np.tile(np.arange(blocks), len(queries))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    count = [np.full(len(q), full if start >> k & 1 else np.uint64(0)) for k in range(c)]
    over = np.zeros(len(q), np.uint64)
    for j in range(64):
        flip = np.where(queries >> np.uint64(j) & np.uint64(1), full, np.uint64(0))
        carry = plane[j][b] ^ flip[q]
        for k in range(c):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if j % 8 == 7:
            live = over != full
            if not live.all():
                q, b, over, count = q[live], b[live], over[live], [x[live] for x in count]
            if not len(q):
                break
    hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    row, k = np.nonzero(hit)
    j = b[row] * 64 + k
    ok = j < len(base)
    return q[row][ok], j[ok]


def chain(n: int, pairs) -> np.ndarray:
    """For each of n items the smallest item linked to it, over any way; pairs: arrays (i, j), again and again."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (root[root] != root).any():
                root = root[root]
    while (root[root] != root).any():
        root = root[root]
    return root


def linked(fps: np.ndarray, other: np.ndarray | None, radius: int, step: int = 1 << 21):
    """Links (a, b) that join what is near among fps, or between fps and other."""
    every = fps if other is None else np.concatenate((fps, other))
    base, shift = (fps, 0) if other is None else (other, len(fps))
    rows = max(1, step // max(1, (len(base) + 63) // 64))

    def pairs():
        for at in range(0, len(fps), rows):
            i, j = near(fps[at : at + rows], base[at // 64 * 64 :] if other is None else base, radius)
            yield i + at, j + (at // 64 * 64 if other is None else shift)

    root = chain(len(every), pairs())
    own = root != np.arange(len(every))
    return every[own], every[root[own]]


def groups_of(radius: int, m: int = 2) -> list[int]:
    """Masks of each choice of m out of radius + m bit groups."""
    edge = [round(64 * i / (radius + m)) for i in range(radius + m + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:])]
    return [sum(x) for x in combinations(one, m)]


def groups_for(n: int, radius: int) -> int:
    """The least m for which a bucket has 64 of n evenly spread fingerprints at most; one bit to a group is the end."""
    m = 2
    while m < 64 - radius and n >> (64 * m // (radius + m)) > 64:
        m += 1
    return m


def links(fps: DataFrame, radius: int = 4, tile: int = 20_000, m: int | None = None) -> DataFrame:
    """fps (fp long, distinct) -> links (a, b); the transitive closure is that of all pairs within the radius.
    m: bit groups that must agree, by the number of fingerprints unless given."""
    masks = groups_of(radius, m or groups_for(fps.count(), radius))
    spread = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("v")) for k, m in enumerate(masks)])).alias("x")).select("fp", "x.k", "x.v")
    sizes = spread.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    rows = spread.join(sizes, ["k", "v"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("k", "v", "fp", "own", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"))

    def within(it):
        """Buckets arrive one after the other, in order; the rows of the one that is not ended are kept."""
        rest = None
        for t in it:
            t = pa.Table.from_batches([t]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([t])])
            key = np.stack([t[c].to_numpy() for c in ("k", "v", "lo", "hi")])
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            if last:
                yield from bucket_links(t.slice(0, last), np.concatenate(([0], new)))
            rest = t.slice(last).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from bucket_links(rest, np.array([0, rest.num_rows]))

    def bucket_links(t, edge):
        fp, own, lo, hi = (t[c].to_numpy() for c in ("fp", "own", "lo", "hi"))
        fp, a, b = fp.view(np.uint64), [], []
        size = np.diff(edge)
        two = edge[:-1][(size == 2) & (lo[edge[:-1]] == hi[edge[:-1]])]
        if len(two):
            d = fp[two] ^ fp[two + 1]
            ok = np.unpackbits(d.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) <= radius
            a.append(fp[two][ok])
            b.append(fp[two + 1][ok])
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if e - s > 2 or e - s == 2 and lo[s] != hi[s]:
                if lo[s] == hi[s]:
                    got = linked(fp[s:e], None, radius)
                else:
                    left = own[s:e] == lo[s]
                    got = linked(fp[s:e][left], fp[s:e][~left], radius) if left.any() and not left.all() else ([], [])
                a.append(got[0])
                b.append(got[1])
        out = [np.concatenate([np.asarray(x, np.uint64) for x in xs] or [np.zeros(0, np.uint64)]).view(np.int64) for xs in (a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b"])

    in_order = dealt.repartition("k", "v", "lo", "hi").sortWithinPartitions("k", "v", "lo", "hi", "fp")
    return in_order.mapInArrow(within, "a long, b long").distinct()


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4, radius: int = 4, tile: int = 20_000) -> DataFrame:
    """One row per input row with an id: doc_id, fp (signed long), component_id: the smallest id reachable over links.

    Null and blank texts have fingerprint 0 and are linked like any other. Rows without an id are left out, as they can
    be no component's name; rows that repeat an id each get their row. An empty table gives an empty table.
    """
    return grouped(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words_each).alias("fp")), radius, tile)


def grouped(prints: DataFrame, radius: int = 4, tile: int = 20_000) -> DataFrame:
    """near_dedup() of rows (doc_id, fp) that have an id."""
    prints = saved(prints)
    first = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    # An id with several rows joins what its rows' fingerprints join.
    again = prints.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").join(prints, "doc_id").select("a", F.col("fp").alias("b")).where("a <> b")
    root = components(links(first.select("fp"), radius, tile).unionByName(again))
    named = first.join(root, first["fp"] == root["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    # Sums by key are saved, so that both sides of the joins are plain shuffles, whose large partitions are split.
    ids = saved(named.groupBy("root").agg(F.min("first").alias("component_id")))
    by_print = saved(named.select("fp", "root").join(ids, "root").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
