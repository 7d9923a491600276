"""Near copies by the exact Jaccard similarity of their word shingles, found by prefix filtering.

All shingles have one order: the rarer first, by counts over a share of the documents, ties by hash. Two sets of
similarity t share a shingle among the first n - ceil(t n) + 1 of each, so no pair is missed; the order decides how many
pairs are looked at, not which are found. Pairs go whose shared shingles, with all that can follow, are too few; what is left is told
by the whole sets of both texts.

Texts are shingled once for their SimHash and the shingles by which they are found, which are written as a table that all steps
read; only texts of pairs are shingled again.

Groups are found without all pairs of a group: texts that share a shingle are first compared with the smallest of them
alone, and then only what these links leave apart is compared in pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lakeloom.llm.common import few, saved, written
from lakeloom.llm.graph import components

#: A similarity of at least 4/5, in whole numbers.
OVER, OF = 4, 5


def every_shingle(text: str | None, words_each: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the shingles, repeats included, of A-Z-folded words split at ASCII blanks; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(words_each, len(words)) - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(ends))


def print_of(h: np.ndarray, step: int = 1 << 16) -> int:
    """The SimHash of all shingles of a text, `step` at a time."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), step):
        ones += np.unpackbits(h[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))


def ragged(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)))


def sets_of(docs: DataFrame, words_each: int) -> DataFrame:
    """docs (id, t) -> (id, h): the sorted distinct shingles."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), ragged([np.unique(every_shingle(t, words_each)) for t in b.column(1).to_pylist()])], ["id", "h"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h array<long>")


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The sets of a batch, as they were hashed."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum([0, *pc.list_value_length(column).to_pylist()])
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= OVER * (len(a) + len(b) - both)


def frequent(docs: DataFrame, words_each: int, share: float, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that several rows have of a share of all, the most frequent `most` at most. The
    share is the same at any size: with a fixed number of rows more and more of what is frequent would go unseen."""
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(1000)) < round(1000 * share))
    each = sets_of(some, words_each).select(F.explode("h").alias("h"))
    rows = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(most).collect()
    h, count = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], count[order]


def prefix(h: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The shingles of a set, h in order, by which any set similar to it can be found."""
    n = len(h) - -(-OVER * len(h) // OF) + 1
    if not len(common):
        return h[:n]
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return h[np.argsort(np.where(common[at] == h, count[at], 0), kind="stable")[:n]]


def hashed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, share: float = 0.25) -> DataFrame:
    """(id, fp, n, mark, p), written once: each row's SimHash, how many shingles it has, what tells rows of one id apart, and
    the shingles by which it is found, none for a null or blank text. Rows without an id are left out."""
    docs = named(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, words_each, share))

    def run(batches):
        common, count = shared.value
        for b in batches:
            prints, n, mark, first = [], [], [], []
            for t in b.column(1).to_pylist():
                h = every_shingle(t, words_each)
                prints.append(print_of(h))
                h = np.unique(h)
                n.append(len(h))
                mark.append(h.sum(dtype=np.uint64))
                first.append(prefix(h, common, count) if len(h) else h)
            marks = np.array(mark, np.uint64).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(marks), ragged(first)], ["id", "fp", "n", "mark", "p"])

    return written(docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp long, n int, mark int, p array<long>"), "shingles")


def prefixes(marked: DataFrame, without: DataFrame | None) -> DataFrame:
    """Saved rows (h, id, n, mark, at) of what hashed() gives: the shingles by which a text is found, where another text has
    them too; at: which of its shingles this is."""
    asked = marked if without is None else marked.join(few(without), "id", "left_anti")
    rows = asked.select("id", "n", "mark", F.posexplode("p").alias("at", "h")).select("h", "id", "n", "mark", "at")
    again = saved(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    return saved(rows.join(few(again, 2_000_000), "h"))


def side(rows: DataFrame, k: str, *more: str) -> DataFrame:
    return rows.select("h", F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "mark", "at", *more)])


def close_enough() -> Column:
    """Whether sets of these sizes can be similar that share the shingles at these places of their orders."""
    least = f"({OVER} * (n_a + n_b) + {OVER + OF - 1}) div {OVER + OF}"
    return (OF * F.col("n_a") >= OVER * F.col("n_b")) & (OF * F.col("n_b") >= OVER * F.col("n_a")) & F.expr(f"least(at_a, at_b) + 1 + least(n_a - 1 - at_a, n_b - 1 - at_b) >= {least}")


def pairs_of(rows: DataFrame, *more: str, apart: Column | None = None) -> DataFrame:
    """Saved distinct (a, b), a < b, of rows that share a shingle and can be similar."""
    both = side(rows, "a", *more).join(side(rows, "b", *more), "h").where((F.col("a") < F.col("b")) & close_enough() & (F.lit(True) if apart is None else apart))
    met = both.groupBy("a", "b", "n_a", "n_b", "mark_a", "mark_b").agg(F.count("*").alias("c"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    # What both have is counted up to the last shingle met, and up to the nearer end of the two prefixes.
    after = F.least(F.expr("n_a - 1 - at_a"), F.expr("n_b - 1 - at_b"), F.expr(f"({OVER} * greatest(n_a, n_b) + {OF - 1}) div {OF} - 1"))
    return saved(met.where((OVER + OF) * (F.col("c") + after) >= OVER * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct())


def told(pairs: DataFrame, docs: DataFrame, words_each: int) -> DataFrame:
    """The pairs whose sets are similar, of docs (id, t)."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    own = saved(sets_of(docs.join(few(ids), "id", "left_semi").select("id", "t"), words_each))

    @arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([similar(s, t) for s, t in zip(arrays(x), arrays(y))], pa.bool_())

    both = pairs.join(own.select(F.col("id").alias("a"), F.col("h").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("h").alias("y")), "b")
    return both.where(near("x", "y")).select("a", "b").distinct()


def links(docs: DataFrame, without: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, share: float = 0.25) -> DataFrame:
    """All (a, b), a < b, of ids whose texts have a Jaccard similarity of at least 0.8, but for ids that `without` (id) has.
    Null and blank texts have no shingle and rows without an id no name: they are in no pair."""
    marked = hashed(docs, id_col=id_col, text_col=text_col, words_each=words_each, share=share)
    return told(pairs_of(prefixes(marked, without)), named(docs, id_col, text_col), words_each)


def groups(docs: DataFrame, without: DataFrame | None = None, *, marked: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, share: float = 0.25) -> DataFrame:
    """(node, root) of the ids that links() joins with others, directly or over others: root is the smallest of a group.

    The same groups as by all links, but without all pairs of a group. Of the texts that share a shingle each is compared
    with the smallest; pairs that these links have brought into one group are not looked at any more. marked: what hashed()
    gave for these documents, if it is there.
    """
    marked = marked or hashed(docs, id_col=id_col, text_col=text_col, words_each=words_each, share=share)
    docs, rows = named(docs, id_col, text_col), prefixes(marked, without)
    lead = saved(rows.groupBy("h").agg(F.min(F.struct("id", "n", "mark", "at")).alias("s")).select("h", "s.*"))
    pairs = side(lead, "a").join(side(rows, "b"), "h").where((F.col("a") < F.col("b")) & close_enough()).select("a", "b").distinct()
    first = saved(told(saved(pairs), docs, words_each))
    root = components(first)
    rows = saved(rows.join(few(root).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    open_ = saved(rows.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h"))
    rest = told(pairs_of(rows.join(open_, "h"), "root", apart=F.col("root_a") != F.col("root_b")), docs, words_each)
    return components(first.unionByName(rest))
