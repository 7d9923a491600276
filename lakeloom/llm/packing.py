"""Packing into optimal length buckets.

The histogram of lengths over all documents goes to the driver: a row for each distinct length, of which a corpus of T
tokens has sqrt(2 T) at most, as they add up to no more than T. Dynamic programming picks the bucket boundaries with the
least padding; inside each bucket documents get consecutive ranks, and every `budget // boundary` of them form a batch.
Ranks come from row numbers in hash shards plus the counts of the shards before, so no bucket meets in one task and only
the last batch of a bucket can be short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import free, saved, table
from lakeloom.llm.line_dedup import BLANKS


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII blanks."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def bin_of(n: Column, fine: int) -> Column:
    """Lengths below 2 * fine have a bin each; beyond, there are `fine` bins to a power of two."""
    wide = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - fine.bit_length() + 1)
    return F.when(n < 2 * fine, n).otherwise((F.floor(n / wide) * wide).cast("long"))


def boundaries(top: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Bins in order (their greatest length, rows, sum of lengths) -> the boundaries with the least padding, and that padding.

    best[k][j]: the least padding of the first j bins in k buckets. The cost of bins i..j in a bucket fulfils the
    quadrangle inequality, so the best split moves right with j and each layer is solved by halving, all halves of one
    depth together; ties go left.
    """
    m = len(top)
    if not m:
        return [], 0
    c, s = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(total)))
    best = np.concatenate(([0], top * c[1:] - s[1:])).astype(np.int64)
    splits = []
    for k in range(2, min(buckets, m) + 1):
        now, at = np.full(m + 1, np.iinfo(np.int64).max // 4), np.zeros(m + 1, np.int64)
        lo, hi, a, b = (np.array([x]) for x in (k, m, k - 1, m - 1))
        while len(lo):
            j = (lo + hi) // 2
            n = np.minimum(b, j - 1) - a + 1
            first = np.cumsum(n) - n
            i = np.arange(n.sum()) - np.repeat(first - a, n)
            e = np.repeat(j, n)
            v = best[i] + top[e - 1] * (c[e] - c[i]) - (s[e] - s[i])
            now[j] = np.minimum.reduceat(v, first)
            where = np.flatnonzero(v == np.repeat(now[j], n))
            x = i[where[np.searchsorted(where, first)]]
            at[j] = x
            lo, hi, a, b = (np.concatenate(y) for y in ((lo, j + 1), (j - 1, hi), (a, x), (x, b)))
            go = lo <= hi
            lo, hi, a, b = lo[go], hi[go], a[go], b[go]
        splits.append(at)
        best = now
    ends, j = [], m
    for at in reversed(splits):
        ends.append(j)
        j = int(at[j])
    return [int(top[e - 1]) for e in [j, *ends[::-1]]], int(best[m])


def shard(key: Column) -> Column:
    """One of 1,024, by ten bits of a hash; null keys have their own."""
    return F.conv(F.left(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)), 16, 10).cast("int") % 1024


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = 16, budget: int = 32_768, fine: int | None = None) -> DataFrame:
    """The input's rows and columns, with n_tokens, bucket (from 0), bucket_len, batch (from 0, in its bucket), slot and
    padding; columns of these names are replaced.

    length: tokens of a row; words of the text unless given, 0 for null. It is read three times, so what is dear to count
    is better counted into a saved column first (see query()). A row longer than the budget is a batch of its own. Rows
    with equal or no ids are rows of their own; rows of equal id and length can change places. Texts are counted whole,
    however long. An empty table gives an empty table. Boundaries are exact; fine: on request, lengths from 2 * fine on
    are told apart to 1/fine only, for a smaller histogram.
    """
    new = ["n_tokens", "bucket", "bucket_len", "batch", "slot", "padding"]
    n = F.coalesce(n_words(F.col(text_col)) if length is None else length.cast("long"), F.lit(0))
    own, part, rank, before = free([*docs.columns, *new], "n", "shard", "rank", "before")
    counted = docs.withColumn(own, n)  # before any column is replaced, as `length` may be of the same name
    key = F.col(own) if fine is None else bin_of(F.col(own), fine)
    hist = docs.select(n.alias(own)).groupBy(key.alias("bin")).agg(F.max(own).alias("top"), F.count("*").alias("c"), F.sum(own).alias("s")).collect()
    bins = np.array(sorted((r["top"], r["c"], r["s"]) for r in hist), np.int64).reshape(-1, 3)
    ends, _ = boundaries(bins[:, 0], bins[:, 1], bins[:, 2], buckets)
    edge = F.array(*[F.lit(e).cast("long") for e in ends or [0]])

    def bucket(n: Column) -> Column:
        out = F.when(n <= F.lit((ends or [0])[0]), 0)
        for k, e in enumerate(ends[1:], 1):
            out = out.when(n <= F.lit(e), k)
        return out.otherwise(max(0, len(ends) - 1))

    keys = docs.select(shard(F.col(id_col)).alias(part), n.alias(own)).select(bucket(F.col(own)).alias("bucket"), part)
    ahead = keys.groupBy("bucket", part).count().select("bucket", part, (F.sum("count").over(Window.partitionBy("bucket").orderBy(part)) - F.col("count")).alias(before))
    rows = counted.withColumn(part, shard(F.col(id_col))).withColumn("n_tokens", F.col(own)).withColumn("bucket", bucket(F.col(own)))
    order = Window.partitionBy("bucket", part).orderBy(F.col(id_col), F.col(own))
    # At most `buckets` x 1,024 rows are broadcast.
    out = rows.withColumn(rank, F.row_number().over(order) - 1).join(F.broadcast(ahead), ["bucket", part]).withColumn(rank, F.col(rank) + F.col(before))
    out = out.withColumn("bucket_len", F.element_at(edge, F.col("bucket") + 1))
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("long")
    out = out.withColumns({"batch": F.floor(F.col(rank) / each).cast("long"), "slot": F.pmod(F.col(rank), each).cast("long"), "padding": F.col("bucket_len") - F.col("n_tokens")})
    return out.drop(rank, before, part, own)


def packed(docs: DataFrame) -> DataFrame:
    """pack() of (doc_id, text) without the text: words are counted once, into a saved table of ids and lengths."""
    lengths = saved(docs.select("doc_id", n_words(F.col("text")).alias("n")))
    return pack(lengths, length=F.col("n")).select("doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot", "padding")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
h AS (SELECT max(n) AS top, count(*) AS c, sum(n) AS s FROM d
      GROUP BY n),
cum AS (
  SELECT row_number() OVER w AS j, top, (sum(c) OVER w)::BIGINT AS cc, (sum(s) OVER w)::BIGINT AS ss FROM h WINDOW w AS (ORDER BY top)),
size AS (SELECT count(*) AS m, least(16, count(*)) AS k FROM cum),
dp(k, j, best) AS (
  SELECT 1::BIGINT, j, {'v': (top * cc - ss)::BIGINT, 'i': 0::BIGINT} FROM cum
  UNION ALL
  SELECT dp.k + 1, b.j, min({'v': (dp.best.v + b.top * (b.cc - a.cc) - (b.ss - a.ss))::BIGINT, 'i': a.j::BIGINT})
  FROM dp JOIN cum a ON a.j = dp.j JOIN cum b ON b.j > a.j, size
  WHERE dp.k < size.k AND a.j >= dp.k GROUP BY dp.k, b.j),
back(k, j) AS (
  SELECT k, m FROM size
  UNION ALL
  SELECT back.k - 1, dp.best.i FROM back JOIN dp ON dp.k = back.k AND dp.j = back.j WHERE back.k > 1),
ends AS (SELECT list(top ORDER BY top) AS e FROM back JOIN cum USING (j)),
placed AS (SELECT doc_id, n, len(list_filter(e, lambda x: x < n)) AS bucket, e, ('0x' || left(md5(doc_id::VARCHAR), 3))::INT % 1024 AS shard FROM d, ends),
ranked AS (SELECT *, e[bucket + 1] AS bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY shard, doc_id, n) - 1 AS r FROM placed)
SELECT doc_id, n AS n_tokens, bucket::INT AS bucket, bucket_len, r // greatest(1, 32768 // greatest(1, bucket_len)) AS batch,
       r % greatest(1, 32768 // greatest(1, bucket_len)) AS slot, bucket_len - n AS padding
FROM ranked
"""
