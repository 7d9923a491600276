"""Top-k by BM25 for many queries at once, without a row for every document that shares a term with a query.

Documents are dealt to ranges of bounded size, by documents and by postings, by a hash, and the postings of a range, as far as any query asks for their
terms, meet in one task. There documents with about as many terms stand in one block, and each term knows its greatest
weight in each block that has it. A query adds up these weights, which bounds the scores of a block from above, and reads
blocks in the order of their bounds, until the next bound is below the k-th score. Each range gives k rows for a query at
most, and these are merged. Blocks are small, as bounds of large ones hold nothing off: of 200 queries over 10,000 documents
40 % of the documents with a common term were scored in blocks of 8, 14 % in blocks of 4 and 2.7 % in blocks of 2.

What is passed over is below the k-th score of its range for certain, so the result is that of scoring everything.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lakeloom.operators import bm25

#: Documents of a range, about, and of a block.
RANGE, BLOCK = 16_384, 2
#: Postings of a range, about: what a task holds of it takes some hundred bytes each, however long the documents are.
POSTINGS = 500_000
#: MB of query terms that are broadcast at a time; one pass over the postings for each.
TERMS_MB = 16


class Postings:
    """The postings of a range by term and block. doc: numbers from 0 in any order; place[doc] is where it stands."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int):
        names, term = np.unique(term, return_inverse=True)
        self.order = np.argsort(np.bincount(doc, minlength=n_docs), kind="stable")
        self.place = np.empty(n_docs, np.int64)
        self.place[self.order] = np.arange(n_docs)
        at = self.place[doc]
        by = np.lexsort((at, term))
        self.at, self.weight, self.blocks = at[by], weight[by], -(-n_docs // BLOCK)
        key = term[by] * self.blocks + self.at // BLOCK
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.begin, self.end = begin, np.append(begin[1:], len(key))
        self.most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.block = key[begin] % max(1, self.blocks)
        edge = np.searchsorted(key[begin] // max(1, self.blocks), np.arange(len(names) + 1))
        self.span = {t: slice(a, b) for t, a, b in zip(names.tolist(), edge[:-1].tolist(), edge[1:].tolist())}


def walk(p: Postings, n_docs: int, terms: list[int], shares: list[float], k: int, slack: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, how many were scored) of a query: all that can be among its k best, slack below the k-th included."""
    here = [(p.span[t], c) for t, c in zip(terms, shares) if t in p.span]
    bound = np.zeros(p.blocks)
    for span, c in here:
        bound[p.block[span]] += c * p.most[span]
    todo = np.argsort(-bound, kind="stable")
    todo = todo[: int((bound > 0).sum())]
    score, least, step = np.zeros(n_docs), -np.inf, max(1, -(-k // BLOCK))
    while len(todo) and bound[todo[0]] >= least:
        now, todo = todo[:step], todo[step:]
        now = now[bound[now] >= least]
        asked = np.zeros(p.blocks, bool)
        asked[now] = True
        for span, c in here:
            some = asked[p.block[span]]
            begin, size = p.begin[span][some], (p.end[span] - p.begin[span])[some]
            rows = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            score[p.at[rows]] += c * p.weight[rows]
        best = score[score > 0]
        if len(best) >= k:
            least = float(np.partition(best, len(best) - k)[len(best) - k]) - slack
    found = np.flatnonzero(score > 0)
    scored = len(found)
    found = found[score[found] >= least]
    return p.order[found], score[found], scored


def searcher(shared, k: int, slack: float, digits: int | None, id_type: pa.DataType, counter):
    """The postings of a range -> the best of them for each of the queries that were broadcast."""

    def search(t: pa.Table) -> pa.Table:
        docs = t["doc"].combine_chunks()
        unique = docs.unique().sort()
        place = pc.index_in(docs, unique).to_numpy(zero_copy_only=False).astype(np.int64)
        p, found, total = Postings(t["number"].to_numpy(), place, t["weight"].to_numpy(), len(unique)), [], 0
        for q, (_, numbers, shares) in enumerate(shared.value):
            at, score, taken = walk(p, len(unique), numbers, shares, k, slack)
            total += taken
            order = np.lexsort((at, -(np.round(score, digits) if digits is not None else score)))[:k]
            found.append((np.full(len(order), q), at[order], score[order]))
        if counter is not None:
            counter.add(total)
        q, at, score = (np.concatenate([f[c] for f in found]) for c in range(3))
        ids = pa.array([shared.value[i][0] for i in q.tolist()], id_type)
        return pa.table([ids, unique.take(pa.array(at)), pa.array(score)], ["query_id", "doc", "score"])

    return search


def topk(index: bm25.Index, queries: DataFrame, k: int = 10, *, id_col: str = "query_id", text_col: str = "query", digits: int | None = None, range_docs: int = RANGE, terms_mb: float = TERMS_MB, counter=None) -> DataFrame:
    """(query_id, doc, score, rank): each query's k best documents that have a term of it, ties by document.

    digits: scores are rounded so before they are compared. A null or empty query finds nothing; a term that a query
    repeats counts again. counter: an accumulator that gets how many documents were scored, over all queries.
    """
    spark = index.tf.sparkSession
    asked = bm25.exploded(queries, id_col, text_col, index.params).groupBy(F.col("doc").alias("query_id"), "term").agg(F.count("*").alias("times"))
    stats = index.stats.first()
    n, avg = F.lit(stats["n"]), F.lit(float(stats["avg_len"] or 0.0))
    asked = bm25.saved(asked.join(index.df, "term").select("query_id", "term", (F.col("times") * bm25.idf(n, F.col("df"))).alias("share"), "df"))
    size = asked.agg(F.sum(F.length("term") + 48).alias("b")).first()["b"] or 0
    postings = asked.select("term", "df").distinct().agg(F.sum("df").alias("n")).first()["n"] or 0
    passes, ranges = max(1, math.ceil(size / (terms_mb * 1e6))), max(1, math.ceil(stats["n"] / range_docs), math.ceil(postings / POSTINGS))
    part = bm25.weight(F.col("tf"), F.col("len"), avg, index.params)
    weighted = index.tf.join(index.dl, "doc").select("doc", "term", part.alias("weight"))
    slack, kind = 0.0 if digits is None else 2 * 10.0**-digits, dict(index.tf.dtypes)["doc"]
    out = None
    for own in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == own).orderBy("query_id", "term").collect()  # bounded by terms_mb
        number = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
        by_query: dict = {}
        for r in rows:
            by_query.setdefault(r["query_id"], []).append((number[r["term"]], r["share"]))
        shared = spark.sparkContext.broadcast([(q, [t for t, _ in x], [c for _, c in x]) for q, x in by_query.items()])
        terms = F.broadcast(spark.createDataFrame(list(number.items()), "term string, number int"))
        id_type = queries.schema[id_col].dataType

        met = weighted.join(terms, "term").select(F.pmod(F.xxhash64("doc"), F.lit(ranges)).alias("range"), "doc", "number", "weight")
        got = met.groupBy("range").applyInArrow(searcher(shared, k, slack, digits, to_arrow_type(id_type), counter), f"query_id {id_type.simpleString()}, doc {kind}, score double")
        out = got if out is None else out.unionByName(got)
    if digits is not None:
        out = out.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

