"""BM25 over documents: an index of three tables, search by many queries at once, one-document similarity.

Only the terms of the queries are read from the postings, by an equi-join; sums by (query, document) follow. Documents
without any token count in the corpus size and the mean length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators.cut import saved
from lakeloom.sources import corpus


@dataclass(frozen=True)
class Params:
    k1: float = 1.2
    b: float = 0.75
    least: int = 2
    most: int | None = 30
    stemmed: bool = True


@dataclass(frozen=True)
class Index:
    """tf (doc, term, tf), dl (doc, len), df (term, df), stats (n, avg_len; one row)."""

    tf: DataFrame
    dl: DataFrame
    df: DataFrame
    stats: DataFrame
    params: Params

    def saved(self, folder: str) -> Index:
        """The index as tables in a folder, the postings by ranges of terms: later searches read only what they ask for."""
        for name in ("tf", "dl", "df", "stats"):
            table = getattr(self, name)
            table = table.repartitionByRange("term").sortWithinPartitions("term") if name in ("tf", "df") else table
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
        return load(self.tf.sparkSession, folder, self.params)


def load(spark, folder: str, params: Params | None = None) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{n}") for n in ("tf", "dl", "df", "stats")), params or Params())


def tokens(text: Column, p: Params) -> Column:
    return T.tokens(text, p.stemmed, p.least, p.most)


def exploded(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """(doc, term): one row per token. Tokens are stemmed and filtered within the array: compiled, the rules make a method
    that is too long for the JIT, and take more than twice as long."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(tokens(F.col(text_col), p)).alias("term"))


def counted(tokens: Column) -> Column:
    """array(struct(term, tf)): the distinct tokens of an array, sorted, and how often each stands there. Told within the row: the
    tokens are sorted, and each run of equal ones is as long as from its begin to the next."""

    def runs(s: Column) -> Column:
        begin = F.filter(F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        ends = lambda b: F.transform(b, lambda i, n: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, n + 1), F.size(s)) - i).cast("long").alias("tf")))
        return F.get(F.transform(F.array(begin), ends), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(tokens)), runs), F.lit(0))  # of one element, so that it is worked out once


def build(docs: DataFrame, id_col: str, text_col: str, params: Params | None = None) -> Index:
    p = params or Params()
    tf = exploded(docs, id_col, text_col, p).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    some = tf.groupBy("doc").agg(F.sum("tf").alias("len"))
    dl = docs.select(F.col(id_col).alias("doc")).join(some, "doc", "left").select("doc", F.coalesce("len", F.lit(0)).alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    stats = dl.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    return Index(tf, dl, df, stats, p)


def build_from_files(spark: SparkSession, paths: list[str] | str, params: Params | None = None, most_lines: int = 100) -> Index:
    """An index of files by their paths, over the first lines of each."""
    return build(corpus.first_lines_of(spark, paths, most_lines), "path", "text", params)


def build_for(queries: DataFrame, id_col: str, text_col: str, docs: DataFrame, doc_id: str, doc_text: str, params: Params | None = None) -> Index:
    """The index as far as these queries need it: lengths of all documents, postings of the queries' terms only. For a search
    that is made once; of other terms only their number in a document leaves the task that reads it."""
    p = params or Params()
    asked = exploded(queries, id_col, text_col, p).select("term", F.col("term").alias("hit")).distinct()
    # Saved, as a filter on `hit` would else go below the sums and read all tokens once more.
    some = saved(exploded(docs, doc_id, doc_text, p).join(asked, "term", "left").groupBy("doc", "hit").agg(F.count("*").alias("tf")))
    tf = some.where(F.col("hit").isNotNull()).select("doc", F.col("hit").alias("term"), "tf")
    dl = docs.select(F.col(doc_id).alias("doc")).join(some.groupBy("doc").agg(F.sum("tf").alias("len")), "doc", "left").select("doc", F.coalesce("len", F.lit(0)).alias("len"))
    return Index(tf, dl, tf.groupBy("term").agg(F.count("*").alias("df")), dl.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")), p)


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def weight(tf: Column, length: Column, avg: Column, p: Params) -> Column:
    return tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length / avg))


def scores(index: Index, queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, doc, score, terms): every document that has a term of the query; a term that a query repeats counts again."""
    asked = exploded(queries, id_col, text_col, index.params).groupBy(F.col("doc").alias("query_id"), "term").agg(F.count("*").alias("times"))
    hits = index.tf.join(asked, "term").join(index.df, "term").join(index.dl, "doc").crossJoin(F.broadcast(index.stats))  # stats is one row
    part = F.col("times") * idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("len"), F.col("avg_len"), index.params)
    return hits.groupBy("query_id", "doc").agg(F.sum(part).alias("score"), F.sort_array(F.collect_set("term")).alias("terms"))


def search(index: Index, queries: DataFrame, top_k: int = 10, min_score: float = 0.0, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """Each query's top documents, best first, ties by document. With min_score 0 documents without a term count with 0,
    and fill up what is missing to top_k."""
    found = scores(index, queries, id_col, text_col)
    if min_score <= 0:  # no score is below 0
        # The first documents by id are enough: of top_k, those that have no term make up for what was not found.
        least = index.dl.orderBy("doc").limit(top_k).select("doc")
        rest = queries.select(F.col(id_col).alias("query_id")).join(F.broadcast(least), F.lit(True)).join(found.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
        found = found.unionByName(rest.select("query_id", "doc", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("terms")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return found.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def best_over_queries(found: DataFrame, top_k: int = 100) -> DataFrame:
    """Each document's best score over all queries; the top of them."""
    return found.groupBy("doc").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "doc").limit(top_k)


def one_doc_similarity(query: str, text: Column, stemmed: bool = True, k1: float = 1.2) -> Column:
    """BM25 of a query against a text that is the whole corpus: each term of the query weighs ln(4/3) * tf * (k1 + 1) / (tf + k1)."""
    asked = tokens(F.lit(query), Params(stemmed=stemmed))
    # A stem is its word but for the last letters, so only words that begin as one of the asked stems does are stemmed.
    begins = F.transform(asked, lambda t: F.left(t, F.length(t) - T.MOST_NEW)) if stemmed else asked
    likely = lambda s: F.filter(s["words"], lambda w: F.exists(s["begins"], lambda b: w.startswith(b)))
    few = F.get(F.transform(F.array(F.struct(T.words(text).alias("words"), begins.alias("begins"))), likely), F.lit(0))
    own = F.transform(few, T.stem) if stemmed else few
    # Arrays of one element, so that a text's words are worked out once and not for each term.
    tfs = F.get(F.transform(F.array(own), lambda o: F.transform(asked, lambda t: F.size(F.filter(o, lambda x: x == t)).cast("double"))), F.lit(0))
    return F.aggregate(tfs, F.lit(0.0), lambda acc, n: acc + math.log(4 / 3) * n * (k1 + 1) / (n + k1))


def own_scores(texts: DataFrame, by: list[str], text_col: str, queries: DataFrame, id_col: str, query_col: str, p: Params) -> DataFrame:
    """(by..., score): one_doc_similarity of each text, the best over the queries; texts without a term are left out. The
    same sums as there, over exploded terms, for when texts or queries are many."""
    own = exploded(texts.withColumn("__id", F.struct(*by)), "__id", text_col, p).groupBy(F.col("doc").alias("__id"), "term").agg(F.count("*").alias("tf"))
    asked = exploded(queries, id_col, query_col, p).groupBy(F.col("doc").alias("__q"), "term").agg(F.count("*").alias("times"))
    part = F.col("times") * math.log(4 / 3) * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1)
    each = own.join(asked, "term").groupBy("__id", "__q").agg(F.sum(part).alias("s"))
    return each.groupBy("__id").agg(F.max("s").alias("score")).select(*[F.col(f"__id.{c}").alias(c) for c in by], "score")


def term_stats(index: Index) -> DataFrame:
    """Document and corpus frequency and idf of each term, by one sum over the postings."""
    counts = index.tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return counts.crossJoin(F.broadcast(index.stats.select("n"))).select("term", "df", "cf", idf(F.col("n"), F.col("df")).alias("idf"))  # stats is one row


def top_terms(index: Index, k: int = 10) -> DataFrame:
    order = Window.partitionBy("doc").orderBy(F.desc("tf"), "term")
    return index.tf.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_terms_of(docs: DataFrame, id_col: str, text_col: str, params: Params | None = None, k: int = 10) -> DataFrame:
    """(doc, term, tf, rank): top_terms() of an index of the documents, without the index. Terms are counted and ranked within their
    row; only ids are shuffled, to tell those that several rows have, whose rows alone are summed by id."""
    p, own = params or Params(), docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    again = saved(own.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("__d")))
    same, shared = F.col("doc").eqNullSafe(F.col("__d")), not again.isEmpty()
    best = F.slice(F.sort_array(F.transform(counted(tokens(F.col("text"), p)), lambda t: F.struct((-t["tf"]).alias("less"), t["term"].alias("term")))), 1, k)
    rows = (own.join(again, same, "left_anti") if shared else own).select("doc", F.posexplode(best).alias("pos", "t"))
    rows = rows.select("doc", "t.term", (-F.col("t.less")).alias("tf"), (F.col("pos") + 1).alias("rank"))
    return rows.unionByName(top_terms(build(own.join(again, same, "left_semi"), "doc", "text", p), k)) if shared else rows
