"""A BM25 index that grows by batches: postings and lengths of a batch, and by how much it changes the sums, stand by themselves.

    tf/batch=N (doc, term, tf)    dl/batch=N (doc, len)    df/batch=N (term, df)    stats/batch=N (key, docs, n, total)

A document that comes again replaces what it was: its former terms are taken off the document frequencies, and its postings
count under its last batch only. The row of stats is written last: without it a batch is not there, and is written anew; a
batch whose key is there already changes nothing, so replays count once. There is one writer to a folder at a time.

Rows without an id are left out; of equal ids in one batch the greatest text stays; a null text has no terms and counts as a
document; without rows a batch changes nothing but that its key is known.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import bm25
from lakeloom.operators.cut import saved

#: Text of a part of a batch, whose postings are sorted in one task.
PART_BYTES = 16e6
SUMS = "key string, docs long, n long, total long, batch int"


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def sums(spark: SparkSession, folder: str) -> DataFrame:
    """The batches that are there, a row for each."""
    return spark.read.schema(SUMS).parquet(f"{folder}/stats") if _there(spark, f"{folder}/stats") else spark.createDataFrame([], SUMS)


def _last(spark: SparkSession, folder: str) -> int:
    return sums(spark, folder).agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("b")).first()["b"]


def _up_to(spark: SparkSession, folder: str, name: str, last: int) -> DataFrame:
    """Rows of the batches that are there, and not of one that is being written. The last batch tells the columns."""
    schema = spark.read.parquet(f"{folder}/{name}/batch={last}").schema.add("batch", "integer")
    return spark.read.schema(schema).parquet(f"{folder}/{name}").where(F.col("batch") <= last)


def _latest(dl: DataFrame) -> DataFrame:
    """(doc, batch, len): each document as it came last."""
    return dl.groupBy("doc").agg(F.max(F.struct("batch", "len")).alias("l")).select("doc", "l.batch", "l.len")


def _parts(docs: DataFrame, text_col: str) -> int:
    """In how many parts a batch is written: as many as its bytes of text ask for, so that what a task sorts does not grow."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()["b"]
    return max(math.ceil(size / PART_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / 1e6)), 1)


def add(docs: DataFrame, folder: str, key: str, id_col: str, text_col: str, params: bm25.Params | None = None) -> bool:
    """Adds a batch of documents under its key; False if it was there. Reads the ids of the index, and of its postings only
    batches that hold a document that comes again."""
    spark, p = docs.sparkSession, params or bm25.Params()
    if not sums(spark, folder).where(F.col("key") == key).isEmpty():
        return False
    last = _last(spark, folder)
    at = {name: f"{folder}/{name}/batch={last + 1}" for name in ("tf", "dl", "df", "stats")}
    rows = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.max(text_col).alias("text")).repartition(_parts(docs, text_col), "doc")
    # Lengths and postings from one pass: a document without terms has one row without a term. Terms are counted within their row.
    terms = rows.select("doc", F.explode_outer(bm25.counted(bm25.tokens(F.col("text"), p))).alias("t"))
    terms.select("doc", "t.term", F.coalesce("t.tf", F.lit(0)).alias("tf")).sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(at["tf"])
    tf = spark.read.parquet(at["tf"])
    tf.groupBy("doc").agg(F.sum("tf").alias("len")).write.mode("overwrite").parquet(at["dl"])
    dl = spark.read.parquet(at["dl"])
    more = tf.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    now = dl.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
    n, total = now["n"], now["total"]
    if last >= 0:
        before = _up_to(spark, folder, "dl", last).join(dl.select("doc"), "doc", "left_semi")
        again = saved(_latest(before))
        was = again.groupBy("batch").agg(F.count("*").alias("n"), F.sum("len").alias("total")).collect()  # a row for each batch
        if was:
            gone = _up_to(spark, folder, "tf", last).where(F.col("term").isNotNull() & F.col("batch").isin([r["batch"] for r in was])).join(again.select("doc", "batch"), ["doc", "batch"], "left_semi")
            less = gone.groupBy("term").agg((-F.count("*")).alias("df"))
            more = more.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            n, total = n - sum(r["n"] for r in was), total - sum(r["total"] for r in was)
    more.write.mode("overwrite").parquet(at["df"])
    row = spark.createDataFrame([(key, now["n"], n, total)], "key string, docs long, n long, total long").coalesce(1)
    row.write.mode("overwrite").parquet(at["stats"])
    return True


def index(spark: SparkSession, folder: str, params: bm25.Params | None = None) -> bm25.Index:
    """The index as it stands, equal to bm25.build over each document as it came last."""
    last = _last(spark, folder)
    if last < 0:
        raise ValueError(f"no batch was added to {folder}")
    all_of = sums(spark, folder).where(F.col("batch") <= last)
    tf, dl = _up_to(spark, folder, "tf", last).where("term IS NOT NULL"), _up_to(spark, folder, "dl", last)
    if all_of.agg(F.sum(F.col("docs") - F.col("n")).alias("again")).first()["again"]:
        dl = _latest(dl)
        tf = tf.join(dl.select("doc", "batch"), ["doc", "batch"], "left_semi")
    df = _up_to(spark, folder, "df", last).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    stats = all_of.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avg_len"))
    return bm25.Index(tf.select("doc", "term", "tf"), dl.select("doc", "len"), df, stats, params or bm25.Params())


def compacted(spark: SparkSession, folder: str, to: str) -> None:
    """The index as one batch in another folder, where it grows on; the keys of all batches stay known there."""
    last = _last(spark, folder)
    now = index(spark, folder)
    bare = now.dl.where("len = 0").select("doc", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))
    now.tf.unionByName(bare).repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{to}/tf/batch={last}")
    now.dl.write.mode("overwrite").parquet(f"{to}/dl/batch={last}")
    now.df.write.mode("overwrite").parquet(f"{to}/df/batch={last}")
    # Sums of all batches stay with their keys; no document of them comes twice any more.
    sums(spark, folder).select("key", F.col("n").alias("docs"), "n", "total").coalesce(1).write.mode("overwrite").parquet(f"{to}/stats/batch={last}")
