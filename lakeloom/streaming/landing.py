"""Pages that land in a folder, as a stream: read, dropped if their URL came before, read off, appended.

Duplicates are told within a watermark, so the state stays bounded; files are taken in bounded batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.functions import html, urls

LANDED = "url string, html string, fetched_at timestamp"


def landed(spark: SparkSession, folder: str, files: int = 500) -> DataFrame:
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files).parquet(folder)


def first_seen(stream: DataFrame, within: str = "1 day") -> DataFrame:
    """Each page once, by its URL without scheme, query and fragment."""
    return stream.withColumn("key", urls.same_page_key(F.col("url"))).withWatermark("fetched_at", within).dropDuplicatesWithinWatermark(["key"])


def extracted(stream: DataFrame, options: html.Options | None = None) -> DataFrame:
    p = stream.withColumn("p", html.page(F.col("url"), F.col("html"), options))
    return p.select("url", "fetched_at", F.col("p.title").alias("title"), F.col("p.markdown").alias("content"), F.col("p.anchors").alias("anchors"))


def counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages by host and window."""
    return stream.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", window), urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def run(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to a table; with `once` what is there now, then it ends."""
    w = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()
