"""Cutting a plan: rows that later steps read more than once are written to the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Inputs beyond that are never dealt anew by spread().
SMALL_BYTES = 256 << 20


BATCH_BYTES, BATCH_DEFAULT = "4m", ("64m", "67108864b", "67108864")


def bounded(spark: SparkSession) -> None:
    """Texts reach Python in Arrow batches of a few MB, however long they are; a setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in BATCH_DEFAULT:
        spark.conf.set(key, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, with the scheme of its file system. Where that is unset, a temporary folder on a local master, as in
    tests; on a cluster that is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lakeloom-"))
    return sc.getCheckpointDir().rstrip("/")


def own_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """An input of a few MB that comes in fewer partitions than there are cores, dealt over all of them, for work that takes
    much longer than to move it. What is known or estimated to be larger than SMALL_BYTES stays as it is, however few its
    partitions are; those come from the scan's split size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SMALL_BYTES and df.rdd.getNumPartitions() < cores else df
