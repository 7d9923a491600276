"""What the training-data operators share: reading tables, the shared folder, hashing of ids."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.cut import bounded

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local
    master, as in tests; on a cluster that is an error, as executors would not see each other's files."""
    bounded(spark)
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return sc.getCheckpointDir()  # with the scheme of its file system, which the name may lack
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakeloom-"))
    return sc.getCheckpointDir()


def own_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; a lost executor costs no recomputation before this point."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table of the shared folder. Unlike a checkpoint it has a size of its own: a loop of joins whose
    rounds are checkpoints multiplies their estimates, which soon takes longer than the joins."""
    path = own_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it one that no column has (in any case of letters)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def fold_ascii(c: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32(doc_id as text) mod `mod` equals `rest`; rows without an id are held out, as nothing is learned from them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(True))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(keys: DataFrame, most: int = 500_000) -> DataFrame:
    """A saved table of keys, to be broadcast if it is small, so that texts are not shuffled for it."""
    return F.broadcast(keys) if keys.count() <= most else keys
