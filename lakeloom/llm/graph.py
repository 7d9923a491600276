"""Connected components of a graph whose links are a table: alternating star contractions, each round written to the
shared folder. Links never meet in one task or on the driver: neighbourhood minima are sums by key, then joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import saved, written

#: Rows of a file.
EACH = 500_000


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): the smallest node that can be reached; nodes without a link to another are absent.

    Nulls and loops are dropped. Large star: a node's larger neighbours move to the smallest node around it. Small star:
    its smaller neighbours do, and itself. The links shrink to stars in O(log^2 n) rounds; a round that changes nothing
    ends it. A round either changes nothing or moves a link to a smaller node, so there is a last one, and no limit is set.
    """
    some = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    e = saved(links.where(some).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now

        def kept(df: DataFrame, what: str) -> DataFrame:
            """A table of a round: no more rows than twice the links, in files of EACH of them."""
            return written(df.coalesce(max(1, -(-2 * now[0] // EACH))), what)

        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written, so that both sides of the join are plain shuffles, and a hub's links can be split.
        low = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = kept(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        e = kept(large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "links")
