"""Long texts reach Python in small Arrow batches in every registered query."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lakeloom import catalog
from lakeloom.catalog.base import Tables

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def folder(spark, tmp_path):
    was = spark.conf.get(KEY)
    spark.conf.unset(KEY)
    html = F.concat(F.lit("<title>t</title><a href='/x'>x</a>"), F.repeat(F.lit("<p>word</p>"), 10_000))
    spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), html.alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    yield str(tmp_path)
    spark.conf.set(KEY, was)


def most(spark, folder):
    @pandas_udf("long")
    def together(x: pd.Series) -> pd.Series:
        return pd.Series([int(x.str.len().sum())] * len(x))

    return spark.read.parquet(f"{folder}/pages.parquet").coalesce(1).agg(F.max(together("html"))).first()[0]


def test_a_setting_of_the_users_stays(spark, folder):
    spark.conf.set(KEY, "8m")
    Tables(spark, folder)
    assert spark.conf.get(KEY) == "8m"


@pytest.mark.parametrize("name", ["convert_tally", "page_rewrite"])
def test_batches_do_not_grow(spark, folder, name):
    assert most(spark, folder) > 10e6
    catalog.QUERIES[name](spark, folder)
    assert most(spark, folder) < 5e6
