"""What query modules share: the registry and fixtures that read the same in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.operators.cut import bounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Queries on tables once more, on their fixtures, for the tests: a function of spark, and its SQL.
CASES: dict[str, tuple[Callable[[SparkSession], DataFrame], str]] = {}


class Tables:
    """The tables of a data folder: called with a name it gives the table, stream() gives its files as a stream."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        bounded(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def stream(self, table: str, files: int = 1000) -> DataFrame:
        """The table's files as a stream. The name is a pattern, as a stream takes a table of a single file by a pattern only."""
        read = self.spark.readStream.schema(self(table).schema).option("maxFilesPerTrigger", files)
        return read.parquet(f"{self.sf_dir}/{table}.parque[t]")

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, read), where read(table) is a table of the data folder, under its name."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, Tables(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[name or f.__name__] = run
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return wrap


class Derived:
    """A table made of the given ones: in Spark by a function of read, in SQL by a SELECT."""

    def __init__(self, sql: str, df: Callable[[Callable[[str], DataFrame]], DataFrame]):
        self.sql, self.df = f"({sql})", df


def query_on(sql: str, **inputs: tuple[Derived, Fixture]):
    """Registers a function of (spark, inputs...), over tables and, for the tests, over the fixtures that stand beside them. The
    SQL names an input as <<name>>."""

    def filled(side: int) -> str:
        out = sql
        for name, both in inputs.items():
            out = out.replace(f"<<{name}>>", both[side].sql)
        return out

    def wrap(f):
        @query(filled(0), name=f.__name__)
        def run(spark, read):
            return f(spark, **{name: both[0].df(read) for name, both in inputs.items()})

        QUERIES[f.__name__].__doc__ = f.__doc__
        CASES[f.__name__] = (lambda spark: f(spark, **{name: both[1].df(spark) for name, both in inputs.items()}), filled(1))
        return f

    return wrap


class Fixture:
    """A small table given by its rows. schema: Spark DDL of simple types."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [c.split()[0] for c in schema.split(",")]
        self.kinds = [c.split()[1].lower() for c in schema.split(",")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        kind = {"string": "VARCHAR", "int": "INT", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}

        def lit(v, k):
            if v is None:
                return f"NULL::{kind[k]}"
            if k == "string":
                text = "'" + v.replace("'", "''") + "'"
                return text.replace("\n", "' || chr(10) || '")
            return f"{v}::{kind[k]}"

        rows = ", ".join("(" + ", ".join(lit(v, k) for v, k in zip(r, self.kinds)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS v({', '.join(self.names)}))"
