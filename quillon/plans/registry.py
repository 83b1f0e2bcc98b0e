"""Registry of carrier queries: an operator applied to the driver's tables, with the SQL that should agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Tables:
    """t.orders reads orders.parquet of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def carrier(sql: str | None = None, longs: tuple[str, ...] = ()):
    """Register a query under its function's name; columns in `longs` are counted in 64 bits, as SQL does."""
    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = f(Tables(spark, folder))
            return df.withColumns({c: df[f"`{c}`"].cast("long") for c in longs}) if longs else df

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
