"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
