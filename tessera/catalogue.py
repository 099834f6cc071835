"""Named queries over the TPC-H-like tables, each with SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def same(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers SQL that Spark and DuckDB both run (or DuckDB's own wording of it) over the tables that it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", sql):
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    run.__name__ = name
    query(oracle or sql)(run)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from tessera.plans import optimisation, relational, scalar, surface, texts, tpch  # noqa: E402, F401
