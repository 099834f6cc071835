"""Connected components over an edge table, never held in one place.

Alternates two relational steps until the edges stop changing: every node hands its larger neighbours to
its smallest one, then its smaller neighbours and itself to the smallest of them. The edge count never
grows, and a chain of n links takes about log(n) rounds. A hub's rows meet only in joins, which Spark can
split, and in partially aggregated minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle


def _tidy(edges: DataFrame) -> DataFrame:
    """Edges as (u, v) with u > v, once each."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _tidy(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return _tidy(e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))))


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return row[0], row[1]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge to another node: root is the smallest node that it can reach.

    edges: columns u and v of one ordered type, without nulls; repeated and self-linked rows do no harm.
    """
    e = settle(_tidy(edges.select("u", "v")))
    mark = _mark(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        e = settle(_small(_large(e)))
        before, mark = mark, _mark(e)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
