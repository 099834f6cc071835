"""Window forms beyond Spark's own: GROUPS frames, EXCLUDE, DISTINCT and FILTER."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: str, before: int, after: int, **aggregates: Column) -> DataFrame:
    """Aggregates over GROUPS BETWEEN before PRECEDING AND after FOLLOWING: peers are numbered densely, then framed by RANGE."""
    ranked = df.withColumn("__peer", F.dense_rank().over(W.partitionBy(*partition).orderBy(order)))
    frame = W.partitionBy(*partition).orderBy("__peer").rangeBetween(-before, after)
    return ranked.withColumns({k: v.over(frame) for k, v in aggregates.items()}).drop("__peer")


def filtered(value: Column, condition: Column) -> Column:
    """The value where the condition holds: what FILTER hands to an aggregate that skips nulls."""
    return F.when(condition, value)


def count_distinct_over(value: Column, window) -> Column:
    """count(DISTINCT value) OVER window."""
    return F.size(F.collect_set(value).over(window)).cast("bigint")


def sum_excluding_current(value: Column, window) -> Column:
    """sum(value) OVER (window EXCLUDE CURRENT ROW), null where no other row counts."""
    others = F.count(value).over(window) - F.when(value.isNotNull(), 1).otherwise(0)
    return F.when(others > 0, F.sum(value).over(window) - F.coalesce(value, F.lit(0)))


def sum_excluding_ties(value: Column, partition: list[str], order: str, window) -> Column:
    """sum(value) OVER (window EXCLUDE TIES) for a window that holds all peers of the current row."""
    peers = W.partitionBy(*partition, order)
    left = F.count(value).over(window) - F.count(value).over(peers) + F.when(value.isNotNull(), 1).otherwise(0)
    return F.when(left > 0, F.sum(value).over(window) - F.coalesce(F.sum(value).over(peers), F.lit(0)) + F.coalesce(value, F.lit(0)))


def sum_excluding_group(value: Column, partition: list[str], order: str, window) -> Column:
    """sum(value) OVER (window EXCLUDE GROUP) for a window that holds all peers of the current row."""
    peers = W.partitionBy(*partition, order)
    return F.when(F.count(value).over(window) > F.count(value).over(peers), F.sum(value).over(window) - F.coalesce(F.sum(value).over(peers), F.lit(0)))
