"""Joins by order, position and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.rows import with_row_index


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] = [], how: str = "left", strict: bool = False, slices: int = 64) -> DataFrame:  # noqa: B006
    """Each left row with the right row of equal `by` that has the greatest right_on <= left_on (< with strict).

    The time range is cut into slices, so that a key with very many rows is spread over many tasks: a window finds
    the match inside a slice, and only the last right row of each key and slice is carried to later ones. how: left
    or inner. Rows with a null in by or in the order column match nothing. Right columns named as left ones are dropped.
    """
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") if "timestamp" in dict(left.dtypes)[left_on] or dict(left.dtypes)[left_on] == "date" else F.col(c).cast("double")
    low, high = left.agg(F.min(t(left_on)), F.max(t(left_on))).first()
    width = max((high - low) / slices, 1e-9) if low is not None else 1.0
    cut = lambda c: F.greatest(F.lit(-1), F.least(F.lit(slices), F.floor((t(c) - F.lit(low or 0.0)) / width))).cast("int")
    keep = [c for c in right.columns if c not in left.columns]
    match_row = F.struct(*(F.col(c) for c in (keep or [right_on])))
    one = left.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), F.col(left_on).alias("at"), cut(left_on).alias("slice"), F.lit(0 if strict else 1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.select(match_row.alias("m")).schema["m"].dataType).alias("match"))
    two = right.where(F.col(right_on).isNotNull()).select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), F.col(right_on).alias("at"), cut(right_on).alias("slice"), F.lit(1 if strict else 0).alias("side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("row"), match_row.alias("match"))
    keys = [f"k{i}" for i in range(len(by))]
    for k in keys:
        two = two.where(F.col(k).isNotNull())
    both = one.unionByName(two)
    inside = F.last("match", ignorenulls=True).over(W.partitionBy(*keys, "slice").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("inside", inside).where("row is not null")
    ends = two.groupBy(*keys, "slice").agg(F.max_by("match", "at").alias("end"))
    marks = ends.unionByName(one.where("at is not null").select(*keys, "slice").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))).groupBy(*keys, "slice").agg(F.first("end", ignorenulls=True).alias("end"))
    carried = marks.withColumn("carried", F.last("end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1))).select(*(F.col(k).alias(f"c{k}") for k in keys), F.col("slice").alias("cslice"), "carried")
    on = [F.col("slice") == F.col("cslice"), *(F.col(k) == F.col(f"c{k}") for k in keys)]
    out = found.join(carried, on, "left").withColumn("m", F.when(F.col("at").isNotNull(), F.coalesce("inside", "carried")))
    if how == "inner":
        out = out.where("m is not null")
    return out.select("row.*", *(F.col(f"m.{c}").alias(c) for c in keep))


def positional_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows paired by position; the shorter side is padded with nulls."""
    a, b = with_row_index(left, "__i"), with_row_index(right, "__j")
    return a.join(b, F.col("__i") == F.col("__j"), "full").orderBy(F.coalesce("__i", "__j")).drop("__i", "__j")


def overlap_join(left: DataFrame, right: DataFrame, left_from: str, left_to: str, right_from: str, right_to: str, width: float, on: Column | None = None) -> DataFrame:
    """Pairs whose closed intervals overlap: left_from <= right_to and right_from <= left_to.

    Intervals are dealt to every bin of the given width that they touch and meet in an equality join; a pair is kept
    in the first bin that both touch, so no pair appears twice and no two sides are compared row by row. Choose a
    width near the usual interval length. Columns are numbers.
    """
    bins = lambda lo, hi: F.explode(F.when((F.col(lo) <= F.col(hi)) & F.col(lo).isNotNull(), F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    a, b = left.withColumn("__bin", bins(left_from, left_to)), right.withColumn("__bin2", bins(right_from, right_to))
    first = F.greatest(F.floor(F.col(left_from) / width), F.floor(F.col(right_from) / width))
    both = (F.col("__bin") == F.col("__bin2")) & (F.col("__bin") == first) & (F.col(left_from) <= F.col(right_to)) & (F.col(right_from) <= F.col(left_to))
    return a.join(b, both & on if on is not None else both).drop("__bin", "__bin2")


def compare_all(df: DataFrame, value: Column, other: DataFrame, column: str, op: str, quantifier: str) -> DataFrame:
    """df with `result` = value op ANY/ALL (select column from other), in three-valued logic; op is one of < <= > >= =.

    One row of bounds stands for the whole set, so nothing is paired up.
    """
    s = other.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"), F.count("*").alias("__n"), F.count(F.when(F.col(column).isNull(), 1)).alias("__nulls"))
    lo, hi = F.col("__lo"), F.col("__hi")
    test = {"<": lambda b: value < b, "<=": lambda b: value <= b, ">": lambda b: value > b, ">=": lambda b: value >= b}
    if op == "=":
        hit = other.select(F.col(column).alias("__v")).distinct()
        mark = df.join(F.broadcast(s), F.lit(True)).join(hit.withColumn("__hit", F.lit(True)), value == F.col("__v"), "left")
        any_ = F.when(F.col("__n") == 0, False).when(F.col("__hit"), True).when(value.isNull() | (F.col("__nulls") > 0), None).otherwise(False)
        all_ = F.when(F.col("__n") == 0, True).when((lo != hi) | (value != lo), False).when(value.isNull() | (F.col("__nulls") > 0), None).otherwise(True)
        return mark.withColumn("result", any_ if quantifier == "any" else all_).drop("__lo", "__hi", "__n", "__nulls", "__v", "__hit")
    best, worst = (hi, lo) if op[0] == "<" else (lo, hi)
    if quantifier == "any":
        out = F.when(F.col("__n") == 0, False).when(test[op](best), True).when(value.isNull() | (F.col("__nulls") > 0), None).otherwise(False)
    else:
        out = F.when(F.col("__n") == 0, True).when(~test[op](worst), False).when(value.isNull() | (F.col("__nulls") > 0), None).otherwise(True)
    return df.join(F.broadcast(s), F.lit(True)).withColumn("result", out).drop("__lo", "__hi", "__n", "__nulls")
