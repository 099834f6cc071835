"""Aggregates as Column expressions; those that need two levels are functions of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kurtosis_sample(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def skewness_sample(x: Column) -> Column:
    """Bias-corrected skewness; null for fewer than three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sem(x: Column) -> Column:
    return F.stddev_pop(x) / F.sqrt(F.count(x))


def geomean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))


def weighted_avg(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def list_agg(x: Column) -> Column:
    """All values, nulls too."""
    return F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"])


def list_ordered(x: Column, *keys: Column) -> Column:
    """All values, nulls too, in ascending order of the keys."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), x.alias("x")))), lambda s: s["x"])


def string_agg(x: Column, sep: str, *keys: Column) -> Column:
    return F.array_join(list_ordered(x.cast("string"), *keys), sep)


def top_n(x: Column, n: int, largest: bool = True) -> Column:
    """max(x, n) or min(x, n): at most n values, best first, kept by merging bounded lists."""
    ordered = F.sort_array(F.collect_list(x), asc=not largest)
    return F.slice(ordered, 1, n)


def arg_top_n(arg: Column, value: Column, n: int, largest: bool = True) -> Column:
    """arg_max(arg, value, n) or arg_min."""
    pairs = F.filter(F.collect_list(F.struct(value.alias("v"), arg.alias("a"))), lambda p: p["v"].isNotNull() & p["a"].isNotNull())
    return F.transform(F.slice(F.sort_array(pairs, asc=not largest), 1, n), lambda p: p["a"])


def arg_min_null(arg: Column, value: Column) -> Column:
    return F.min_by(F.struct(arg.alias("a")), value)["a"]


def arg_max_null(arg: Column, value: Column) -> Column:
    return F.max_by(F.struct(arg.alias("a")), value)["a"]


def quantile_disc(x: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) within group (order by {x})")


def quantile_cont(x: str, p: float) -> Column:
    return F.expr(f"percentile_cont({p}) within group (order by {x})")


def counted(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """One row for each group and value: pre-aggregated input of the two-level aggregates below."""
    return df.where(F.col(x).isNotNull()).groupBy(*group, x).agg(F.count("*").alias("__n"))


def entropy(df: DataFrame, group: list[str], x: str, name: str = "entropy") -> DataFrame:
    """log2 entropy of the value counts of each group, in one level above the counts: log2(N) - sum(n log2 n) / N."""
    n, all_ = F.col("__n"), F.sum("__n")
    return counted(df, group, x).groupBy(*group).agg((F.log2(all_) - F.sum(n * F.log2(n)) / all_).alias(name))


def mode(df: DataFrame, group: list[str], x: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group; the smallest among ties."""
    return counted(df, group, x).groupBy(*group).agg(F.min_by(x, F.struct(-F.col("__n"), F.col(x))).alias(name))


def histogram(df: DataFrame, group: list[str], x: str, name: str = "histogram") -> DataFrame:
    """A map of value to count for each group, keys in order."""
    return counted(df, group, x).groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(x, "__n")))).alias(name))


def histogram_bins(x: Column, bounds: list) -> Column:
    """Counts of values up to each bound and above the one before; the last entry counts the rest."""
    cells = [F.count_if((x <= b) & ((x > a) if a is not None else F.lit(True))) for a, b in zip([None, *bounds[:-1]], bounds, strict=True)]
    return F.array(*cells, F.count_if(x > bounds[-1]))


def mad(df: DataFrame, group: list[str], x: str, name: str = "mad") -> DataFrame:
    """Median absolute deviation: the medians are joined back, then a second median is taken."""
    centre = df.groupBy(*group).agg(F.median(x).alias("__m"))
    return df.join(centre, group).groupBy(*group).agg(F.median(F.abs(F.col(x) - F.col("__m"))).alias(name))


def bitstring(x: Column, low: int, high: int) -> Column:
    """bitstring_agg: a string of high - low + 1 digits, 1 where the value occurs."""
    seen = F.collect_set(x)
    return F.array_join(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.when(F.array_contains(seen, i.cast("bigint")), "1").otherwise("0")), "")
