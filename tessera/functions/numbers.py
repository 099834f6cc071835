"""Numeric functions and operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def divide(a: Column, b: Column) -> Column:
    """a / b in double precision; division by zero follows IEEE."""
    x, y = a.cast("double"), b.cast("double")
    zero = F.when(x > 0, INF).when(x < 0, -INF).when(x.isNotNull(), float("nan"))
    return F.when(y == 0, zero).otherwise(x / F.nullif(y, F.lit(0.0)))


def integer_divide(a: Column, b: Column) -> Column:
    """a // b, truncating; null for b = 0. Integers are divided as such, as a double holds them up to 2^53 only."""
    b = F.nullif(b, F.lit(0))
    q = a / b
    whole = F.typeof(a).isin(*INTEGERS) & F.typeof(b).isin(*INTEGERS)
    return F.when(whole, F.call_function("div", a.cast("bigint"), b.cast("bigint"))).when(q < 0, F.ceil(q).cast("bigint")).otherwise(F.floor(q).cast("bigint"))


def modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def even(x: Column) -> Column:
    """Rounded away from zero to an even number."""
    return F.signum(x) * 2 * F.ceil(F.abs(x) / 2)


def fdiv(x: Column, y: Column) -> Column:
    return F.floor(x / y).cast("double")


def fmod(x: Column, y: Column) -> Column:
    return x - y * F.floor(x / y)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == INF


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, enough for 64-bit numbers, folded over a short fixed sequence."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0)).otherwise(F.try_mod(s["x"], s["y"])).cast("bigint").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"]


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0)).otherwise(F.call_function("div", F.abs(a.cast("bigint")), g) * F.abs(b)).cast("bigint")


def factorial(n: Column) -> Column:
    """n! up to 33 as a decimal of 38 digits."""
    one = F.lit(1).cast("decimal(38,0)")
    whole = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one, lambda s, i: (s * i).cast("decimal(38,0)"))
    return F.when(n >= 0, whole)


def equi_width_bins(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * i / bins for i in range(1, bins + 1)]


@F.pandas_udf(T.DoubleType())
def nextafter(x: pd.Series, toward: pd.Series) -> pd.Series:
    """The double next to x on the way to another."""
    return pd.Series(np.nextafter(x.astype("float64"), toward.astype("float64")))
