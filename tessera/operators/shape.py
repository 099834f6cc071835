"""Column lists, pivots and set operations by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star(df: DataFrame, exclude: list[str] = [], replace: dict[str, Column] = {}, rename: dict[str, str] = {}, like: str | None = None) -> DataFrame:  # noqa: B006
    """SELECT * with EXCLUDE, REPLACE, RENAME and LIKE."""
    missing = [c for c in [*exclude, *replace, *rename] if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    names = [c for c in df.columns if c not in exclude]
    if like is not None:
        pattern = re.compile("".join({"%": ".*", "_": "."}.get(x, re.escape(x)) for x in like), re.S)
        names = [c for c in names if pattern.fullmatch(c)]
    return df.select(*(replace.get(c, F.col(c)).alias(rename.get(c, c)) for c in names))


def columns(df: DataFrame, which: str | Callable[[str], bool], apply: Callable[[Column], Column] = lambda c: c) -> list[Column]:
    """COLUMNS(regex or lambda): one expression for each column that it picks, under that column's name."""
    pick = which if callable(which) else lambda c: re.search(which, c) is not None
    return [apply(F.col(c)).alias(c) for c in df.columns if pick(c)]


def pivot(df: DataFrame, on: str, using: dict[str, Column], group: list[str], values: list | None = None) -> DataFrame:
    """Rows to columns; without values the distinct ones are asked for first, so that one aggregation follows instead of two jobs over all columns."""
    if values is None:
        values = sorted((r[0] for r in df.select(on).where(F.col(on).isNotNull()).distinct().collect()), key=lambda v: (str(type(v)), v))
    out = df.groupBy(*group).pivot(on, values).agg(*(c.alias(n) for n, c in using.items()))
    return out if len(using) > 1 else out


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value", include_nulls: bool = False) -> DataFrame:
    """Columns to rows, in one pass."""
    out = df.unpivot(ids, columns, name, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())


def union_by_name(a: DataFrame, b: DataFrame, all: bool = True) -> DataFrame:
    out = a.unionByName(b, allowMissingColumns=True)
    return out if all else out.distinct()
