"""Lists, maps, structs, tagged unions and enums. List positions count from 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_extract(l: Column, i: int) -> Column:
    return F.try_element_at(l, F.lit(i)) if i else F.try_element_at(l, F.lit(1 << 30))


def list_slice(l: Column, a: int | None, z: int | None, step: int = 1) -> Column:
    """l[a:z:step], ends included, negative positions from the end."""
    n = F.size(l)
    at = lambda i, default: F.lit(default) if i is None else (F.lit(i) if i >= 0 else n + i + 1)
    lo, hi = F.greatest(at(a, 1), F.lit(1)), F.least(at(z, 1 << 30), n)
    if step < 0:
        return F.reverse(F.filter(l, lambda _, i: (i + 1 >= lo) & (i + 1 <= hi) & ((hi - i - 1) % -step == 0)))
    return F.filter(l, lambda _, i: (i + 1 >= lo) & (i + 1 <= hi) & ((i + 1 - lo) % step == 0))


def list_concat(a: Column, b: Column) -> Column:
    """A null list counts as empty."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def list_position(l: Column, x) -> Column:
    return F.nullif(F.array_position(l, x), F.lit(0)).cast("int")


def list_has_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def list_distinct(l: Column) -> Column:
    return F.array_distinct(F.array_compact(l))


def list_unique(l: Column) -> Column:
    return F.size(list_distinct(l)).cast("bigint")


def list_sort(l: Column, descending: bool = False, nulls_first: bool = False) -> Column:
    some = F.sort_array(F.array_compact(l), asc=not descending)
    nulls = F.filter(l, lambda x: x.isNull())
    return F.concat(nulls, some) if nulls_first else F.concat(some, nulls)


def list_grade_up(l: Column) -> Column:
    return F.transform(F.array_sort(F.transform(l, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))), lambda s: s["i"].cast("bigint"))


def list_resize(l: Column, n: int, value=None) -> Column:
    return F.slice(F.concat(l, F.array_repeat(F.lit(value), n)), 1, n)


def list_select(l: Column, positions: Column) -> Column:
    return F.transform(positions, lambda i: F.try_element_at(l, i))


def list_where(l: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(l.alias("l"), mask.alias("m")), lambda z: z["m"]), lambda z: z["l"])


def list_reduce(l: Column, f: Callable[[Column, Column], Column]) -> Column:
    """The first element is the start."""
    return F.when(F.size(l) > 0, F.reduce(F.slice(l, 2, F.greatest(F.size(l), F.lit(1))), F.try_element_at(l, F.lit(1)), f))


def list_sum(l: Column) -> Column:
    return F.aggregate(F.array_compact(l), F.lit(0.0), lambda s, x: s + x)


def list_avg(l: Column) -> Column:
    some = F.array_compact(l)
    return F.when(F.size(some) > 0, list_sum(l) / F.size(some))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def cosine_similarity(a: Column, b: Column) -> Column:
    return inner_product(a, b) / F.sqrt(inner_product(a, a) * inner_product(b, b))


def cross_product(a: Column, b: Column) -> Column:
    return F.array(*(a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))))


def map_extract(m: Column, key) -> Column:
    """A list of the value, or an empty one."""
    return F.when(F.map_contains_key(m, key), F.array(F.try_element_at(m, F.lit(key)))).otherwise(F.array())


def struct_insert(s: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        s = s.withField(name, value)
    return s


def union_value(members: dict[str, str], tag: str, value: Column) -> Column:
    """A tagged union as a struct: the tag, then one nullable field for each member type."""
    return F.struct(F.lit(tag).alias("tag"), *((value if m == tag else F.lit(None)).cast(kind).alias(m) for m, kind in members.items()))


def enum_code(labels: list[str], x: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, labels)), x) - 1).cast("int")


def enum_range(labels: list[str], first: str | None = None, last: str | None = None) -> Column:
    a, z = labels.index(first) if first else 0, labels.index(last) + 1 if last else len(labels)
    return F.array(*map(F.lit, labels[a:z]))


def generate_series(a, z, step=None) -> Column:
    return F.sequence(a, z, step) if step is not None else F.sequence(a, z)


def range_list(a: int, z: int, step: int = 1) -> Column:
    """The end is not included."""
    return F.array(*(F.lit(i) for i in range(a, z, step))) if abs(z - a) <= 100 else F.sequence(F.lit(a), F.lit(a + ((z - a - 1) // step) * step), F.lit(step))
