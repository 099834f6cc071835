"""Operators beyond what the oracle queries cover: skew, padding and ends of ranges."""

from pyspark.sql import functions as F

from tessera.functions import nested, numbers, text
from tessera.operators import joins, rows


def test_asof_join_against_a_plain_loop(spark):
    import random

    r = random.Random(4)
    left = [(i, r.choice("aab"), r.randrange(1000)) for i in range(300)]
    right = [(r.choice("aab"), r.randrange(-50, 1000), i) for i in range(120)]
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, u int, v int")
    for strict in (False, True):
        got = {x.id: x.u for x in joins.asof_join(a, b, "t", "u", ["k"], strict=strict, slices=7).collect()}
        for i, k, t in left:
            fit = [u for k2, u, _ in right if k2 == k and (u < t if strict else u <= t)]
            assert got[i] == (max(fit) if fit else None)


def test_overlap_join_has_each_pair_once(spark):
    a = [(i, i * 3.0, i * 3.0 + 10) for i in range(40)]
    b = [(i, i * 7.0, i * 7.0 + 4) for i in range(20)]
    out = joins.overlap_join(spark.createDataFrame(a, "a int, x double, y double"), spark.createDataFrame(b, "b int, u double, w double"), "x", "y", "u", "w", 5.0)
    got = sorted((r.a, r.b) for r in out.collect())
    assert got == sorted((i, j) for i, x, y in a for j, u, w in b if x <= w and u <= y)


def test_positions(spark):
    a = spark.range(10, numPartitions=3)
    assert [(r.id, r.row_index) for r in rows.with_row_index(a).orderBy("id").collect()] == [(i, i) for i in range(10)]
    b = joins.positional_join(spark.range(3).toDF("a"), spark.range(5).toDF("b")).collect()
    assert [(r.a, r.b) for r in b] == [(0, 0), (1, 1), (2, 2), (None, 3), (None, 4)]


def test_compare_all_with_nulls_and_empty(spark):
    df, some, none = spark.createDataFrame([(1,), (5,), (None,)], "x int"), spark.createDataFrame([(2,), (None,)], "y int"), spark.createDataFrame([], "y int")
    result = lambda o, op, q: [r.result for r in joins.compare_all(df, F.col("x"), o, "y", op, q).orderBy(F.col("x").asc_nulls_last()).collect()]
    assert result(some, "<", "any") == [True, None, None] and result(some, ">", "all") == [False, None, None]
    assert result(none, "<", "any") == [False] * 3 and result(none, "<", "all") == [True] * 3
    assert result(some, "=", "any") == [None, None, None]


def test_functions_outside_the_oracle(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(text.bar(F.lit(5), 0, 10, 10)) == "█████     " and get(text.regexp_replace(F.lit("aXbX"), "x", "-", "i")) == "a-bX"
    assert get(text.md5_number(F.lit("a"), "upper")) is not None and get(text.gamma(F.lit(5.0))) == 24.0
    assert get(numbers.divide(F.lit(-1), F.lit(0))) == float("-inf") and str(get(numbers.factorial(F.lit(30)))) == "265252859812191058636308480000000"
    assert get(nested.list_slice(F.array(*map(F.lit, range(6))), 2, -2, 2)) == [1, 3] and get(nested.list_slice(F.array(*map(F.lit, range(4))), None, None, -1)) == [3, 2, 1, 0]
    assert get(nested.enum_range(["a", "b", "c"], "b")) == ["b", "c"] and get(nested.list_distinct(F.array(F.lit(1), F.lit(None), F.lit(1)))) == [1]


def test_samples_and_limits(spark):
    df = spark.range(1000)
    assert rows.reservoir_sample(df, 50, 3).count() == 50 and rows.limit_percent(df, 12.5).count() == 125
    assert 300 < rows.bernoulli_sample(df, 50, 1).count() < 700 and rows.repeat_row(spark, 4, a=1).count() == 4
