"""Row positions, lineage cuts and samples."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """The frame written to the session's shared checkpoint folder (spark.checkpoint.dir; a temporary one only where unset) and cut from its lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint(eager=True)


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """df with consecutive row numbers from 0 in its own order.

    Two passes: rows are counted by partition, then every partition adds the sum of those before it. The frame is
    settled first, so both passes see the same partitions; only one count per partition reaches the driver.
    """
    fixed = settle(df)
    part = F.spark_partition_id()
    counts = sorted(tuple(r) for r in fixed.groupBy(part.alias("p")).count().collect())
    bases, total = [], 0
    for p, n in counts:
        bases.append((p, total))
        total += n
    base = df.sparkSession.createDataFrame(bases, "__p int, __base bigint")
    marked = fixed.withColumn("__p", part).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return marked.join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + F.col("__at")).drop("__p", "__base", "__at")


def limit_percent(df: DataFrame, percent: float, *order) -> DataFrame:
    """The first percent of df's rows, rounded down."""
    rows = int(df.count() * percent / 100)
    return (df.orderBy(*order) if order else df).limit(rows)


def reservoir_sample(df: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """Exactly min(rows, all) rows: those with the smallest seeded random numbers, kept by bounded heaps."""
    return df.withColumn("__draw", F.rand(seed)).orderBy("__draw").limit(rows).drop("__draw")


def bernoulli_sample(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    return df.sample(fraction=percent / 100, seed=seed)


def repeat_row(spark: SparkSession, rows: int, **values) -> DataFrame:
    return spark.range(rows).select(*(F.lit(v).alias(k) for k, v in values.items()))


def distinct_on(df: DataFrame, keys: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """The first row of each key under order, a list of (column, ascending) with nulls last.

    With one direction and no nulls in order this is a partially aggregated minimum; ties fall to the smallest row.
    """
    cols = df.columns
    ranked = W.partitionBy(*keys).orderBy(*((F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last()) for c, up in order), *(F.col(c).asc_nulls_last() for c in cols))
    if all(up for _, up in order):
        best = F.min(F.struct(*(x for c, _ in order for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c).alias(f"o_{c}"))), F.struct(*cols).alias("row")))
        return df.groupBy(*keys).agg(best.alias("__best")).select("__best.row.*")
    return df.withColumn("__rank", F.row_number().over(ranked)).where("__rank = 1").drop("__rank")


def qualify(df: DataFrame, predicate, **windows) -> DataFrame:
    """Rows of df for which the predicate holds over the named window expressions, which are then dropped."""
    return df.withColumns({f"__{k}": v for k, v in windows.items()}).where(predicate(*(F.col(f"__{k}") for k in windows))).drop(*(f"__{k}" for k in windows))


def recursive(base: DataFrame, step, distinct: bool = True, rounds: int = 1000) -> DataFrame:
    """A recursive query: step maps the rows of the last round to new ones; with distinct, rows already seen are not followed again."""
    whole = settle(base.distinct() if distinct else base)
    last = whole
    for _ in range(rounds):
        fresh = step(last)
        if distinct:
            fresh = fresh.distinct().join(whole, on=[F.lit(True), *(fresh[c].eqNullSafe(whole[c]) for c in whole.columns)], how="left_anti")
        last = settle(fresh)
        if last.isEmpty():
            return whole
        whole = settle(whole.unionAll(last))
    raise RuntimeError(f"the recursion did not end in {rounds} rounds")
