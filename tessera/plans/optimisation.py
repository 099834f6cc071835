"""Queries of the constrained optimisation operator; SQL stands beside those whose answer SQL can find."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalogue import query, table
from tessera.decide import decide


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC) <= 100 AS INT) AS keep FROM orders")
def decide_cardinality(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return decide(o, "DECIDE keep(BOOL) SUCH THAT SUM(keep) <= 100 MAXIMIZE SUM(keep * o_totalprice)").select("o_orderkey", "keep")


@query("SELECT l_orderkey, round(max(l_extendedprice), 2) AS kept_price, 1::BIGINT AS kept FROM lineitem GROUP BY l_orderkey")
def decide_per_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = decide(li, "DECIDE keep(BOOL) SUCH THAT SUM(keep) = 1 PER l_orderkey MAXIMIZE SUM(l_extendedprice * keep)")
    return out.groupBy("l_orderkey").agg(F.round(F.sum(F.col("keep") * F.col("l_extendedprice")), 2).alias("kept_price"), F.sum("keep").alias("kept"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS amount FROM lineitem")
def decide_bounded_lp(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return decide(li, "DECIDE amount(REAL) SUCH THAT amount <= l_quantity MAXIMIZE SUM(l_extendedprice * amount)").select("l_orderkey", "l_linenumber", "amount")


@query("SELECT l_orderkey, l_linenumber, least(30, l_quantity) AS amount FROM lineitem")
def decide_separable_qp(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return decide(li, "DECIDE amount(REAL) SUCH THAT amount <= 30 MINIMIZE SUM(POWER(amount - l_quantity, 2))").select("l_orderkey", "l_linenumber", F.round("amount", 6).alias("amount"))


def _budget(df, column: str) -> float:
    return float(df.agg(F.round(F.sum(column) / 2, 0)).first()[0])


def _sum(column: str):
    """The sum of a double column in two parts: multiples of 2^-20, which add up exactly below 2^33, and the small rests."""
    x, step = F.col(column), float(1 << 20)
    most = F.rint(x * step) / step
    return F.sum(most) + F.sum(x - most)


@query("SELECT round(least(sum(least(30, l_quantity)), round(sum(l_quantity) / 2, 0)), 3) AS total FROM lineitem")
def decide_coupled_qp(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity")
    q = f"DECIDE amount(REAL) SUCH THAT amount <= 30 AND SUM(amount) <= {_budget(li, 'l_quantity')} MINIMIZE SUM(POWER(amount - l_quantity, 2))"
    return decide(li, q).agg(F.round(_sum("amount"), 3).alias("total"))


@query("""WITH t AS (SELECT o_totalprice AS p, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders WHERE o_totalprice > 0), b AS (SELECT round(sum(o_totalprice) / 2, 0) AS cap FROM orders),
c AS (SELECT p, sum(p * 1.0) OVER (ORDER BY r) AS s, cap FROM t, b) SELECT round(sum(CASE WHEN s <= cap THEN 1.0 WHEN s - p < cap THEN (cap - (s - p)) / p ELSE 0 END), 4) AS total FROM c""")
def decide_allocation_lp(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    q = f"DECIDE part(REAL) SUCH THAT part <= 1 AND SUM(part * o_totalprice) <= {_budget(o, 'o_totalprice')} MAXIMIZE SUM(part)"
    return decide(o, q).agg(F.round(_sum("part"), 4).alias("total"))


@query("""WITH t AS (SELECT p_size AS w, p_retailprice AS v, p_partkey FROM part), s AS (SELECT *, sum(w) OVER (ORDER BY v / w DESC, p_partkey) AS used FROM t)
SELECT true AS fits, true AS close, (SELECT count(*) FROM part) AS rows FROM s WHERE used - w < 500 AND used >= 500""")
def decide_knapsack(spark, sf_dir):
    """The choice fits, and its value lies between the relaxation in which one part may be divided, less the dearest part, and that relaxation, as the best choice's does."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    out = decide(p, "DECIDE keep(BOOL) SUCH THAT SUM(keep * p_size) <= 500 MAXIMIZE SUM(keep * p_retailprice)")
    line = W.orderBy(F.desc(F.col("p_retailprice") / F.col("p_size")), "p_partkey")
    part = F.least(F.greatest((500 - (F.sum("p_size").over(line) - F.col("p_size"))) / F.col("p_size"), F.lit(0)), F.lit(1))
    most = out.withColumn("part", part).agg(F.sum(F.col("part") * F.col("p_retailprice")).alias("most"), F.sum(F.col("keep") * F.col("p_retailprice")).alias("value"), F.sum(F.col("keep") * F.col("p_size")).alias("size"), F.max("p_retailprice").alias("dearest"), F.count("*").alias("rows"))
    return most.select((F.col("size") <= 500).alias("fits"), F.col("value").between(F.col("most") - F.col("dearest"), F.col("most") + 1e-6).alias("close"), "rows")


@query("SELECT o_orderpriority, true AS fits, count(*) AS rows FROM orders GROUP BY o_orderpriority")
def decide_selection(spark, sf_dir):
    """Several limits at once over all rows: overall, under a condition, and by group; whether each group's choice fits."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    n, p = o.agg(F.count("*"), F.sum("o_totalprice")).first()
    out = decide(o, f"""DECIDE ship(BOOL) SUCH THAT SUM(ship * o_totalprice) <= {0.3 * p} AND SUM(ship) <= {n // 20} PER o_orderpriority
        AND SUM(ship * o_totalprice) <= {0.04 * p} WHEN o_orderstatus = 'F' MAXIMIZE SUM(ship * o_orderkey)""")
    by = out.groupBy("o_orderpriority").agg(F.sum("ship").alias("n"), F.count("*").alias("rows"), F.sum(F.col("ship") * F.col("o_totalprice")).alias("p"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("ship") * F.col("o_totalprice")).otherwise(0.0)).alias("f"))
    every = W.partitionBy(F.lit(0))
    return by.withColumns({"all_p": F.sum("p").over(every), "all_f": F.sum("f").over(every)}).select("o_orderpriority", ((F.col("n") <= n // 20) & (F.col("all_p") <= 0.3 * p) & (F.col("all_f") <= 0.04 * p)).alias("fits"), "rows")


@query("SELECT round(sum(abs(greatest(5, least(40, l_quantity)) - l_quantity)) + greatest(0, sum(greatest(5, least(40, l_quantity))) - 20 * count(*)), 2) AS cost FROM lineitem")
def decide_absolute_values(spark, sf_dir):
    """Stock levels between two bounds, as near to the quantities as a limit on their sum allows: what is over it costs its size."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity")
    out = decide(li, f"DECIDE level(REAL) SUCH THAT level BETWEEN 5 AND 40 AND SUM(level) <= {20 * li.count()} MINIMIZE SUM(ABS(level - l_quantity))")
    return out.agg(F.round(F.sum(F.abs(F.col("level") - F.col("l_quantity"))), 2).alias("cost"))


@query("SELECT round(greatest(0, 18 * count(*) - sum(0.5 * l_quantity)), 2) AS cost FROM lineitem")
def decide_norms(spark, sf_dir):
    """Amounts near half the quantities that reach a total: what is short of it costs its size."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity")
    out = decide(li, f"DECIDE fix(REAL) SUCH THAT fix BETWEEN 0 AND 30 AND SUM(fix) >= {18 * li.count()} MINIMIZE norm(fix - 0.5 * l_quantity, 1)")
    return out.agg(F.round(F.sum(F.abs(F.col("fix") - 0.5 * F.col("l_quantity"))), 2).alias("cost"))


@query("SELECT round(sum(40 + 0.01 * s_acctbal), 2) AS gain FROM (SELECT s_acctbal FROM supplier QUALIFY row_number() OVER (ORDER BY s_acctbal DESC) <= (SELECT count(*) // 4 FROM supplier))")
def decide_products(spark, sf_dir):
    """A choice and an amount for each supplier: the best quarter with the largest amount."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    out = decide(s, f"DECIDE open(BOOL), load(REAL) SUCH THAT load BETWEEN 0 AND 40 AND SUM(open) <= {s.count() // 4} MAXIMIZE SUM(open * load + 0.01 * open * s_acctbal)")
    return out.agg(F.round(F.sum(F.col("open") * F.col("load") + 0.01 * F.col("open") * F.col("s_acctbal")), 2).alias("gain"))


@query("SELECT round(sum(l_quantity) * sqrt(round(sum(l_quantity * l_quantity) / 2, 0) / sum(l_quantity * l_quantity)), 1) AS total FROM lineitem")
def decide_quadratic_limit(spark, sf_dir):
    """Amounts nearest to the quantities whose squares stay under a limit: all are scaled alike."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity")
    most = float(li.agg(F.round(F.sum(F.col("l_quantity") * F.col("l_quantity")) / 2, 0)).first()[0])
    out = decide(li, f"DECIDE qty(REAL) SUCH THAT qty BETWEEN 0 AND 60 AND SUM(POWER(qty, 2)) <= {most} MINIMIZE SUM(POWER(qty - l_quantity, 2))")
    return out.agg(F.round(F.sum("qty"), 1).alias("total"))
