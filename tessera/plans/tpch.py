"""Decision-support queries over the star schema, in the DataFrame API."""

from pyspark.sql import functions as F

from tessera.catalogue import query, table

def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def day(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def q1_pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("count_order"))


@query("""SELECT o.o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o.o_orderdate
FROM customer JOIN orders o ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15' AND l_shipdate > TIMESTAMP '1996-03-15'
GROUP BY o.o_orderkey, o.o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def q3_shipping_priority(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < day("1996-03-15"))
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > day("1996-03-15"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey, "left_semi")
    return joined.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(revenue()), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
GROUP BY o_orderpriority""")
def q4_order_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= day("1996-01-01")) & (F.col("o_orderdate") < day("1997-01-01")))
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("order_count"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
GROUP BY n_name""")
def q5_local_supplier(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    n = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    li = t("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = li.join(t("customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return both.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"))


@query("""SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""")
def q6_forecast_revenue(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1997-01-01")) & F.col("l_discount").between(0.03, 0.07) & (F.col("l_quantity") < 24))
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("""SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""")
def q10_returned_items(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    spent = t("lineitem").where("l_returnflag = 'R'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(F.sum(revenue()), 2).alias("revenue"))
    return spent.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name").orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("""SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) GROUP BY c_count""")
def q13_customer_distribution(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.groupBy(F.coalesce("n", F.lit(0)).alias("c_count")).agg(F.count("*").alias("custdist"))


@query("""SELECT round(100.0 * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_share FROM lineitem JOIN part ON l_partkey = p_partkey""")
def q14_promotion_effect(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.agg(F.round(100 * F.sum(F.when(F.col("p_type") == "PROMO", revenue()).otherwise(0.0)) / F.sum(revenue()), 6).alias("promo_share"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) GROUP BY ALL""")
def q18_large_orders(spark, sf_dir):
    # The join repeats the grouping of the subquery, so one aggregation serves for both.
    big = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity")).where("quantity > 250")
    return big.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice", "quantity")
