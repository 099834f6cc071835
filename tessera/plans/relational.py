"""Queries for the relational operators: scans, joins, aggregation, windows, order, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalogue import query, same, table
from tessera.functions import aggregates as A
from tessera.operators import joins, rows, shape, windows

same("scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40 AND l_shipdate >= DATE '1997-01-01' AND l_returnflag IN ('A', 'R')")
same("dummy_scan", "SELECT 1 AS one, 'x' AS text")
same("empty_result", "SELECT n_name FROM nation WHERE 1 = 0")
same("values_scan", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (NULL, 'c')) AS t(x, y)")
same("from_first", "FROM region SELECT r_name", "FROM region SELECT r_name")
same("projection", "SELECT n_nationkey * 2 + 1 AS doubled, upper(n_name) AS name, n_regionkey = 1 AS is_one FROM nation")
same("predicates", """SELECT s_suppkey, s_acctbal BETWEEN 0 AND 5000 AS b, s_nationkey IN (1, 2, 3) AS i, s_nationkey NOT IN (1, 2) AS ni, s_name LIKE '%00%7' AS l, s_acctbal IS NOT NULL AS nn,
  nullif(s_nationkey, 5) IS NOT DISTINCT FROM NULL AS nd, coalesce(nullif(s_nationkey, 5), -1) AS c, CASE WHEN s_acctbal < 0 THEN 'neg' WHEN s_acctbal < 1000 THEN 'low' ELSE 'high' END AS k, (s_acctbal > 0) IS TRUE AS t FROM supplier""")
same("hash_join", "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
same("left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
same("right_join", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
same("full_join", "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a FULL OUTER JOIN supplier b ON a.n_nationkey = b.s_suppkey")
same("semi_join", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
same("anti_join", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
same("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same("natural_join", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT s_suppkey AS k, s_name AS b FROM supplier)")
same("using_join", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT s_suppkey AS k, s_name AS b FROM supplier) y USING (k)")
same("null_safe_join", "SELECT count(*) AS pairs FROM (SELECT nullif(n_regionkey, 2) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 2) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
same("inequality_join", "SELECT a.n_nationkey AS lo, b.n_nationkey AS hi FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
same("lateral_join", "SELECT n_name, s FROM nation, LATERAL (SELECT count(*) AS s FROM supplier WHERE s_nationkey = n_nationkey) t")
same("mark_join", "SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS rich FROM nation")
same("not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_nationkey < 5 AND s_nationkey <> 3)")


@query("""SELECT e.event_id, e.user_id, p.event_id AS purchase_id FROM events e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("purchase_id"))
    return joins.asof_join(e.select("event_id", "user_id", "ts"), bought, "ts", "p_ts", ["user_id"]).select("event_id", "user_id", "purchase_id")


@query("""SELECT e.event_id, p.event_id AS earlier FROM events e ASOF JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') p ON e.user_id = p.user_id AND e.ts > p.ts""")
def asof_join_strict(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bad = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("earlier"))
    return joins.asof_join(e.select("event_id", "user_id", "ts"), bad, "ts", "p_ts", ["user_id"], how="inner", strict=True).select("event_id", "earlier")


@query("""WITH t AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + value * 10 AS z FROM events WHERE event_type = 'purchase'), u AS (SELECT event_id AS id2, epoch_us(ts) / 1e6 AS a2, epoch_us(ts) / 1e6 + value * 5 AS z2 FROM events WHERE event_type = 'error')
SELECT id, id2 FROM t JOIN u ON a <= z2 AND a2 <= z""")
def interval_join(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events")
    t = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), at.alias("a"), (at + F.col("value") * 10).alias("z"))
    u = e.where("event_type = 'error'").select(F.col("event_id").alias("id2"), at.alias("a2"), (at + F.col("value") * 5).alias("z2"))
    return joins.overlap_join(t, u, "a", "z", "a2", "z2", 600.0).select("id", "id2")


@query("SELECT n_name, r_name FROM nation POSITIONAL JOIN region")
def positional_join(spark, sf_dir):
    return joins.positional_join(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"))


same("group_agg", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag")
same("ungrouped_agg", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem")
same("distinct_agg", "SELECT l_linestatus, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_linestatus")
same("filter_agg", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS big, sum(l_quantity) FILTER (WHERE l_discount = 0) AS full_price FROM lineitem GROUP BY l_linestatus")
same("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus)::INT AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
same("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
same("group_by_all", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL")
same("group_by_alias", "SELECT s_nationkey % 5 AS bucket, count(*) AS n FROM supplier GROUP BY bucket")
same("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
same("distinct_rows", "SELECT DISTINCT p_brand, p_size FROM part")
same("bool_bit_agg", "SELECT s_nationkey, bool_and(s_acctbal > 0) AS a, bool_or(s_acctbal < 0) AS o, bit_and(s_suppkey) AS ba, bit_or(s_suppkey) AS bo, bit_xor(s_suppkey) AS bx, count_if(s_acctbal > 5000)::BIGINT AS c FROM supplier GROUP BY s_nationkey")
same("arg_min_max", "SELECT s_nationkey, min_by(s_suppkey, s_acctbal) AS lo, max_by(s_suppkey, s_acctbal) AS hi FROM supplier GROUP BY s_nationkey")
same("stddev_var", "SELECT l_returnflag, round(stddev_pop(l_quantity), 8) AS sp, round(stddev_samp(l_quantity), 8) AS ss, round(var_pop(l_quantity), 8) AS vp, round(var_samp(l_quantity), 8) AS vs FROM lineitem GROUP BY l_returnflag")
same("corr_covar", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS c, round(covar_pop(l_quantity, l_discount), 8) AS cp, round(covar_samp(l_quantity, l_discount), 8) AS cs FROM lineitem GROUP BY l_returnflag")
same("regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS s, round(regr_intercept(l_extendedprice, l_quantity), 2) AS i, round(regr_r2(l_extendedprice, l_quantity), 8) AS r, regr_count(l_extendedprice, l_quantity)::BIGINT AS c, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 2) AS xx, round(regr_sxy(l_extendedprice, l_quantity), 0) AS xy FROM lineitem")
same("quantiles", "SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q1, median(l_extendedprice) AS m, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS q9 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, median(l_extendedprice) AS m, quantile_disc(l_quantity, 0.9) AS q9 FROM lineitem GROUP BY l_returnflag")


@query("SELECT l_linestatus, round(kurtosis(l_quantity), 8) AS k, round(kurtosis_pop(l_quantity), 8) AS kp, round(skewness(l_quantity), 8) AS s, round(sem(l_quantity), 8) AS e, round(geomean(l_quantity), 8) AS g, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS w FROM lineitem GROUP BY l_linestatus")
def shape_statistics(spark, sf_dir):
    x = F.col("l_quantity")
    out = {"k": A.kurtosis_sample(x), "kp": F.kurtosis(x), "s": A.skewness_sample(x), "e": A.sem(x), "g": A.geomean(x), "w": A.weighted_avg(F.col("l_discount"), x)}
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(*(F.round(v, 8).alias(k) for k, v in out.items()))


@query("SELECT l_linestatus, round(entropy(l_linenumber), 8) AS entropy FROM lineitem GROUP BY l_linestatus")
def entropy(spark, sf_dir):
    return A.entropy(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_linenumber").withColumn("entropy", F.round("entropy", 8))


@query("SELECT c_mktsegment, mad(c_acctbal) AS mad FROM customer GROUP BY c_mktsegment")
def mad(spark, sf_dir):
    return A.mad(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")


@query("SELECT p_brand, min(p_size) AS mode FROM (SELECT p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS r FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1 GROUP BY p_brand")
def mode(spark, sf_dir):
    return A.mode(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


@query("SELECT p_brand, array_to_string(list_transform(map_entries(histogram(p_type)), lambda e: e.key || '=' || e.value), ',') AS h FROM part GROUP BY p_brand")
def histogram(spark, sf_dir):
    h = A.histogram(table(spark, sf_dir, "part"), ["p_brand"], "p_type", "m")
    return h.select("p_brand", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("h"))


@query("SELECT count(*) FILTER (p_size <= 10) AS a, count(*) FILTER (p_size > 10 AND p_size <= 25) AS b, count(*) FILTER (p_size > 25) AS rest FROM part")
def histogram_bins(spark, sf_dir):
    h = table(spark, sf_dir, "part").agg(A.histogram_bins(F.col("p_size"), [10, 25]).alias("h"))
    return h.select(F.col("h")[0].alias("a"), F.col("h")[1].alias("b"), F.col("h")[2].alias("rest"))


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names, array_to_string(list(n_nationkey ORDER BY n_name), ',') AS keys FROM nation GROUP BY n_regionkey")
def ordered_aggregates(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    down = F.array_join(F.sort_array(F.collect_list("n_name"), asc=False), "|")
    return n.groupBy("n_regionkey").agg(down.alias("names"), F.array_join(F.transform(A.list_ordered(F.col("n_nationkey"), F.col("n_name")), lambda x: x.cast("string")), ",").alias("keys"))


@query("SELECT s_nationkey, array_to_string(max(s_acctbal, 3), ',') AS top, array_to_string(arg_min(s_suppkey, s_acctbal, 2), ',') AS poorest FROM supplier GROUP BY s_nationkey")
def top_n_aggregates(spark, sf_dir):
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(text(A.top_n(F.col("s_acctbal"), 3)).alias("top"), text(A.arg_top_n(F.col("s_suppkey"), F.col("s_acctbal"), 2, largest=False)).alias("poorest"))


@query("SELECT p_brand, bitstring_agg(p_size, 1, 50)::VARCHAR AS bits FROM part GROUP BY p_brand")
def bitstring_agg(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(A.bitstring(F.col("p_size").cast("bigint"), 1, 50).alias("bits"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey)")
def distinct_on(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rows.distinct_on(o, ["o_custkey"], [("o_totalprice", False), ("o_orderkey", True)])


@query("SELECT s_suppkey, s_nationkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) <= 2")
def qualify(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return rows.qualify(s, lambda r: r <= 2, r=F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal")))).select("s_suppkey", "s_nationkey")


same("window_rank", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w2 AS BIGINT) AS rk, CAST(dense_rank() OVER w2 AS BIGINT) AS dr, round(percent_rank() OVER w2, 8) AS pr, round(cume_dist() OVER w2, 8) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), w2 AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
same("window_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS c FROM orders")
same("window_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events")
same("lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after, first_value(event_id) OVER w AS first, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(event_id, 3) OVER w AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
same("ignore_nulls", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_buy FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_buy FROM events")


@query("SELECT s_suppkey, sum(s_suppkey) OVER (PARTITION BY s_nationkey % 3 ORDER BY s_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS s FROM supplier")
def window_groups(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("g", F.col("s_nationkey") % 3)
    return windows.groups_frame(s, ["g"], "s_nationkey", 1, 1, s=F.sum("s_suppkey")).select("s_suppkey", "s")


@query("""SELECT s_suppkey, sum(s_suppkey) OVER (PARTITION BY s_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)::BIGINT AS others,
  sum(s_suppkey) OVER (PARTITION BY s_nationkey % 3 ORDER BY s_nationkey RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP)::BIGINT AS no_group,
  sum(s_suppkey) OVER (PARTITION BY s_nationkey % 3 ORDER BY s_nationkey RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES)::BIGINT AS no_ties FROM supplier""")
def window_exclude(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("g", F.col("s_nationkey") % 3)
    x, all_ = F.col("s_suppkey"), W.partitionBy("g")
    return s.select("s_suppkey", windows.sum_excluding_current(x, W.partitionBy("s_nationkey")).alias("others"), windows.sum_excluding_group(x, ["g"], "s_nationkey", all_).alias("no_group"), windows.sum_excluding_ties(x, ["g"], "s_nationkey", all_).alias("no_ties"))


@query("SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS kinds, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id) AS clicks FROM events")
def window_distinct_filter(spark, sf_dir):
    w = W.partitionBy("user_id")
    return table(spark, sf_dir, "events").select("event_id", windows.count_distinct_over(F.col("event_type"), w).alias("kinds"), F.count(windows.filtered(F.lit(1), F.col("event_type") == "click")).over(w).alias("clicks"))


same("order_nulls", "SELECT k FROM (SELECT nullif(s_nationkey, 3) AS k, s_suppkey FROM supplier ORDER BY k DESC NULLS LAST, s_suppkey LIMIT 30) t")
same("topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
same("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")


@query("SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5%)")
def limit_percent(spark, sf_dir):
    return rows.limit_percent(table(spark, sf_dir, "part"), 5, F.desc("p_retailprice"), F.col("p_partkey")).select("p_partkey")


@query("SELECT count(*) AS n FROM (SELECT * FROM part USING SAMPLE 100 ROWS)")
def reservoir_sample(spark, sf_dir):
    return rows.reservoir_sample(table(spark, sf_dir, "part"), 100, 7).agg(F.count("*").alias("n"))


same("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
same("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
same("except_distinct", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
same("except_all", "SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation")
same("intersect_distinct", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
same("intersect_all", "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")


@query("SELECT r_name, r_regionkey AS k FROM region UNION ALL BY NAME SELECT n_name, n_regionkey AS k FROM nation")
def union_by_name(spark, sf_dir):
    return shape.union_by_name(table(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").alias("k")), table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("k")))


same("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 400000), n AS (SELECT o_custkey, count(*) AS c FROM big GROUP BY o_custkey) SELECT c, count(*) AS custs FROM n GROUP BY c")
same("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")


@query("WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey % 23 AS a, s_nationkey % 23 AS b FROM supplier), r(a, b) AS (SELECT a, b FROM e WHERE a = 1 UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a::BIGINT AS a, b::BIGINT AS b FROM r")
def recursive_union(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 23).alias("a"), (F.col("s_nationkey") % 23).cast("bigint").alias("b")).distinct()
    f = e.select(F.col("a").alias("x"), F.col("b").alias("y"))
    return rows.recursive(e.where("a = 1"), lambda r: r.join(f, r["b"] == f["x"]).select("a", F.col("y").alias("b")))


same("scalar_subquery", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
same("correlated_subquery", "SELECT s_suppkey FROM supplier a WHERE s_acctbal >= (SELECT max(s_acctbal) FROM supplier b WHERE b.s_nationkey = a.s_nationkey)")
same("exists_subquery", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0)")
same("not_exists", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 3000)")


@query("SELECT p_partkey, p_size > ANY (SELECT s_nationkey FROM supplier) AS a, p_size <= ALL (SELECT s_nationkey FROM supplier) AS z, p_size = ANY (SELECT nullif(s_nationkey, 4) FROM supplier) AS e FROM part")
def any_all(spark, sf_dir):
    p, s = table(spark, sf_dir, "part").select("p_partkey", "p_size"), table(spark, sf_dir, "supplier")
    for name, op, kind, other in (("a", ">", "any", s), ("z", "<=", "all", s), ("e", "=", "any", s.select(F.nullif("s_nationkey", F.lit(4)).alias("s_nationkey")))):
        p = joins.compare_all(p, F.col("p_size"), other, "s_nationkey", op, kind).withColumnRenamed("result", name)
    return p.drop("p_size")


@query("SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS F_q, count(*) FILTER (l_linestatus = 'F') AS F_n, sum(l_quantity) FILTER (l_linestatus = 'O') AS O_q, count(*) FILTER (l_linestatus = 'O') AS O_n FROM lineitem GROUP BY l_returnflag")
def pivot(spark, sf_dir):
    return shape.pivot(table(spark, sf_dir, "lineitem"), "l_linestatus", {"q": F.sum("l_quantity"), "n": F.count(F.lit(1))}, ["l_returnflag"])


@query("SELECT l_orderkey, l_linenumber, name, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME name VALUE value)")
def unpivot(spark, sf_dir):
    return shape.unpivot(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("SELECT * EXCLUDE (n_regionkey) REPLACE (lower(n_name) AS n_name) RENAME (n_nationkey AS id) FROM nation")
def star_modifiers(spark, sf_dir):
    return shape.star(table(spark, sf_dir, "nation"), exclude=["n_regionkey"], replace={"n_name": F.lower("n_name")}, rename={"n_nationkey": "id"})


@query("SELECT max(COLUMNS('l_(tax|discount|quantity)')) FROM lineitem")
def columns_expression(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.agg(*shape.columns(li, "l_(tax|discount|quantity)", F.max))


@query("SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey FROM part")
def unnest(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"), "p_partkey")


@query("SELECT approx_count_distinct(o_custkey) BETWEEN 0.9 * count(DISTINCT o_custkey) AND 1.1 * count(DISTINCT o_custkey) AS near FROM orders")
def approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.approx_count_distinct("o_custkey").alias("a"), F.countDistinct("o_custkey").alias("n")).select(F.col("a").between(F.col("n") * 0.9, F.col("n") * 1.1).alias("near"))
