"""Queries for the wider surface: more windows and aggregates, JSON building, table functions, user functions and changes to tables."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalogue import query, same, table
from tessera.functions import aggregates as A
from tessera.operators import rows
from tessera.sources import files
from tessera.sources.tables import Store

same("any_value_first", "SELECT s_nationkey, any_value(s_nationkey) AS a, min(s_suppkey) AS f FROM supplier GROUP BY s_nationkey")
same("product_agg", "SELECT n_regionkey, round(exp(sum(ln(n_nationkey + 1))), 3) AS p FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, round(product(n_nationkey + 1), 3) AS p FROM nation GROUP BY n_regionkey")
same("window_aggregates", "SELECT s_suppkey, round(avg(s_acctbal) OVER w, 4) AS a, max(s_acctbal) OVER w AS m, count(*) OVER w AS c, round(stddev_pop(s_acctbal) OVER w, 4) AS d FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
same("window_running_range", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND INTERVAL '30' DAY FOLLOWING), 2) AS near FROM orders")
same("window_unpartitioned", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_name) AS BIGINT) AS rn, lag(n_name) OVER (ORDER BY n_name) AS prev FROM nation")
same("nested_cte", "WITH a AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1), b AS (SELECT max(n) AS m FROM a) SELECT r, n FROM a, b WHERE n = m")
same("materialized_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT count(*) AS pairs FROM big x JOIN big y ON x.o_custkey = y.o_custkey", "WITH big AS MATERIALIZED (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT count(*) AS pairs FROM big x JOIN big y ON x.o_custkey = y.o_custkey")
same("recursive_paths", "WITH RECURSIVE p(k, depth, path) AS (SELECT 1, 0, '1' UNION ALL SELECT k * 2, depth + 1, concat(path, '/', CAST(k * 2 AS VARCHAR(20))) FROM p WHERE depth < 8) SELECT k, depth, path FROM p")
same("lateral_topk", "SELECT n_name, t.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC LIMIT 2) t")
same("correlated_exists_in", "SELECT c_custkey FROM customer c WHERE c_custkey IN (SELECT o_custkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 450000)")
same("case_aggregate", "SELECT o_orderstatus, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS urgent FROM orders GROUP BY o_orderstatus")
same("order_by_expression", "SELECT n_name FROM nation ORDER BY length(n_name) DESC, n_name LIMIT 7")
same("union_of_limits", "(SELECT n_name AS name FROM nation ORDER BY n_name LIMIT 3) UNION ALL (SELECT r_name FROM region ORDER BY r_name DESC LIMIT 2)")
same("values_join", "SELECT n_name, tag FROM nation JOIN (VALUES (0, 'zero'), (1, 'one')) AS v(k, tag) ON n_regionkey = k")
same("timestamp_filters", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-05 12:00:00' GROUP BY event_type")
same("try_cast_rows", "SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS INT) AS b FROM part")


@query("SELECT s_nationkey, array_to_string(list_transform(list(nullif(s_suppkey, 5) ORDER BY s_suppkey), lambda x: coalesce(x::VARCHAR, 'NULL')), ',') AS keys FROM supplier GROUP BY s_nationkey")
def list_with_nulls(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    l = A.list_ordered(F.nullif("s_suppkey", F.lit(5)), F.col("s_suppkey"))
    return s.groupBy("s_nationkey").agg(F.array_join(F.transform(l, lambda x: x.cast("string")), ",", "NULL").alias("keys"))


@query("SELECT s_nationkey, arg_min_null(nullif(s_suppkey, 5), s_acctbal) AS lo, arg_max_null(nullif(s_suppkey, 5), s_acctbal) AS hi FROM supplier GROUP BY s_nationkey")
def arg_extremes_with_nulls(spark, sf_dir):
    x, y = F.nullif("s_suppkey", F.lit(5)), F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(A.arg_min_null(x, y).alias("lo"), A.arg_max_null(x, y).alias("hi"))


@query("SELECT abs(approx_quantile(o_totalprice, 0.5) / median(o_totalprice) - 1) < 0.05 AS near FROM orders")
def approx_quantile(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg((F.abs(F.percentile_approx("o_totalprice", 0.5) / F.median("o_totalprice") - 1) < 0.05).alias("near"))


@query("SELECT event_type AS item FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC LIMIT 2)")
def approx_top_k(spark, sf_dir):
    top = table(spark, sf_dir, "events").agg(F.expr("approx_top_k(event_type, 2)").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("item"))


@query("SELECT s_suppkey, mode_size FROM (SELECT s_suppkey, s_nationkey FROM supplier) JOIN (SELECT s_nationkey, count(DISTINCT s_acctbal) AS mode_size FROM supplier GROUP BY s_nationkey) USING (s_nationkey)")
def window_count_distinct(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.size(F.collect_set("s_acctbal").over(W.partitionBy("s_nationkey"))).cast("bigint").alias("mode_size"))


@query("SELECT o_orderkey, median(o_totalprice) OVER (PARTITION BY o_custkey) AS m, quantile_disc(o_totalprice, 0.5) OVER (PARTITION BY o_custkey) AS q FROM orders")
def window_quantiles(spark, sf_dir):
    w = W.partitionBy("o_custkey")
    prices = F.sort_array(F.collect_list("o_totalprice").over(w))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.median("o_totalprice").over(w).alias("m"), F.element_at(prices, F.ceil(F.size(prices) * 0.5).cast("int")).alias("q"))


@query("SELECT event_type, to_json(list(user_id ORDER BY event_id))::VARCHAR AS users, count(*) AS n FROM events GROUP BY event_type")
def json_group_array(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.to_json(A.list_ordered(F.col("user_id"), F.col("event_id"))).alias("users"), F.count("*").alias("n"))


@query("SELECT event_id, json_transform(props, '{\"k\": \"INTEGER\"}').k AS k FROM events")
def json_transform(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT g AS id, g * g AS sq FROM generate_series(1, 50) t(g)")
def generate_series(spark, sf_dir):
    return spark.range(1, 51).select("id", (F.col("id") * F.col("id")).alias("sq"))


@query("SELECT n_name AS \"#2\" FROM nation")
def positional_reference(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col(n.columns[1]).alias("#2"))


@query("SELECT s.name, s.key::BIGINT AS key FROM (SELECT unnest([{'name': n_name, 'key': n_nationkey}, {'name': lower(n_name), 'key': -n_nationkey}]) AS s FROM nation)")
def unnest_structs(spark, sf_dir):
    two = F.array(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")), F.struct(F.lower("n_name").alias("name"), (-F.col("n_nationkey")).alias("key")))
    return table(spark, sf_dir, "nation").select(F.inline(two)).select("name", F.col("key").cast("bigint").alias("key"))


@query("SELECT p_partkey, p_size * 2 + 1 AS y FROM part")
def scalar_udf(spark, sf_dir):
    def twice_and_one(s: pd.Series) -> pd.Series:
        return s * 2 + 1

    twice = F.pandas_udf(twice_and_one, T.IntegerType())
    return table(spark, sf_dir, "part").select("p_partkey", twice("p_size").alias("y"))


@query("SELECT p_brand, round(stddev_pop(p_retailprice), 6) AS d FROM part GROUP BY p_brand")
def aggregate_udf(spark, sf_dir):
    def spread(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p_brand": [key[0]], "d": [round(float(frame.p_retailprice.std(ddof=0)), 6)]})

    return table(spark, sf_dir, "part").select("p_brand", "p_retailprice").groupBy("p_brand").applyInPandas(spread, "p_brand string, d double")


@query("SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS piece FROM nation")
def table_udf(spark, sf_dir):
    class Pieces:
        def eval(self, key: int, name: str):
            for piece in name.split("A"):
                yield key, piece

    pieces = F.udtf(Pieces, returnType="n_nationkey int, piece string")
    n = table(spark, sf_dir, "nation")
    n.createOrReplaceTempView("nation")
    spark.udtf.register("pieces_of", pieces)
    return spark.sql("SELECT t.n_nationkey, t.piece FROM nation, LATERAL pieces_of(nation.n_nationkey, nation.n_name) t")


def _folder(spark) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared or tempfile.gettempdir()}/tessera-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_acctbal * CASE WHEN s_nationkey < 5 THEN 2 ELSE 1 END AS s_acctbal FROM supplier WHERE s_nationkey <> 7 UNION ALL SELECT -1, 0.0")
def insert_update_delete(spark, sf_dir):
    store = Store(spark, _folder(spark))
    store.create_as("tessera_s", table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))
    store.update("tessera_s", {"s_acctbal": F.col("s_acctbal") * 2}, F.col("s_nationkey") < 5)
    store.delete("tessera_s", F.col("s_nationkey") == 7)
    store.insert("tessera_s", spark.createDataFrame([(-1, 0.0)], "s_suppkey bigint, s_acctbal double"), by_name=True)
    return store.read("tessera_s").select("s_suppkey", "s_acctbal")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'new'")
def upsert(spark, sf_dir):
    store, n = Store(spark, _folder(spark)), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    store.create("tessera_n", n.schema, primary_key=["n_nationkey"])
    store.insert("tessera_n", n)
    changed = n.where("n_nationkey % 2 = 0").withColumn("n_name", F.lower("n_name")).unionAll(spark.createDataFrame([(100, "new")], n.schema))
    store.upsert("tessera_n", changed)
    return store.read("tessera_n")


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def hive_partitions(spark, sf_dir):
    folder = _folder(spark)
    files.copy_to(table(spark, sf_dir, "nation"), folder, "parquet", ["n_regionkey"])
    return files.read_parquet(spark, folder).where("n_regionkey = 2").select("n_regionkey", "n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name FROM region")
def csv_round_trip(spark, sf_dir):
    folder = _folder(spark)
    files.copy_to(table(spark, sf_dir, "region"), folder, "csv")
    return files.read_csv(spark, folder, header=True, delim=",", columns={"r_regionkey": "int", "r_name": "string"})


@query("SELECT event_id, event_type, value FROM events")
def json_round_trip(spark, sf_dir):
    folder = _folder(spark)
    files.copy_to(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), folder, "json")
    return files.read_json(spark, folder, columns={"event_id": "bigint", "event_type": "string", "value": "double"})


@query("SELECT (row_number() OVER () - 1)::BIGINT AS row_index, n_name FROM nation")
def row_ids(spark, sf_dir):
    return rows.with_row_index(table(spark, sf_dir, "nation").select("n_name")).select("row_index", "n_name")
