"""Queries written in the SQL dialect and run by a session as they stand; the same text is their SQL for comparison."""

from __future__ import annotations

from tessera.catalogue import query, table


def text(name: str, sources: str, sql: str) -> None:
    """Registers a query whose text both engines read alike."""

    def run(spark, sf_dir):
        import tessera

        con = tessera.connect(spark)
        for source in sources.split():
            con.register(source, table(spark, sf_dir, source))
        return con.sql(sql).native

    run.__name__ = name
    query(sql)(run)


text("sql_interval_functions", "orders", "SELECT o_orderkey, CAST(o_orderdate + to_weeks(2) AS DATE)::VARCHAR AS w, CAST(o_orderdate + to_quarters(1) AS DATE)::VARCHAR AS q, CAST(o_orderdate + to_decades(1) AS DATE)::VARCHAR AS d, CAST(o_orderdate + to_centuries(1) AS DATE)::VARCHAR AS c, hour(o_orderdate + to_milliseconds(7200000)) AS h FROM orders")
text("sql_list_functions", "part", "SELECT p_partkey, array_to_string(array_slice([p_size, 2, 3, 4], 1, 3), ',') AS a, len(array_value(p_size, 9)) AS b, round(list_cosine_distance([1.0, p_size], [2.0, 1.0]), 9) AS c, round(list_negative_inner_product([1.0, p_size], [2.0, 1.0]), 6) AS d FROM part")
text("sql_subscripts", "nation", "SELECT n_nationkey, generate_subscripts([5, 6, 7], 1) AS i FROM nation")
text("sql_split_to_table", "part", "SELECT p_partkey, regexp_split_to_table(p_name, ' ') AS word FROM part")
text("sql_json_value", "events", "SELECT event_id, json_value(props, '$.k') AS k, json_value(props, '$.none') AS none FROM events")
text("sql_text_functions", "part", "SELECT p_partkey, left_grapheme(p_name, 2) AS l, right_grapheme(p_name, 3) AS r, substring_grapheme(p_name, 2, 3) AS s FROM part")
text("sql_aggregates", "part", "SELECT p_brand, CAST(sum_no_overflow(p_size) AS BIGINT) AS n, mad(p_size) AS m, round(entropy(p_type), 9) AS e, favg(p_size) AS a, round(fsum(p_retailprice), 4) AS f, round(weighted_avg(p_retailprice, p_size), 6) AS w FROM part GROUP BY p_brand")

text("sql_age", "orders", "SELECT o_orderkey, CAST(age(TIMESTAMP '2001-04-10 12:30:00', o_orderdate::TIMESTAMP) + TIMESTAMP '2000-03-31 00:00:00' AS VARCHAR) AS later FROM orders")
text("sql_list_aggregates", "part", "SELECT p_partkey, CAST(list_aggregate([p_size, 7, NULL], 'sum') AS BIGINT) AS s, list_aggregate([p_size, 7, NULL], 'avg') AS a, list_aggr([p_size, 7, 3], 'min') AS lo, list_median([p_size, 7, 3, 20]) AS m, list_mode([p_size, 7, 7, 3]) AS o, round(list_stddev_samp([p_size, 7, 3]), 9) AS d, list_any_value([NULL, p_size]) AS v, list_product([p_size, 2]) AS p, len(map_keys(list_aggregate([p_size, 100, 100], 'histogram'))) AS h, list_aggregate([p_brand, p_type], 'string_agg', '|') AS t FROM part")
text("sql_vector_products", "part", "SELECT p_partkey, list_negative_dot_product([1.0, p_size], [2.0, 3.0]) AS n, list_cosine_similarity([1.0, p_size], [2.0, 3.0]) > 0.5 AS near FROM part")
text("sql_struct_concat", "nation", "SELECT n_nationkey, struct_concat({'a': n_nationkey, 'b': n_name}, {'c': n_regionkey}).b AS b, struct_concat(s, {'c': n_regionkey}).k AS k FROM (SELECT *, {'k': n_nationkey} AS s FROM nation) AS x")
text("sql_json_shapes", "events", "SELECT event_id, json_structure(props)::VARCHAR AS shape, json_pretty(props)::VARCHAR AS text, json_structure('[1, -2, {\"a\": []}]')::VARCHAR AS mixed FROM events")
text("sql_like_escape", "part", "SELECT p_partkey, like_escape(p_name, '%$%%', '$') AS a, not_like_escape(p_name, '%a%', '$') AS b, ilike_escape(p_type, '%Steel%', '$') AS c FROM part")
text("sql_collations", "part", "SELECT p_partkey, p_type COLLATE NOCASE = lower(p_type) AS same, p_type = lower(p_type) AS exact FROM part")
text("sql_operator_functions", "part", "SELECT p_partkey, multiply(p_size, 3) AS m, add(p_size, 1) AS a, subtract(p_size, 1) AS s, CAST(divide(p_size, 7) AS BIGINT) AS d, nextafter(p_size::DOUBLE, 0::DOUBLE) < p_size AS n FROM part")
text("sql_ordered_ranking", "supplier", "SELECT s_suppkey, rank(ORDER BY s_acctbal DESC) OVER (PARTITION BY s_nationkey) AS r, percent_rank(ORDER BY s_nationkey) OVER () AS d, lag(s_suppkey ORDER BY s_suppkey) OVER (PARTITION BY s_nationkey) AS p FROM supplier")
text("sql_zone_parts", "events", "SELECT event_id, CAST(timezone_hour(ts::TIMESTAMPTZ) AS BIGINT) AS h, CAST(timezone_minute(ts::TIMESTAMPTZ) AS BIGINT) AS m FROM events")
