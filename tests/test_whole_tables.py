"""Queries over large tables cover every row."""

import pytest

from tessera import catalogue

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, source", [("math_rounding", "lineitem"), ("math_functions", "lineitem"), ("math_trigonometry", "lineitem"), ("math_integers", "orders"), ("json_group_array", "events")])
def test_every_row_is_covered(spark, name, source):
    rows = catalogue.QUERIES[f"{name}"](spark, SF)
    n = rows.agg({"n": "sum"}).first()[0] if name == "json_group_array" else rows.count()
    assert n == spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert "< " not in catalogue.ORACLES[f"{name}"].split("FROM")[-1]


def test_integers_beyond_doubles(spark, tmp_path):
    import duckdb

    path, far = str(tmp_path), 10**17 + 3
    duckdb.sql(f"COPY (SELECT o_orderkey + {far} AS o_orderkey, o_custkey + {far + 4} AS o_custkey, * EXCLUDE (o_orderkey, o_custkey) FROM '{SF}/orders.parquet') TO '{path}/orders.parquet' (FORMAT parquet)")
    ours = catalogue.QUERIES["math_integers"](spark, path).select("o_orderkey", "id", "lc", "g", "md").collect()
    theirs = duckdb.sql(f"SELECT o_orderkey, id, lc, g, md FROM ({catalogue.ORACLES['math_integers'].replace('FROM orders', f"FROM '{path}/orders.parquet'")})").fetchall()
    assert sorted(map(tuple, ours)) == sorted(theirs)
