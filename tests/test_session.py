"""The dialect, managed tables, files and relations, against DuckDB where it can run the same text."""

import duckdb
import pytest

import tessera
from tessera.sources.tables import ConstraintError

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "supplier", "part", "orders", "events")


@pytest.fixture(scope="module")
def con(spark, tmp_path_factory):
    con = tessera.connect(spark, str(tmp_path_factory.mktemp("store")))
    for t in TABLES:
        con.from_parquet(f"{SF}/{t}.parquet").create_view(t)
    return con


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


SAME = [
    "FROM region",
    "SELECT * EXCLUDE (n_regionkey) FROM nation",
    "SELECT n_nationkey, n_name FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) = 1",
    "SELECT DISTINCT ON (n_regionkey) n_regionkey, n_name FROM nation ORDER BY n_regionkey, n_name DESC",
    "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 20%",
    "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY ALL",
    "SELECT [1, n_nationkey][2] AS x, {'a': n_name}.a AS y FROM nation",
    "SELECT n_nationkey // 7 AS d, n_nationkey::VARCHAR AS t FROM nation",
    "SELECT list_transform([1, 2, 3], lambda x: x * 2)[2] AS b FROM region",
    "SELECT [x + 1 FOR x IN [1, 2, 3] IF x > 1][1] AS b FROM region",
    "SELECT n_name FROM nation WHERE n_name SIMILAR TO '.*A.*' AND n_name GLOB '*A*'",
    "SELECT r_name AS name, r_regionkey AS k FROM region UNION ALL BY NAME SELECT n_regionkey AS k, n_nationkey AS other FROM nation",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION SELECT n + 1 FROM t WHERE n < 5) SELECT n FROM t",
    "SELECT n_name, r_name FROM nation POSITIONAL JOIN region",
    "SELECT e.event_id, p.pid FROM events e ASOF LEFT JOIN (SELECT event_id AS pid, user_id, ts AS pts FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.pts",
    "SELECT max(COLUMNS('s_(suppkey|acctbal)')) FROM supplier",
    "SELECT * FROM (SELECT s_nationkey, s_acctbal FROM supplier QUALIFY rank() OVER (ORDER BY s_acctbal DESC) <= 3) WHERE s_acctbal > 0",
    "SELECT log(100) AS l, dayofweek(DATE '2024-01-07') AS d, arg_max(n_name, n_nationkey) AS m FROM nation",
    "SELECT n_nationkey, list(n_name ORDER BY n_name)[1] AS first FROM nation GROUP BY n_nationkey",
    "SELECT count(*) FILTER (WHERE n_regionkey = 1) AS c FROM nation",
    "SELECT * REPLACE (lower(r_name) AS r_name) FROM region",
    "SELECT list_reduce([1, 2, 3], lambda a, b: a + b) AS r, 'abcdef'[2:4] AS e, 2 ** 3 AS c, 7 // 2 AS d",
    "SELECT n_name FROM nation WHERE n_regionkey > ANY (SELECT r_regionkey FROM region)",
    "SELECT n_name FROM nation WHERE n_regionkey >= ALL (SELECT r_regionkey FROM region)",
    "SELECT sum(n_nationkey) FILTER (n_regionkey = 1) AS s, first(n_name ORDER BY n_name DESC) AS f, mode(n_regionkey) AS m FROM nation",
    "SELECT kurtosis(n_nationkey) AS k, skewness(n_nationkey) AS s FROM nation",
    "SELECT entropy(n_regionkey) AS e, mad(n_nationkey) AS m FROM nation",
    "SELECT regexp_replace('hello', 'l(.)', 'L\\1') AS a, regexp_extract('abc123', '[0-9]+') AS b, left('abc', -1) AS l, concat('a', NULL, 'b') AS c",
    "SELECT dayname(DATE '2024-01-07') AS n, epoch_ms(TIMESTAMP '2024-01-01 00:00:01') AS m, gcd(12, 18) AS g, lcm(4, 6) AS l, xor(5, 3) AS x",
    "SELECT map {'a': 1, 'b': 2}['b'] AS m, '{\"a\": 5}'->>'a' AS k, format('{} is {}', 'a', 1) AS f, jaccard('abc', 'abd') AS j",
    "SELECT string_agg(DISTINCT n_regionkey::VARCHAR, ',' ORDER BY n_regionkey::VARCHAR) AS s FROM nation",
    "SELECT time_bucket(INTERVAL '2 hours', TIMESTAMP '2024-01-01 05:30:00') AS t, damerau_levenshtein('ab', 'ba') AS d",
    "SELECT count(*) AS c FROM (SELECT row_number() OVER () AS r FROM region)",
    "WITH a AS MATERIALIZED (SELECT 1 AS x) SELECT * FROM a",
    "SELECT * FROM generate_series(1, 3)",
]


def rows(data):
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(clean, r)) for r in data), key=repr)


@pytest.mark.parametrize("sql", SAME)
def test_same_text(con, duck, sql):
    ours = con.sql(sql)
    theirs = duck.sql(sql)
    order = sorted(range(len(theirs.columns)), key=lambda i: theirs.columns[i].lower())
    own = sorted(range(len(ours.columns)), key=lambda i: ours.columns[i].lower())
    assert rows(tuple(r[i] for i in own) for r in ours.fetchall()) == rows(tuple(r[i] for i in order) for r in theirs.fetchall())


def test_decide_statements(con):
    sql = "SELECT s_suppkey, pick FROM supplier WHERE s_acctbal > 0 DECIDE pick(BOOL) SUCH THAT SUM(pick) <= 3 MAXIMIZE SUM(pick * s_acctbal)"
    top = con.sql("SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC LIMIT 3").fetchall()
    assert {r[0] for r in con.sql(sql).fetchall() if r[1]} == {r[0] for r in top}
    first = "SELECT s_suppkey, pick DECIDE pick(BOOL) FROM supplier WHERE s_acctbal > 0 SUCH THAT SUM(pick) <= 3 MAXIMIZE SUM(pick * s_acctbal)"
    assert {r[0] for r in con.sql(first).fetchall() if r[1]} == {r[0] for r in top}
    assert con.sql("DIAGNOSE " + sql).fetchall()[0][0] == "SOLVED"
    assert "SUM(pick) <= 3" in con.sql("EXPLAIN " + sql).fetchall()[0][1]


def test_tables(con):
    con.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, v VARCHAR DEFAULT 'x', n DOUBLE CHECK (n >= 0))")
    con.sql("INSERT INTO t VALUES (1, 'a', 1.5), (2, 'b', 2.5)")
    con.sql("INSERT INTO t (id, n) VALUES (3, 0)")
    con.sql("INSERT INTO t BY NAME SELECT 4.0 AS n, 4 AS id")
    assert rows(con.sql("SELECT * FROM t").fetchall()) == rows([(1, "a", 1.5), (2, "b", 2.5), (3, "x", 0.0), (4, "x", 4.0)])
    for bad in ("INSERT INTO t VALUES (1, 'z', 1)", "INSERT INTO t VALUES (9, 'z', -1)", "INSERT INTO t VALUES (NULL, 'z', 1)"):
        with pytest.raises(ConstraintError):
            con.sql(bad)
    con.sql("UPDATE t SET n = n * 10, v = upper(v) WHERE id <= 2")
    con.sql("DELETE FROM t WHERE id = 3")
    con.sql("INSERT INTO t VALUES (2, 'new', 7), (5, 'five', 5) ON CONFLICT (id) DO UPDATE SET n = excluded.n + n")
    con.sql("INSERT OR IGNORE INTO t VALUES (2, 'no', 0)")
    assert rows(con.sql("SELECT * FROM t").fetchall()) == rows([(1, "A", 15.0), (2, "B", 32.0), (4, "x", 4.0), (5, "five", 5.0)])
    assert con.sql("INSERT INTO t VALUES (6, 'r', 1) RETURNING id + 1 AS next").fetchall() == [(7,)]
    con.sql("UPDATE t SET v = n_name FROM nation WHERE n_nationkey = id")
    con.sql("DELETE FROM t USING nation WHERE n_nationkey = id AND n_nationkey > 4")
    assert [r[0] for r in con.sql("SELECT id FROM t ORDER BY id").fetchall()] == [1, 2, 4]
    con.sql("BEGIN")
    con.sql("DELETE FROM t")
    con.sql("ROLLBACK")
    assert con.table("t").count().fetchone()[0] == 3
    con.sql("ALTER TABLE t ADD COLUMN extra INTEGER")
    con.sql("ALTER TABLE t RENAME COLUMN v TO w")
    assert con.table("t").columns == ["id", "w", "n", "extra"]
    con.sql("CREATE TABLE c AS SELECT id, n FROM t")
    con.sql("TRUNCATE c")
    assert con.sql("SELECT count(*) FROM c").fetchall() == [(0,)]
    con.sql("DROP TABLE c")


def test_files(con, tmp_path):
    con.sql(f"COPY (SELECT * FROM nation) TO '{tmp_path}/n' (FORMAT parquet, PARTITION_BY (n_regionkey))")
    assert con.sql(f"SELECT count(*) FROM '{tmp_path}/n'").fetchall() == [(25,)]
    con.table("region").to_csv(f"{tmp_path}/r")
    assert con.sql(f"SELECT count(*), max(r_name) FROM read_csv('{tmp_path}/r')").fetchall()[0][0] == 5
    con.sql("COPY (SELECT 1 AS a, 'x' AS b) TO '%s/j' (FORMAT json)" % tmp_path)
    assert con.read_json(f"{tmp_path}/j").fetchall() == [(1, "x")]
    assert con.table_function("parquet_metadata", f"{SF}/nation.parquet").native.count() >= 3
    assert con.table_function("glob", f"{SF}/na*.parquet").native.count() == 1
    assert con.table_function("read_text", f"{tmp_path}/j/*.json").native.count() == 1
    con.sql("CREATE OR REPLACE TABLE e AS SELECT * FROM region")
    con.sql(f"EXPORT DATABASE '{tmp_path}/db'")
    con.sql("DROP TABLE e")
    con.sql(f"IMPORT DATABASE '{tmp_path}/db'")
    assert con.table("e").native.count() == 5


def test_relations(con):
    n = con.table("nation")
    assert n.filter("n_regionkey = 1").count().fetchone() == (5,)
    assert n.aggregate("count(*) AS c", "n_regionkey").order("n_regionkey").fetchmany(2) == [(0, 5), (1, 5)]
    assert n.project("n_name, n_regionkey").limit(3, 2).native.count() == 3
    assert n.set_alias("n").join(con.table("region").set_alias("r"), "n.n_regionkey = r.r_regionkey").native.count() == 25
    assert n.union(n).distinct().native.count() == 25
    assert n.describe().native.where("column_name = 'n_nationkey'").first()["max"] == "24"
    assert n.map(lambda p: p[["n_nationkey"]] * 2, "n_nationkey int").max("n_nationkey").fetchone() == (48,)
    assert "Scan parquet" in n.explain() and n.arrow().num_rows == 25 and len(n.df()) == 25 and len(n.fetchnumpy()["n_name"]) == 25
    con.create_function("twice", lambda x: None if x is None else x * 2, "int")
    assert con.sql("SELECT twice(21) AS t").fetchall() == [(42,)]
    assert con.execute("SELECT n_name FROM nation WHERE n_nationkey = ? AND n_regionkey = ?", [3, 1]).native.count() in (0, 1)
    assert con.execute("SELECT $a + $b AS s", {"a": 1, "b": 2}).fetchall() == [(3,)]
    con.sql("PREPARE p AS SELECT $1 * 2 AS d")
    assert con.sql("EXECUTE p(4)").fetchall() == [(8,)]
    con.sql("CREATE MACRO plus_one(a) AS a + 1")
    assert con.sql("SELECT plus_one(2) AS p").fetchall() == [(3.0,)]
    assert ("nation",) in con.sql("SHOW TABLES").fetchall() and con.sql("SUMMARIZE nation").native.count() == 3
    assert con.sql("DESCRIBE region").fetchall()[0][0] == "r_regionkey"
    assert con.sql("SELECT * FROM part USING SAMPLE 10 ROWS").native.count() == 10
    assert con.sql("PIVOT (SELECT n_regionkey, n_nationkey % 2 AS odd FROM nation) ON odd USING count(*) GROUP BY n_regionkey").native.count() == 5
    assert con.sql("UNPIVOT (SELECT n_nationkey, n_regionkey, n_nationkey * 2 AS b FROM nation) ON n_regionkey, b INTO NAME k VALUE v").native.count() == 50


def test_entropy_and_mad_beside_other_aggregates(spark):
    import tessera

    con = tessera.connect(spark).register("t", spark.createDataFrame([(1, "a"), (2, "a"), (4, "b"), (10, None), (None, "b")], "x int, y string"))
    (r,) = con.sql("SELECT mad(x) AS m, entropy(y) AS e, count(*) AS n FROM t").fetchall()
    assert r == (1.5, 1.0, 5)
    (r,) = con.sql("SELECT mad(x) AS m, entropy(y) AS e FROM t WHERE x > 99").fetchall()
    assert r == (None, 0.0)


def test_glob_operator_and_bits(spark):
    import tessera

    con = tessera.connect(spark)
    assert con.sql("SELECT 'abc' ~~~ 'a*' AS a, 'a.c' ~~~ 'a.?' AS b, 'abc' ~~~ '[b-d]bc' AS c, get_bit('0110', 1) AS d, set_bit('0110', 0, 1) AS e, bit_position('10', '0110') AS f, regexp_escape('a.b') AS g").fetchall() == [(True, True, False, 1, "1110", 3, "a\\.b")]


def test_lists_of_the_session(spark, tmp_path):
    con = tessera.connect(spark, str(tmp_path))
    con.sql("CREATE TYPE mood AS ENUM ('sad', 'ok', 'happy')")
    con.sql("CREATE SEQUENCE counter START 5 INCREMENT BY 2")
    con.sql("CREATE TABLE pets (id INTEGER PRIMARY KEY, name VARCHAR DEFAULT 'x' NOT NULL, feels mood)")
    con.sql("SET VARIABLE chosen = 5")
    con.sql("SET threads = 3")
    assert con.sql("FROM pragma_table_info('pets')").fetchall() == [(0, "id", "INTEGER", True, None, True), (1, "name", "VARCHAR", True, "'x'", False), (2, "feels", "VARCHAR", False, None, False)]
    assert ("main", "pets", "BASE TABLE") in con.sql("FROM information_schema.tables").fetchall()
    assert con.sql("SELECT column_name FROM information_schema.columns WHERE table_name = 'pets' AND is_nullable = 'NO'").fetchall() == [("id",), ("name",)]
    assert con.sql("SELECT constraint_type FROM my_constraints() WHERE table_name = 'pets'").fetchall() == [("PRIMARY KEY",), ("NOT NULL",), ("CHECK",)]
    assert con.sql("SELECT column_count FROM my_tables()").fetchall() == [(3,)]
    assert con.sql("FROM my_sequences()").fetchall() == [("counter", 5, 2)]
    assert con.sql("SELECT type_name, labels FROM my_types()").fetchall() == [("mood", ["sad", "ok", "happy"])]
    assert con.sql("SELECT getvariable('chosen'), current_setting('threads')").fetchall() == [(5, 3)]
    assert con.sql("SELECT value FROM my_settings() WHERE name = 'threads'").fetchall() == [("3",)]
    assert con.sql("SELECT count(*) > 100 FROM my_functions()").fetchall() == [(True,)]
    with pytest.raises(ValueError):
        con.sql("SELECT current_setting('no_such')")
    with pytest.raises(ValueError):
        con.sql("FROM pragma_table_info('no_such')")


def test_enum_functions(spark, tmp_path):
    con = tessera.connect(spark, str(tmp_path))
    con.sql("CREATE TYPE mood AS ENUM ('sad', 'ok', 'happy')")
    got = con.sql("SELECT enum_range(NULL::mood), enum_first(NULL::mood), enum_last(NULL::mood), enum_code('ok'::mood), enum_range_boundary('ok'::mood, NULL::mood), CAST('ok' AS mood)").fetchall()
    assert got == [(["sad", "ok", "happy"], "sad", "happy", 1, ["ok", "happy"], "ok")]


def test_intervals_are_fetched_as_text(con):
    assert con.sql("SELECT age(TIMESTAMP '2001-04-10', TIMESTAMP '1957-06-13') AS a, to_years(2) AS y").fetchall() == [("43 years 9 months 27 days", "2 years")]
    assert con.sql("SELECT age(TIMESTAMP '2001-04-10 01:00:00', TIMESTAMP '2001-06-13 02:00:00') AS a").fetchone() == ("-2 months -3 days -1 hours",)
    assert con.sql("SELECT age(NULL::TIMESTAMP, TIMESTAMP '2001-06-13') AS a").fetchall() == [(None,)]


def test_empty_and_null_lists(con):
    got = con.sql("SELECT list_aggregate(l, 'sum') AS s, list_avg(l) AS a, list_median(l) AS m, list_mode(l) AS o, list_stddev_samp(l) AS d, list_any_value(l) AS v, list_count(l) AS c FROM (SELECT array_slice([1, 2], 2, 1) AS l UNION ALL SELECT NULL)").fetchall()
    assert got[0] == (None, None, None, None, None, None, 0)
    assert got[1][:6] == (None,) * 6
    with pytest.raises(NotImplementedError):
        con.sql("SELECT list_aggregate([1], 'no_such')")


def test_csv_after_leading_lines(con, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"made by hand\nin {i}\nid,name\n{2 * i},a\n{2 * i + 1},\"b,c\"\n")
    got = con.sql(f"FROM read_csv('{tmp_path}/*.csv', skip=2)")
    assert got.columns == ["id", "name"]
    assert sorted(got.fetchall()) == [(i, "b,c" if i % 2 else "a") for i in range(6)]


def test_ordered_ranking_needs_a_plain_window(con):
    with pytest.raises(NotImplementedError):
        con.sql("SELECT rank(ORDER BY n_name) OVER (ORDER BY n_nationkey) FROM nation")
