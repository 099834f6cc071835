"""Tables about a session: its tables, columns, settings, functions and so on. They list names, never data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The dialect's names of Spark's types.
NAMES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT", "binary": "BLOB", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}

LISTINGS = ("tables", "views", "columns", "schemas", "databases", "settings", "functions", "sequences", "variables", "constraints", "types")


def shown(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"{shown(kind.elementType)}[]"
    if isinstance(kind, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {shown(f.dataType)}" for f in kind) + ")"
    if isinstance(kind, T.MapType):
        return f"MAP({shown(kind.keyType)}, {shown(kind.valueType)})"
    return NAMES.get(kind.simpleString(), kind.simpleString().upper())


def views_of(con) -> list[str]:
    return sorted({t.name for t in con.spark.catalog.listTables() if not t.name.startswith("__") and t.name not in con.store.tables})


def fields_of(con) -> list[tuple]:
    out = []
    for name in sorted(con.store.tables):
        t = con.store.tables[name]
        out += [(name, f.name, i, shown(f.dataType), f.name not in {*t.not_null, *t.primary_key}, t.defaults.get(f.name)) for i, f in enumerate(t.schema, 1)]
    for name in views_of(con):
        out += [(name, f.name, i, shown(f.dataType), True, None) for i, f in enumerate(con.spark.table(name).schema, 1)]
    return out


def rules_of(con) -> list[tuple]:
    out = []
    for name in sorted(con.store.tables):
        t = con.store.tables[name]
        out += [(name, "PRIMARY KEY", f"PRIMARY KEY({', '.join(t.primary_key)})", t.primary_key)] if t.primary_key else []
        out += [(name, "UNIQUE", f"UNIQUE({', '.join(u)})", u) for u in t.unique]
        out += [(name, "NOT NULL", "NOT NULL", [c]) for c in t.not_null]
        out += [(name, "CHECK", f"CHECK({c})", None) for c in t.checks]
        out += [(name, "FOREIGN KEY", f"FOREIGN KEY ({', '.join(a)}) REFERENCES {to}({', '.join(b)})", a) for a, to, b in t.references]
    return out


def listing(con, kind: str) -> DataFrame:
    """What the session has of a kind (one of LISTINGS)."""
    store, spark = con.store, con.spark
    make = spark.createDataFrame
    if kind == "tables":
        return make([("main", n, len(t.schema), bool(t.primary_key), t.comment) for n, t in sorted(store.tables.items())], "schema_name string, table_name string, column_count int, has_primary_key boolean, comment string")
    if kind == "views":
        return make([("main", n, len(spark.table(n).columns)) for n in views_of(con)], "schema_name string, view_name string, column_count int")
    if kind == "columns":
        return make([("main", *f) for f in fields_of(con)], "schema_name string, table_name string, column_name string, column_index int, data_type string, is_nullable boolean, column_default string")
    if kind == "schemas":
        return make(sorted({("main",), *((d.name,) for d in spark.catalog.listDatabases())}), "schema_name string")
    if kind == "databases":
        return make([(c.name,) for c in spark.catalog.listCatalogs()], "database_name string")
    if kind == "settings":
        return spark.sql("SET").selectExpr("key AS name", "value").unionByName(make(sorted((k, str(v)) for k, v in con.settings.items()), "name string, value string"))
    if kind == "functions":
        return spark.sql("SHOW ALL FUNCTIONS").selectExpr("function AS function_name", "'scalar' AS function_type").unionByName(make([(n, "table_macro" if m[2] else "macro") for n, m in sorted(con.macros.items())], "function_name string, function_type string"))
    if kind == "sequences":
        return make([(n, start, by) for n, (start, by) in sorted(store.sequences.items())], "sequence_name string, next_value bigint, increment_by bigint")
    if kind == "variables":
        return make([(n,) for n in sorted(con.variables)], "name string")
    if kind == "constraints":
        return make(rules_of(con), "table_name string, constraint_type string, constraint_text string, constraint_column_names array<string>")
    return make([(n, "ENUM", v) for n, v in sorted(store.types.items())], "type_name string, logical_type string, labels array<string>")


def standard(con, kind: str) -> DataFrame:
    """The standard's views tables, columns and schemata."""
    make = con.spark.createDataFrame
    if kind == "tables":
        return make([("main", n, "BASE TABLE") for n in sorted(con.store.tables)] + [("main", n, "VIEW") for n in views_of(con)], "table_schema string, table_name string, table_type string")
    if kind == "columns":
        return make([("main", t, c, i, d, "YES" if null else "NO", kind_) for t, c, i, kind_, null, d in fields_of(con)], "table_schema string, table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string")
    return listing(con, "schemas")


def table_info(con, name: str) -> DataFrame:
    """One row per column of a table or view."""
    keys = con.store.tables[name].primary_key if name in con.store.tables else []
    found = [(i - 1, c, kind, not null, default, c in keys) for t, c, i, kind, null, default in fields_of(con) if t == name]
    if not found:
        raise ValueError(f"no table {name}")
    return con.spark.createDataFrame(found, "cid int, name string, type string, notnull boolean, dflt_value string, pk boolean")
