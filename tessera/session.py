"""connect(): a session that takes the dialect's SQL and hands out relations."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.decide import decide, diagnose, explain
from tessera.operators import joins, rows, shape
from tessera.plans import dialect
from tessera.sources import files, system
from tessera.sources.tables import Store, summarize


def connect(spark: SparkSession | None = None, folder: str | None = None) -> Connection:
    """A session over Spark; managed tables live in the folder (the warehouse's by default)."""
    spark = spark or SparkSession.builder.getOrCreate()
    if folder is None:
        place = spark.conf.get("spark.sql.warehouse.dir", None)
        folder = f"{place}/tessera" if place and spark.conf.get("spark.checkpoint.dir", None) else tempfile.mkdtemp(prefix="tessera-tables-")
    return Connection(spark, folder)


class Relation:
    """A lazy query with the relational API's verbs."""

    def __init__(self, con: Connection, df: DataFrame, alias: str = "unnamed_relation"):
        self.con, self.native, self.alias = con, df, alias
        self._rows = None

    def _new(self, df: DataFrame) -> Relation:
        return Relation(self.con, df, self.alias)

    def _sql(self, text: str) -> Relation:
        self.native.createOrReplaceTempView("__relation")
        return self._new(self.con.sql(text.replace("FROM __relation", f"FROM __relation AS {self.alias}")).native)

    @property
    def columns(self) -> list[str]:
        return self.native.columns

    @property
    def types(self) -> list[str]:
        return [t for _, t in self.native.dtypes]

    def filter(self, condition: str) -> Relation:
        return self._sql(f"SELECT * FROM __relation WHERE {condition}")

    def project(self, columns: str) -> Relation:
        return self._sql(f"SELECT {columns} FROM __relation")

    select = project

    def aggregate(self, aggregates: str, group: str = "") -> Relation:
        keys = f"{group}, " if group and group.strip().lower() not in aggregates.lower() else ""
        return self._sql(f"SELECT {keys if not re.match(r'(?i)\s*(cube|rollup|grouping)', group) else ''}{aggregates} FROM __relation" + (f" GROUP BY {group}" if group else ""))

    def _short(self, fn: str, column: str, group: str) -> Relation:
        return self.aggregate(f"{fn}({column}) AS {fn}_{re.sub(r'\W', '', column) or 'all'}", group)

    def sum(self, column: str, groups: str = "") -> Relation:
        return self._short("sum", column, groups)

    def avg(self, column: str, groups: str = "") -> Relation:
        return self._short("avg", column, groups)

    def min(self, column: str, groups: str = "") -> Relation:
        return self._short("min", column, groups)

    def max(self, column: str, groups: str = "") -> Relation:
        return self._short("max", column, groups)

    def count(self, column: str = "*", groups: str = "") -> Relation:
        return self._short("count", column, groups)

    def join(self, other: Relation, condition: str, how: str = "inner") -> Relation:
        names = [c.strip() for c in condition.split(",")]
        kind = {"semi": "left_semi", "anti": "left_anti", "outer": "full"}.get(how, how)
        if all(re.fullmatch(r"\w+", n) for n in names):
            return self._new(self.native.join(other.native, names, kind))
        a, b = self.alias if self.alias != "unnamed_relation" else "lhs", other.alias if other.alias != "unnamed_relation" else "rhs"
        return self._new(self.native.alias(a).join(other.native.alias(b), F.expr(condition), kind))

    def cross(self, other: Relation) -> Relation:
        return self._new(self.native.crossJoin(other.native))

    def asof_join(self, other: Relation, left_on: str, right_on: str, by: list[str], how: str = "inner") -> Relation:
        return self._new(joins.asof_join(self.native, other.native, left_on, right_on, by, how))

    def union(self, other: Relation) -> Relation:
        return self._new(self.native.unionAll(other.native))

    def except_(self, other: Relation) -> Relation:
        return self._new(self.native.subtract(other.native))

    def intersect(self, other: Relation) -> Relation:
        return self._new(self.native.intersect(other.native))

    def distinct(self) -> Relation:
        return self._new(self.native.distinct())

    def order(self, by: str) -> Relation:
        return self._sql(f"SELECT * FROM __relation ORDER BY {by}")

    sort = order

    def limit(self, n: int, offset: int = 0) -> Relation:
        return self._new((self.native.offset(offset) if offset else self.native).limit(n))

    def describe(self) -> Relation:
        return self._new(summarize(self.native))

    def decide(self, text: str, **options) -> Relation:
        return self._new(decide(self.native, text, **options))

    def set_alias(self, alias: str) -> Relation:
        return Relation(self.con, self.native, alias)

    def map(self, function, schema) -> Relation:
        """A function over pandas frames, batch by batch."""
        return self._new(self.native.mapInPandas(lambda it: (function(p) for p in it), schema))

    def query(self, view: str, sql: str) -> Relation:
        self.native.createOrReplaceTempView(view)
        return self.con.sql(sql)

    def insert(self, values) -> None:
        self.con.store.insert(self.alias, self.con.spark.createDataFrame([tuple(values)], self.native.schema))

    def insert_into(self, table: str) -> None:
        self.con.store.insert(table, self.native)

    def create(self, table: str) -> None:
        self.con.store.create_as(table, self.native)

    def create_view(self, view: str) -> Relation:
        self.native.createOrReplaceTempView(view)
        return self

    def to_parquet(self, path: str, **options) -> None:
        files.copy_to(self.native, path, "parquet", **options)

    def to_csv(self, path: str, **options) -> None:
        files.copy_to(self.native, path, "csv", **options)

    def explain(self) -> str:
        return self.native._jdf.queryExecution().explainString(self.con.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _plain(self) -> DataFrame:
        """The rows with calendar intervals as text, which Python can't hold otherwise."""
        if not any(isinstance(f.dataType, T.CalendarIntervalType) for f in self.native.schema):
            return self.native
        return self.native.select(*(F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.CalendarIntervalType) else F.col(f"`{f.name}`") for f in self.native.schema))

    def df(self):
        return self._plain().toPandas()

    to_df = fetchdf = df

    def arrow(self):
        return self._plain().toArrow()

    def pl(self):
        import polars

        return polars.from_arrow(self._plain().toArrow())

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self._plain().collect()]

    def _stream(self):
        if self._rows is None:
            self._rows = iter(self._plain().toLocalIterator())
        return self._rows

    def fetchone(self) -> tuple | None:
        r = next(self._stream(), None)
        return None if r is None else tuple(r)

    def fetchmany(self, n: int = 1) -> list[tuple]:
        return [tuple(r) for r, _ in zip(self._stream(), range(n), strict=False)]

    def fetchnumpy(self) -> dict:
        return {c: self.arrow().column(c).to_numpy(zero_copy_only=False) for c in self.columns}

    def fetch_record_batch(self):
        return self._plain().toArrow().to_reader()


class Connection:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store, self.macros = spark, Store(spark, folder), {}
        self.prepared: dict[str, str] = {}
        self.settings = {"threads": spark.sparkContext.defaultParallelism, "timezone": spark.conf.get("spark.sql.session.timeZone")}
        self.variables: set[str] = set()
        from tessera import share_path
        from tessera.functions import json, numbers, text

        share_path(spark)  # before functions are registered, as they carry the workers' path from then on
        for name in ("damerau_levenshtein", "jaro_similarity", "jaro_winkler_similarity", "strip_accents", "nfc_normalize", "length_grapheme", "gamma", "lgamma"):
            spark.udf.register(name, getattr(text, name))
        for name, function in {"json_pretty": json.pretty, "json_structure": json.structure, "json_contains": json.contains, "json_merge_patch": json.merge_patch, "json_type": json.kind, "nextafter": numbers.nextafter}.items():
            spark.udf.register(name, function)

    # Sources

    def table(self, name: str) -> Relation:
        return Relation(self, self.store.read(name) if name in self.store.tables else self.spark.table(name), name)

    view = table

    def values(self, *rows_, names: list[str] | None = None) -> Relation:
        data = [tuple(r) if isinstance(r, (list, tuple)) else (r,) for r in rows_]
        return Relation(self, self.spark.createDataFrame(data, names or [f"col{i}" for i in range(len(data[0]))]))

    def from_df(self, pdf) -> Relation:
        return Relation(self, self.spark.createDataFrame(pdf))

    def from_arrow(self, table) -> Relation:
        return Relation(self, self.spark.createDataFrame(table))

    def from_parquet(self, path, **options) -> Relation:
        return Relation(self, files.read_parquet(self.spark, path, **options))

    read_parquet = from_parquet

    def read_csv(self, path, **options) -> Relation:
        return Relation(self, files.read_csv(self.spark, path, **options))

    def read_json(self, path, **options) -> Relation:
        return Relation(self, files.read_json(self.spark, path, **options))

    def table_function(self, name: str, *args, **options) -> Relation:
        found = {"read_csv": files.read_csv, "read_csv_auto": files.read_csv, "read_parquet": files.read_parquet, "parquet_scan": files.read_parquet, "read_json": files.read_json, "read_json_auto": files.read_json, "read_ndjson": files.read_json, "read_json_objects": files.read_json_objects, "read_text": files.read_text, "read_blob": files.read_blob, "glob": files.glob, "parquet_metadata": files.parquet_metadata, "parquet_schema": files.parquet_schema, "parquet_kv_metadata": files.parquet_kv_metadata, "repeat_row": rows.repeat_row}
        if name in found:
            return Relation(self, found[name](self.spark, *args, **options))
        return self.sql(f"SELECT * FROM {name}({', '.join(map(repr, args))})")

    def register(self, name: str, value) -> Connection:
        df = value.native if isinstance(value, Relation) else value if isinstance(value, DataFrame) else self.spark.createDataFrame(value)
        df.createOrReplaceTempView(name)
        return self

    def unregister(self, name: str) -> Connection:
        self.spark.catalog.dropTempView(name)
        return self

    def create_function(self, name: str, function, returns, kind: str = "native") -> Connection:
        """A scalar function: native takes a row's values, arrow takes pandas series."""
        self.spark.udf.register(name, F.pandas_udf(function, returns) if kind == "arrow" else F.udf(function, returns))
        return self

    def remove_function(self, name: str) -> Connection:
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        return self

    struct_type = staticmethod(lambda fields: T.StructType([T.StructField(k, v if isinstance(v, T.DataType) else T._parse_datatype_string(v)) for k, v in fields.items()]))
    list_type = staticmethod(lambda kind: T.ArrayType(kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind)))

    def begin(self) -> Connection:
        self.store.begin()
        return self

    def commit(self) -> Connection:
        self.store.commit()
        return self

    def rollback(self) -> Connection:
        self.store.rollback()
        return self

    def cursor(self) -> Connection:
        twin = Connection(self.spark, self.store.folder)
        twin.store, twin.macros, twin.prepared, twin.settings, twin.variables = self.store, self.macros, self.prepared, self.settings, self.variables
        return twin

    def interrupt(self) -> None:
        self.spark.sparkContext.cancelAllJobs()

    # SQL

    def execute(self, sql: str, parameters=None) -> Relation:
        return self.sql(sql, parameters)

    def query(self, sql: str, parameters=None) -> Relation:
        return self.sql(sql, parameters)

    def sql(self, text: str, parameters=None) -> Relation:
        """One statement; parameters are a list for ? and $1, or a dict for $name."""
        text = text.strip().rstrip(";").strip()
        if parameters is not None:
            text, parameters = self._bound(text, parameters)
        head = re.split(r"[\s(;]", text, maxsplit=1)[0].upper()
        method = getattr(self, f"_{head.lower()}", None)
        if method and head not in ("SELECT", "WITH", "FROM", "VALUES", "SQL", "BOUND", "NEW", "QUERY"):
            done = method(text)
            if done is not None:
                return Relation(self, done if isinstance(done, DataFrame) else self.spark.range(0))
            return Relation(self, self.spark.createDataFrame([], "Success boolean"))
        return Relation(self, self._query(text, parameters))

    @staticmethod
    def _bound(text: str, parameters):
        names, count = {}, iter(range(1, 1000))

        def one(m: re.Match) -> str:
            if m[0].startswith("'"):
                return m[0]
            key = m[1] or str(next(count))
            names[f"p{key}"] = parameters[key] if isinstance(parameters, dict) else parameters[int(key) - 1]
            return f":p{key}"

        return re.sub(r"'(?:[^']|'')*'|\?|\$(\w+)", lambda m: one(m) if m[0][0] in "'?$" else m[0], text), names

    def _query(self, text: str, parameters=None) -> DataFrame:
        if re.search(r"(?i)\bDECIDE\b", re.sub(r"'(?:[^']|'')*'", "''", text)):
            df, clause, selected = self._decision(text)
            out = decide(df, clause, relations=self._relations(text))
            return self._selected(out, selected)
        if re.search(r"(?i)\bCOLUMNS\s*\(", text):
            text = self._columns(text)
        sql, step = dialect.rewrite(self._files(self._known(text)))
        if step is None:
            return self.spark.sql(sql, args=parameters) if parameters else self.spark.sql(sql)
        p = step.parts
        if step.kind == "by_name":
            return shape.union_by_name(self._query(p["left"]), self._query(p["right"]), p["all"])
        if step.kind == "percent":
            return rows.limit_percent(self.spark.sql(sql), p["percent"])
        if step.kind == "sample":
            df = self.spark.sql(sql)
            return rows.bernoulli_sample(df, p["amount"], p["seed"]) if p["percent"] else rows.reservoir_sample(df, int(p["amount"]), p["seed"])
        if step.kind == "recursive":
            base = self._query(p["base"])
            base = base.toDF(*p["columns"]) if p["columns"] else base

            def advance(last: DataFrame) -> DataFrame:
                last.createOrReplaceTempView(p["name"])
                return self._query(p["step"]).toDF(*base.columns)

            rows.recursive(base, advance).createOrReplaceTempView(p["name"])
            return self._query(p["rest"])
        left, right = self._side(p["left"]), self._side(p["right"])
        if step.kind == "positional":
            both = joins.positional_join(left[0], right[0])
        else:
            both = self._asof(left, right, p["on"], p["how"])
        both.createOrReplaceTempView("__joined")
        head = re.sub(rf"\b(?:{left[1]}|{right[1]})\.", "", p["head"])
        return self._query(f"{head} FROM __joined {re.sub(rf'\b(?:{left[1]}|{right[1]})\.', '', p['tail'])}")

    def _side(self, text: str) -> tuple[DataFrame, str]:
        m = re.match(r"(?is)^(\(.*\)|[\w.]+)(?:\s+(?:AS\s+)?(\w+))?$", text.strip())
        df = self._query(m[1][1:-1] if m[1].startswith("(") else f"SELECT * FROM {m[1]}")
        return df, m[2] or m[1]

    def _asof(self, left, right, on: str, how: str) -> DataFrame:
        by, order = [], None
        for part in re.split(r"(?i)\s+AND\s+", on):
            m = re.match(r"^\s*(?:(\w+)\.)?(\w+)\s*(>=|>|<=|<|=)\s*(?:(\w+)\.)?(\w+)\s*$", part)
            if not m:
                raise ValueError(f"an ASOF join takes comparisons of columns, not {part}")
            a, op, b = m[2], m[3], m[5]
            if m[1] == right[1] or (m[1] is None and a not in left[0].columns):
                a, b, op = b, a, {">": "<", ">=": "<=", "<": ">", "<=": ">="}.get(op, op)
            if op == "=":
                by.append((a, b))
            else:
                order = (a, b, op)
        if order is None or order[2] not in (">", ">="):
            raise ValueError("an ASOF join needs one inequality, left >= right")
        other = right[0].withColumnsRenamed({b: a for a, b in by if a != b})
        at = order[1]
        if at in left[0].columns:
            other, at = other.withColumnRenamed(at, f"{at}_right"), f"{at}_right"
        return joins.asof_join(left[0], other, order[0], at, [a for a, _ in by], how, order[2] == ">")

    def _files(self, text: str) -> str:
        """FROM 'file' and FROM read_csv('file', ...) become views."""

        def one(m: re.Match) -> str:
            name = f"__file{abs(hash(m[0])) % 10**9}"
            if m["system"]:
                df = system.listing(self, m["system"].lower())
            elif m["standard"]:
                df = system.standard(self, m["standard"].lower())
            elif m["info"]:
                df = system.table_info(self, m["info"])
            elif m["path"]:
                kind = m["path"].rsplit(".", 1)[-1].lower()
                df = files.read_csv(self.spark, m["path"]) if kind in ("csv", "tsv") else files.read_json(self.spark, m["path"]) if kind in ("json", "ndjson", "jsonl") else files.read_parquet(self.spark, m["path"])
            else:
                options = {k.strip(): _literal(v) for k, v in (o.split("=", 1) for o in (m["options"] or "").split(",") if "=" in o)}
                df = self.table_function(m["function"].lower(), m["argument"], **options).native
            df.createOrReplaceTempView(name)
            return f"{m['word']} {name}"

        lists = rf"\w+_(?P<system>{'|'.join(system.LISTINGS)})\(\s*\)|information_schema\.(?P<standard>tables|columns|schemata)\b|pragma_table_info\(\s*'(?P<info>\w+)'\s*\)"
        return re.sub(rf"(?i)(?P<word>\b(?:FROM|JOIN))\s+(?:'(?P<path>[^']+)'|{lists}|(?P<function>read_\w+|parquet_\w+|glob)\(\s*'(?P<argument>[^']+)'\s*(?:,(?P<options>[^)]*))?\))", one, text)

    def _known(self, text: str) -> str:
        """Settings, and casts and functions of the session's enums, as plain values."""

        def setting(m: re.Match) -> str:
            name = m[1].lower()
            value = self.settings[name] if name in self.settings else self.spark.conf.get(m[1], None)
            if value is None:
                raise ValueError(f"no such setting: {m[1]}")
            return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"

        text = re.sub(r"(?i)\bcurrent_setting\(\s*'([\w.]+)'\s*\)", setting, text)
        for name, labels in self.store.types.items():
            quoted = ["'" + x.replace("'", "''") + "'" for x in labels]
            whole = f"[{', '.join(quoted)}]"
            kind = rf"\s*::\s*{name}\s*"

            def part(m: re.Match, quoted=quoted) -> str:
                first, last = (None if x.upper() == "NULL" else quoted.index(x) for x in m.groups())
                return f"[{', '.join(quoted[first or 0 : len(quoted) if last is None else last + 1])}]"

            text = re.sub(rf"(?i)\benum_range_boundary\(\s*(NULL|'[^']*'){kind},\s*(NULL|'[^']*'){kind}\)", part, text)
            for function, value in (("enum_range", whole), ("enum_first", quoted[0]), ("enum_last", quoted[-1])):
                text = re.sub(rf"(?i)\b{function}\(\s*NULL{kind}\)", lambda _, value=value: value, text)
            text = re.sub(rf"(?i)\benum_code\(([^()]*?){kind}\)", lambda m, whole=whole: f"(list_position({whole}, {m[1]}) - 1)", text)
            text = re.sub(rf"(?i)(::\s*){name}\b", r"\1VARCHAR", text)
            text = re.sub(rf"(?i)\b(CAST\([^()]*\sAS\s+){name}\s*\)", r"\1VARCHAR)", text)
        return text

    def _columns(self, text: str) -> str:
        ts = dialect.tokens(text)
        source = dialect.find(ts, "FROM")
        names = self._query("SELECT * " + "".join(ts[source:])).columns

        def spread(item: str) -> str:
            m = re.search(r"(?is)COLUMNS\s*\(\s*(?:'([^']*)'|\*|(?:lambda\s+)?(\w+)\s*(?:->|:)\s*(.+?))\s*\)", item)
            if not m:
                return item
            if m[3]:
                picked = [c for c in names if self.spark.sql(f"SELECT {re.sub(rf'\b{m[2]}\b', repr(c), m[3])}").first()[0]]
            else:
                picked = [c for c in names if m[1] is None or re.search(m[1], c)]
            return ", ".join(f"{item[: m.start()]}{c}{item[m.end() :]} AS {c}" for c in picked)

        start = dialect.after(ts, 0)
        items = ["".join(p) for p in dialect.split(ts[start:source])]
        return f"SELECT {', '.join(spread(i) for i in items)} {''.join(ts[source:])}"

    # Optimisation

    def _decision(self, text: str) -> tuple[DataFrame, str, str]:
        """The input rows, the DECIDE clause and the select list, with the clause before FROM or after WHERE."""
        ts = dialect.tokens(text)
        at, source, such = dialect.find(ts, "DECIDE"), dialect.find(ts, "FROM"), dialect.find(ts, "SUCH", "THAT")
        if at < 0 or such < 0:
            raise ValueError("a query needs DECIDE and SUCH THAT")
        if source < at:
            rows_, clause = "".join(ts[source:at]), "".join(ts[at:])
            selected = "".join(ts[1:source])
        else:
            selected = "".join(ts[1:at])
            rows_, clause = "".join(ts[source:such]), "".join(ts[at:source]) + " " + "".join(ts[such:])
        tail = re.search(r"(?is)\s+(ORDER\s+BY|LIMIT)\b.*$", clause)
        if tail:
            clause = clause[: tail.start()]
        return self._query(f"SELECT * {rows_}"), clause, selected + ("|" + tail[0] if tail else "|")

    def _selected(self, df: DataFrame, selected: str) -> DataFrame:
        items, _, tail = selected.rpartition("|")
        df.createOrReplaceTempView("__decided")
        return self._query(f"SELECT {re.sub(r'\b[A-Za-z_]\w*\.(?=[A-Za-z_])', '', items)} FROM __decided {tail}")

    def _relations(self, text: str) -> dict[str, list[str]]:
        """Columns of the tables in FROM, by name and alias."""
        out = {}
        for name, alias in re.findall(r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_]\w*)(?:\s+(?:AS\s+)?([A-Za-z_]\w*))?", text):
            try:
                columns = self.spark.table(name).columns
            except Exception:  # noqa: BLE001  a CTE or subquery has no table of that name
                continue
            out[name] = columns
            if alias and alias.upper() not in (*dialect.CLAUSES, "DECIDE", "JOIN", "ON", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "ASOF", "POSITIONAL", "NATURAL", "SEMI", "ANTI"):
                out[alias] = columns
        return out

    def _diagnose(self, text: str) -> DataFrame:
        if len(re.findall(r"(?i)\bDECIDE\b", text)) != 1:
            raise ValueError("DIAGNOSE takes a query with exactly one DECIDE")
        df, clause, _ = self._decision(re.sub(r"(?is)^\s*DIAGNOSE\s+", "", text))
        return diagnose(df, clause, relations=self._relations(text))

    # Statements

    def _explain(self, text: str) -> DataFrame:
        body = re.sub(r"(?is)^EXPLAIN\s+(ANALYZE\s+)?", "", text)
        if re.search(r"(?i)\bDECIDE\b", body):
            df, clause, _ = self._decision(body)
            return self.spark.createDataFrame([("decide", explain(df, clause, self._relations(body)))], "explain_key string, explain_value string")
        return self.spark.createDataFrame([("physical_plan", Relation(self, self._query(body)).explain())], "explain_key string, explain_value string")

    def _create(self, text: str):
        m = re.match(r"(?is)^CREATE\s+(OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(TABLE|VIEW|MACRO|FUNCTION|TYPE|SEQUENCE|SCHEMA)\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*(.*)$", text)
        if not m:
            raise ValueError(f"can't read {text[:60]!r}")
        replace, kind, lenient, name, rest = bool(m[1]), m[2].upper(), bool(m[3]), m[4], m[5]
        if kind == "TABLE":
            if re.match(r"(?i)AS\b", rest):
                return self.store.create_as(name, self._query(rest[2:]), replace, lenient)
            return self._table(name, rest.strip()[1:-1], replace, lenient)
        if kind == "VIEW":
            self._query(re.sub(r"(?is)^AS\s+", "", rest)).createOrReplaceTempView(name)
        elif kind in ("MACRO", "FUNCTION"):
            p = re.match(r"(?is)^\(([^)]*)\)\s+AS\s+(TABLE\s+)?(.*)$", rest)
            returns = "RETURNS TABLE RETURN" if p[2] else "RETURN"
            body, _ = dialect.rewrite(p[3])
            params = [x.strip() for x in p[1].split(",") if x.strip()]
            self.macros[name] = (params, body, bool(p[2]))
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{re.split(r":=", x)[0].strip()} {"DOUBLE"}' + (f" DEFAULT {x.split(':=')[1].strip()}" if ":=" in x else "") for x in params)}) {returns} {body}")
        elif kind == "TYPE":
            self.store.types[name] = [x.strip().strip("'") for x in re.search(r"(?is)ENUM\s*\((.*)\)", rest)[1].split(",")]
        elif kind == "SEQUENCE":
            start, by = re.search(r"(?i)START\s+(?:WITH\s+)?(-?\d+)", rest), re.search(r"(?i)INCREMENT\s+(?:BY\s+)?(-?\d+)", rest)
            self.store.sequences[name] = [int(start[1]) if start else 1, int(by[1]) if by else 1]
        return None

    def _table(self, name: str, body: str, replace: bool, lenient: bool) -> None:
        fields, found = [], {"primary_key": [], "unique": [], "not_null": [], "checks": [], "defaults": {}, "references": []}
        listed = lambda s: [x.strip() for x in s.split(",")]
        for part in ("".join(p).strip() for p in dialect.split(dialect.tokens(body))):
            if m := re.match(r"(?is)^PRIMARY\s+KEY\s*\((.*)\)$", part):
                found["primary_key"] = listed(m[1])
            elif m := re.match(r"(?is)^UNIQUE\s*\((.*)\)$", part):
                found["unique"].append(listed(m[1]))
            elif m := re.match(r"(?is)^CHECK\s*\((.*)\)$", part):
                found["checks"].append(m[1])
            elif m := re.match(r"(?is)^FOREIGN\s+KEY\s*\((.*?)\)\s+REFERENCES\s+(\w+)\s*\((.*)\)$", part):
                found["references"].append((listed(m[1]), m[2], listed(m[3])))
            else:
                m = re.match(r"(?is)^(\w+)\s+(\w+(?:\s*\([^)]*\))?(?:\[\])*)(.*)$", part)
                column, kind, rest = m[1], m[2], m[3]
                base = kind.split("[")[0].strip()
                native = "STRING" if base in self.store.types else dialect.TYPES.get(re.sub(r"\(.*", "", base).upper(), base) if re.sub(r"\(.*", "", base).upper() in dialect.TYPES else base
                for _ in range(kind.count("[")):
                    native = f"ARRAY<{native}>"
                fields.append(T.StructField(column, T._parse_datatype_string(native)))
                if base in self.store.types:
                    found["checks"].append(f"{column} IN ({', '.join(repr(x) for x in self.store.types[base])})")
                if re.search(r"(?i)PRIMARY\s+KEY", rest):
                    found["primary_key"] = [column]
                if re.search(r"(?i)\bUNIQUE\b", rest):
                    found["unique"].append([column])
                if re.search(r"(?i)NOT\s+NULL", rest):
                    found["not_null"].append(column)
                if c := re.search(r"(?is)CHECK\s*\((.*)\)", rest):
                    found["checks"].append(c[1])
                if d := re.search(r"(?is)DEFAULT\s+('(?:[^']|'')*'|[\w.+-]+(?:\([^)]*\))?)", rest):
                    found["defaults"][column] = d[1]
                if r := re.search(r"(?is)REFERENCES\s+(\w+)\s*\((\w+)\)", rest):
                    found["references"].append(([column], r[1], [r[2]]))
        self.store.create(name, T.StructType(fields), replace, lenient, **found)

    def _insert(self, text: str):
        m = re.match(r"(?is)^INSERT\s+(OR\s+(?:REPLACE|IGNORE)\s+)?INTO\s+(\w+)\s*(\([^)]*\))?\s*(BY\s+NAME\s+)?(.*?)(?:\s+ON\s+CONFLICT\s*(\([^)]*\))?\s*DO\s+(NOTHING|UPDATE\s+SET\s+.*?))?(?:\s+RETURNING\s+(.*))?$", text)
        mode, name, columns, by_name, body, keys, action, returning = m.groups()
        names = [c.strip() for c in columns[1:-1].split(",")] if columns and not re.match(r"(?i)\(\s*(VALUES|SELECT)", columns) else None
        body = re.sub(r"(?i)nextval\(\s*'(\w+)'\s*\)", lambda x: str(self.store.nextval(x[1])), body)
        df = self._query(body)
        if mode or action:
            on = [k.strip() for k in keys[1:-1].split(",")] if keys else None
            nothing = bool(mode and "IGNORE" in mode.upper()) or bool(action and action.upper() == "NOTHING")
            update = None
            if action and not nothing:
                update = {k.strip(): v.strip() for k, v in (x.split("=", 1) for x in map("".join, dialect.split(dialect.tokens(re.sub(r"(?i)^UPDATE\s+SET\s+", "", action)))))}
            return self.store.upsert(name, df, on, update, names, nothing)
        added = self.store.insert(name, df, names, bool(by_name))
        if returning:
            added.createOrReplaceTempView("__added")
            return self._query(f"SELECT {returning} FROM __added")
        return None

    def _update(self, text: str):
        m = re.match(r"(?is)^UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+FROM\s+(.*?))?(?:\s+WHERE\s+(.*))?$", text)
        name, body, source, where = m.groups()
        values = {k.strip(): "".join(dialect.literals(dialect.tokens(v.strip()))) for k, v in (x.split("=", 1) for x in map("".join, dialect.split(dialect.tokens(body))))}
        if not source:
            return self.store.update(name, {k: F.expr(v) for k, v in values.items()}, F.expr(where) if where else None)
        own = rows.with_row_index(self.store.read(name), "__id")
        own.createOrReplaceTempView(name)
        new = self.spark.sql(f"SELECT {name}.__id AS __hit, {', '.join(f'first({v}) AS __{k}' for k, v in values.items())} FROM {name}, {source} WHERE {where or 'true'} GROUP BY 1")
        both = own.join(new, F.col("__id") == F.col("__hit"), "left")
        kept = both.select(*(F.when(F.col("__hit").isNotNull(), F.col(f"__{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in self.store.tables[name].schema))
        return self.store.replace(name, kept)

    def _delete(self, text: str):
        m = re.match(r"(?is)^DELETE\s+FROM\s+(\w+)(?:\s+USING\s+(.*?))?(?:\s+WHERE\s+(.*))?$", text)
        name, source, where = m.groups()
        if not source:
            return self.store.delete(name, F.expr(where) if where else None)
        own = rows.with_row_index(self.store.read(name), "__id")
        own.createOrReplaceTempView(name)
        gone = self.spark.sql(f"SELECT DISTINCT {name}.__id AS __gone FROM {name}, {source} WHERE {where or 'true'}")
        return self.store.replace(name, own.join(gone, F.col("__id") == F.col("__gone"), "left_anti").drop("__id"))

    def _truncate(self, text: str):
        return self.store.delete(re.match(r"(?is)^TRUNCATE\s+(?:TABLE\s+)?(\w+)", text)[1])

    def _drop(self, text: str):
        m = re.match(r"(?is)^DROP\s+(TABLE|VIEW|MACRO|FUNCTION|TYPE|SEQUENCE|SCHEMA)\s+(IF\s+EXISTS\s+)?(\w+)", text)
        kind, lenient, name = m[1].upper(), bool(m[2]), m[3]
        if kind == "TABLE":
            return self.store.drop(name, lenient)
        if kind == "VIEW":
            self.spark.catalog.dropTempView(name)
        elif kind in ("MACRO", "FUNCTION"):
            self.remove_function(name)
        elif kind in ("TYPE", "SEQUENCE"):
            (self.store.types if kind == "TYPE" else self.store.sequences).pop(name, None)
        return None

    def _alter(self, text: str):
        m = re.match(r"(?is)^ALTER\s+TABLE\s+(\w+)\s+(.*)$", text)
        name, rest = m[1], m[2]
        if a := re.match(r"(?is)^ADD\s+(?:COLUMN\s+)?(\w+)\s+(\w+)", rest):
            return self.store.alter(name, add={a[1]: dialect.TYPES.get(a[2].upper(), a[2])})
        if a := re.match(r"(?is)^DROP\s+(?:COLUMN\s+)?(\w+)", rest):
            return self.store.alter(name, drop=[a[1]])
        if a := re.match(r"(?is)^RENAME\s+(?:COLUMN\s+)?(\w+)\s+TO\s+(\w+)", rest):
            return self.store.alter(name, rename={a[1]: a[2]})
        if a := re.match(r"(?is)^ALTER\s+(?:COLUMN\s+)?(\w+)\s+(?:SET\s+DATA\s+)?TYPE\s+(\w+)", rest):
            return self.store.alter(name, retype={a[1]: dialect.TYPES.get(a[2].upper(), a[2])})
        raise ValueError(f"can't read {text[:60]!r}")

    def _copy(self, text: str):
        m = re.match(r"(?is)^COPY\s+(\(.*\)|\w+)\s+(TO|FROM)\s+'([^']+)'\s*(?:\((.*)\))?$", text)
        options = {}
        for o in map("".join, dialect.split(dialect.tokens(m[4] or ""))):
            if o.strip():
                k, _, v = o.strip().partition(" ")
                options[k.lower()] = v.strip().strip("'") or "true"
        kind = options.get("format", m[3].rsplit(".", 1)[-1]).lower()
        if m[2].upper() == "FROM":
            df = files.read_csv(self.spark, m[3]) if kind == "csv" else files.read_json(self.spark, m[3]) if kind == "json" else files.read_parquet(self.spark, m[3])
            self.store.insert(m[1], df)
            return None
        df = self._query(m[1][1:-1] if m[1].startswith("(") else f"SELECT * FROM {m[1]}")
        parts = [p.strip() for p in options.get("partition_by", "").strip("()").split(",") if p.strip()] or None
        return files.copy_to(df, m[3], kind, parts, options.get("compression") or options.get("codec"), options.get("header", "true").lower() in ("true", "1"), options.get("delimiter", ","), "overwrite" in options or "overwrite_or_ignore" in options, "return_files" in options)

    def _export(self, text: str):
        return self.store.export(re.search(r"'([^']+)'", text)[1])

    def _import(self, text: str):
        folder = re.search(r"'([^']+)'", text)[1]
        names = [r["file"].rsplit("/", 1)[-1].removesuffix(".parquet") for r in files.glob(self.spark, f"{folder}/*.parquet").collect()]
        return self.store.load(folder, names)

    def _summarize(self, text: str) -> DataFrame:
        body = re.sub(r"(?is)^SUMMARIZE\s+", "", text)
        return summarize(self._query(body if re.match(r"(?i)(SELECT|FROM|WITH)\b", body) else f"SELECT * FROM {body}"))

    def _describe(self, text: str) -> DataFrame:
        body = re.sub(r"(?is)^DESCRIBE\s+", "", text)
        df = self._query(body if re.match(r"(?i)(SELECT|FROM|WITH)\b", body) else f"SELECT * FROM {body}")
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), "YES") for f in df.schema], "column_name string, column_type string, `null` string")

    def _show(self, text: str) -> DataFrame:
        if re.match(r"(?i)^SHOW\s+(ALL\s+)?TABLES", text):
            return self.spark.createDataFrame(sorted({(t.name,) for t in self.spark.catalog.listTables() if not t.name.startswith("__")}), "name string")
        return self.spark.sql(text)

    def _pivot(self, text: str) -> DataFrame:
        m = re.match(r"(?is)^PIVOT\s+(\(.*?\)|\w+)\s+ON\s+(\w+)(?:\s+IN\s*\((.*?)\))?\s+USING\s+(.*?)(?:\s+GROUP\s+BY\s+(.*))?$", text)
        df = self._query(m[1][1:-1] if m[1].startswith("(") else f"SELECT * FROM {m[1]}")
        using = {}
        for item in ("".join(p).strip() for p in dialect.split(dialect.tokens(m[4]))):
            a = re.match(r"(?is)^(.*?)(?:\s+AS\s+(\w+))?$", item)
            using[a[2] or a[1]] = F.expr("".join(dialect.literals(dialect.tokens(a[1]))).replace("count(*)", "count(1)"))
        used = set(re.findall(r"\w+", m[4])) | {m[2]}
        group = [g.strip() for g in m[5].split(",")] if m[5] else [c for c in df.columns if c not in used]
        return shape.pivot(df, m[2], using, group, [_literal(v) for v in m[3].split(",")] if m[3] else None)

    def _unpivot(self, text: str) -> DataFrame:
        m = re.match(r"(?is)^UNPIVOT\s+(?:(INCLUDE)\s+NULLS\s+)?(\(.*?\)|\w+)\s+ON\s+(.*?)\s+INTO\s+NAME\s+(\w+)\s+VALUE\s+(\w+)$", text)
        df = self._query(m[2][1:-1] if m[2].startswith("(") else f"SELECT * FROM {m[2]}")
        found = re.match(r"(?is)^COLUMNS\(\s*\*\s+EXCLUDE\s*\(?([^)]*?)\)?\s*\)$", m[3])
        columns = [c for c in df.columns if c not in [x.strip() for x in found[1].split(",")]] if found else [c.strip() for c in m[3].split(",")]
        return shape.unpivot(df, [c for c in df.columns if c not in columns], columns, m[4], m[5], bool(m[1]))

    def _set(self, text: str):
        m = re.match(r"(?is)^SET\s+(?:VARIABLE\s+)?([\w.]+)\s*(?:=|TO)\s*(.*)$", text)
        if re.match(r"(?i)^SET\s+VARIABLE", text):
            self.spark.sql(f"DECLARE OR REPLACE VARIABLE {m[1]} = {m[2]}")
            self.variables.add(m[1])
        elif m[1].startswith("spark."):
            self.spark.conf.set(m[1], str(_literal(m[2])))
        elif m[1].lower() in ("threads", "memory_limit", "preserve_insertion_order", "enable_progress_bar"):
            self.settings[m[1].lower()] = _literal(m[2])  # kept to be read; Spark's own resources are set when it starts
        else:
            raise ValueError(f"no such setting: {m[1]}")

    def _begin(self, text: str):
        self.store.begin()

    def _commit(self, text: str):
        self.store.commit()

    def _rollback(self, text: str):
        self.store.rollback()

    def _prepare(self, text: str):
        m = re.match(r"(?is)^PREPARE\s+(\w+)\s+AS\s+(.*)$", text)
        self.prepared[m[1]] = m[2]

    def _execute(self, text: str):
        m = re.match(r"(?is)^EXECUTE\s+(\w+)\s*(?:\((.*)\))?$", text)
        values = [_literal(v) for v in map("".join, dialect.split(dialect.tokens(m[2] or ""))) if v.strip()]
        return self.sql(self.prepared[m[1]], values).native

    def _vacuum(self, text: str):
        return None

    _checkpoint = _analyze = _load = _install = _vacuum

    def _comment(self, text: str):
        m = re.match(r"(?is)^COMMENT\s+ON\s+TABLE\s+(\w+)\s+IS\s+(.*)$", text)
        self.store.tables[m[1]].comment = _literal(m[2])


def _literal(text: str):
    text = text.strip()
    if text.startswith("'"):
        return text[1:-1].replace("''", "'")
    if text.lower() in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text.lower()]
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text
