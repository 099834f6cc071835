"""Managed tables as sets of Parquet folders: inserts add a folder, changes write a new one, readers see the last committed set."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConstraintError(ValueError):
    """A row that breaks a constraint of its table."""


@dataclass
class Table:
    schema: T.StructType
    folders: list[str] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    references: list[tuple[list[str], str, list[str]]] = field(default_factory=list)
    comment: str | None = None


class Store:
    """Tables, sequences, macros and enums of a session, under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables: dict[str, Table] = {}
        self.sequences: dict[str, list[int]] = {}
        self.types: dict[str, list[str]] = {}
        self.undo: dict[str, Table | None] | None = None

    def read(self, name: str) -> DataFrame:
        t = self.tables[name]
        return self.spark.read.schema(t.schema).parquet(*t.folders) if t.folders else self.spark.createDataFrame([], t.schema)

    def publish(self, name: str, folders: list[str], schema: T.StructType | None = None) -> None:
        old = self.tables[name]
        if self.undo is not None and name not in self.undo:
            self.undo[name] = Table(**{**old.__dict__, "folders": list(old.folders)})
        self.tables[name] = Table(**{**old.__dict__, "folders": folders, "schema": schema or old.schema})
        self.read(name).createOrReplaceTempView(name)

    def write(self, name: str, df: DataFrame) -> str:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def create(self, name: str, schema: T.StructType, replace: bool = False, if_not_exists: bool = False, **constraints) -> None:
        if name in self.tables and not replace:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        if self.undo is not None and name not in self.undo:
            self.undo[name] = self.tables.get(name)
        self.tables[name] = Table(T.StructType([T.StructField(f.name, f.dataType) for f in schema]), **constraints)
        self.publish(name, [])

    def create_as(self, name: str, df: DataFrame, replace: bool = False, if_not_exists: bool = False) -> None:
        if name in self.tables and if_not_exists and not replace:
            return
        path = self.write(name, df)
        self.create(name, df.schema, replace)
        self.publish(name, [path])

    def fitted(self, name: str, df: DataFrame, columns: list[str] | None, by_name: bool) -> DataFrame:
        """df's columns in the table's order and types; absent ones by default."""
        t = self.tables[name]
        given = df.columns if by_name else columns or [f.name for f in t.schema][: len(df.columns)]
        if len(given) != len(df.columns) or set(given) - {f.name for f in t.schema}:
            raise ValueError(f"{name} has no such columns: {given}")
        named = df.toDF(*given)
        return named.select(*((F.col(f"`{f.name}`") if f.name in given else F.expr(t.defaults.get(f.name, "null"))).cast(f.dataType).alias(f.name) for f in t.schema))

    def verify(self, name: str, whole: DataFrame, added: DataFrame) -> None:
        """Constraints over the rows that come in, and keys over all rows; each is one aggregate."""
        t = self.tables[name]
        rules = [(F.col(c).isNull(), f"{c} is NULL") for c in {*t.not_null, *t.primary_key}] + [(~F.expr(f"coalesce(({c}), true)"), f"CHECK {c}") for c in t.checks]
        if rules:
            counts = added.agg(*(F.count_if(bad).alias(f"c{i}") for i, (bad, _) in enumerate(rules))).first()
            for n, (_, what) in zip(counts, rules, strict=True):
                if n:
                    raise ConstraintError(f"{name}: {what} in {n} rows")
        for keys in [*([t.primary_key] if t.primary_key else []), *t.unique]:
            known = whole.where(" and ".join(f"`{k}` is not null" for k in keys))
            if not known.groupBy(*keys).count().where("count > 1").isEmpty():
                raise ConstraintError(f"{name}: the key ({', '.join(keys)}) is repeated")
        for own, other, theirs in t.references:
            parent = self.read(other).select(*(F.col(c).alias(f"__{c}") for c in theirs))
            on = [F.col(a) == F.col(f"__{b}") for a, b in zip(own, theirs, strict=True)]
            if not added.where(" and ".join(f"`{k}` is not null" for k in own)).join(parent, on, "left_anti").isEmpty():
                raise ConstraintError(f"{name}: ({', '.join(own)}) has values that {other} lacks")

    def insert(self, name: str, df: DataFrame, columns: list[str] | None = None, by_name: bool = False) -> DataFrame:
        """Adds rows and returns them, for RETURNING."""
        path = self.write(name, self.fitted(name, df, columns, by_name))
        added = self.spark.read.schema(self.tables[name].schema).parquet(path)
        self.verify(name, self.read(name).unionByName(added), added)
        self.publish(name, [*self.tables[name].folders, path])
        return added

    def upsert(self, name: str, df: DataFrame, keys: list[str] | None = None, update: dict[str, str] | None = None, columns: list[str] | None = None, nothing: bool = False) -> None:
        """ON CONFLICT (keys) DO UPDATE SET update, or DO NOTHING. In update expressions, excluded.c is the new value."""
        t = self.tables[name]
        keys = keys or t.primary_key or (t.unique[0] if t.unique else [])
        if not keys:
            raise ValueError(f"{name} has no key to conflict on")
        fresh = self.fitted(name, df, columns, False)
        if not fresh.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ConstraintError("ON CONFLICT can't meet the same row twice")
        old, names = self.read(name), [f.name for f in t.schema]
        if nothing:
            return None if fresh is None else self.publish(name, [*t.folders, self.write(name, fresh.join(old.select(*keys), keys, "left_anti").select(*names))])
        update = update if update is not None else {c: f"excluded.{c}" for c in names if c not in keys}
        both = old.alias("t").join(fresh.alias("excluded"), [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in keys], "full")
        hit, new = F.col(f"excluded.{keys[0]}").isNotNull() & F.col(f"t.{keys[0]}").isNotNull(), F.col(f"t.{keys[0]}").isNull()
        qualified = {c: F.expr(re.sub(r"(?<![\w.])(" + "|".join(map(re.escape, names)) + r")\b(?!\s*\()", r"t.\1", u)) for c, u in update.items()}
        out = both.select(*(F.when(new, F.col(f"excluded.{c}")).when(hit, qualified.get(c, F.col(f"t.{c}"))).otherwise(F.col(f"t.{c}")).cast(t.schema[c].dataType).alias(c) for c in names))
        self.replace(name, out)
        return None

    def replace(self, name: str, df: DataFrame) -> None:
        path = self.write(name, df)
        whole = self.spark.read.schema(self.tables[name].schema).parquet(path)
        self.verify(name, whole, whole)
        self.publish(name, [path])

    def update(self, name: str, values: dict[str, Column], where: Column | None = None) -> None:
        t, hit = self.tables[name], where if where is not None else F.lit(True)
        self.replace(name, self.read(name).select(*(F.when(hit, values[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in t.schema)))

    def delete(self, name: str, where: Column | None = None) -> None:
        """Rows for which the condition is true; all without one."""
        if where is None:
            self.publish(name, [])
        else:
            self.replace(name, self.read(name).where(~F.coalesce(where, F.lit(False))))

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self.tables:
            if if_exists:
                return
            raise ValueError(f"no table {name}")
        if self.undo is not None and name not in self.undo:
            self.undo[name] = self.tables[name]
        del self.tables[name]
        self.spark.catalog.dropTempView(name)

    def alter(self, name: str, add: dict[str, str] | None = None, drop: list[str] = [], rename: dict[str, str] | None = None, retype: dict[str, str] | None = None) -> None:  # noqa: B006
        df = self.read(name)
        for c, kind in (add or {}).items():
            df = df.withColumn(c, F.lit(None).cast(kind))
        df = df.drop(*drop).withColumnsRenamed(rename or {})
        for c, kind in (retype or {}).items():
            df = df.withColumn(c, F.col(c).cast(kind))
        path = self.write(name, df)
        self.publish(name, [path], df.schema)

    def begin(self) -> None:
        if self.undo is not None:
            raise ValueError("a transaction is open")
        self.undo = {}

    def commit(self) -> None:
        self.undo = None

    def rollback(self) -> None:
        for name, old in (self.undo or {}).items():
            if old is None:
                self.tables.pop(name, None)
                self.spark.catalog.dropTempView(name)
            else:
                self.tables[name] = old
                self.read(name).createOrReplaceTempView(name)
        self.undo = None

    def nextval(self, name: str) -> int:
        state = self.sequences[name]
        value = state[0]
        state[0] += state[1]
        return value

    def export(self, folder: str) -> None:
        for name in self.tables:
            self.read(name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    def load(self, folder: str, names: list[str]) -> None:
        for name in names:
            self.create_as(name, self.spark.read.parquet(f"{folder}/{name}.parquet"), replace=True)


def summarize(df: DataFrame) -> DataFrame:
    """A row for each column: type, min, max, distinct count (approximate), mean, deviation, quartiles, count and share of nulls; one pass."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    text = lambda c: c.cast("string")
    aggs = []
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        plain = isinstance(f.dataType, T.AtomicType)
        aggs += [(text(F.min(c)) if plain else F.lit(None).cast("string")).alias(f"min{i}"), (text(F.max(c)) if plain else F.lit(None).cast("string")).alias(f"max{i}"), (F.approx_count_distinct(c) if plain else F.lit(None).cast("bigint")).alias(f"u{i}"), F.count(c).alias(f"n{i}")]
        for k, x in (("avg", F.avg(c)), ("std", F.stddev(c)), ("q25", F.percentile_approx(c, 0.25)), ("q50", F.percentile_approx(c, 0.5)), ("q75", F.percentile_approx(c, 0.75))) if f.name in numeric else ():
            aggs.append(text(x).alias(f"{k}{i}"))
    r = df.agg(F.count("*").alias("rows"), *aggs).first().asDict()
    rows = [(f.name, f.dataType.simpleString(), r[f"min{i}"], r[f"max{i}"], r[f"u{i}"], *(r.get(f"{k}{i}") for k in ("avg", "std", "q25", "q50", "q75")), r["rows"], round(100.0 * (r["rows"] - r[f"n{i}"]) / r["rows"], 2) if r["rows"] else None) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, min string, max string, approx_unique bigint, avg string, std string, q25 string, q50 string, q75 string, count bigint, null_percentage double")
