"""JSON text functions."""

from __future__ import annotations

import json as _json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path(text: str) -> str:
    """A JSONPath for a JSONPath, a pointer (/a/0) or a bare key."""
    if text.startswith("$"):
        return text
    if text.startswith("/"):
        return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in (x.replace("~1", "/").replace("~0", "~") for x in text[1:].split("/")))
    return f"$['{text}']"


def extract_string(s: Column, at: str) -> Column:
    return F.get_json_object(s, path(at))


def valid(s: Column) -> Column:
    return F.when(s.isNotNull(), F.try_parse_json(s).isNotNull())


def extract(s: Column, at: str) -> Column:
    """The value as JSON text."""
    return F.to_json(F.try_variant_get(F.try_parse_json(s), re.sub(r"\['([A-Za-z_]\w*)'\]", r".\1", path(at)), "variant"))


def exists(s: Column, at: str) -> Column:
    return F.when(s.isNotNull(), extract(s, at).isNotNull())


def keys(s: Column) -> Column:
    return F.json_object_keys(s)


def array_length(s: Column) -> Column:
    return F.json_array_length(s)


def minify(s: Column) -> Column:
    return F.to_json(F.parse_json(s))


@F.pandas_udf(T.BooleanType())
def contains(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y) -> bool:
        if x == y and type(x) is type(y):
            return True
        if isinstance(x, dict):
            return (isinstance(y, dict) and all(k in x and one(x[k], v) for k, v in y.items())) or any(one(v, y) for v in x.values())
        return isinstance(x, list) and ((isinstance(y, list) and all(any(one(v, w) for v in x) for w in y)) or any(one(v, y) for v in x))

    return pd.Series([None if x is None or y is None else one(_json.loads(x), _json.loads(y)) for x, y in zip(a, b, strict=True)], dtype="boolean")


@F.pandas_udf(T.StringType())
def merge_patch(a: pd.Series, b: pd.Series) -> pd.Series:
    """RFC 7396."""

    def one(x, y):
        if not isinstance(y, dict):
            return y
        out = dict(x) if isinstance(x, dict) else {}
        for k, v in y.items():
            if v is None:
                out.pop(k, None)
            else:
                out[k] = one(out.get(k), v)
        return out

    return pd.Series([None if x is None or y is None else _json.dumps(one(_json.loads(x), _json.loads(y)), separators=(",", ":"), ensure_ascii=False) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def pretty(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _json.dumps(_json.loads(x), indent=4, ensure_ascii=False))


@F.pandas_udf(T.StringType())
def kind(s: pd.Series) -> pd.Series:
    """json_type: OBJECT, ARRAY, VARCHAR, BOOLEAN, NULL, UBIGINT, BIGINT or DOUBLE."""

    def one(v) -> str:
        if isinstance(v, bool):
            return "BOOLEAN"
        if isinstance(v, int):
            return "UBIGINT" if v >= 0 else "BIGINT"
        return {dict: "OBJECT", list: "ARRAY", str: "VARCHAR", float: "DOUBLE", type(None): "NULL"}[type(v)]

    return s.map(lambda x: None if x is None else one(_json.loads(x)))


def _merged(a, b):
    """One structure that fits two values; "JSON" where none does."""
    if a == b or b == "NULL":
        return a
    if a == "NULL":
        return b
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _merged(a.get(k, "NULL"), b.get(k, "NULL")) for k in {**a, **b}}
    if isinstance(a, list) and isinstance(b, list):
        return [_merged(a[0], b[0])]
    if isinstance(a, str) and isinstance(b, str) and {a, b} <= {"UBIGINT", "BIGINT", "HUGEINT", "DOUBLE"}:
        return "DOUBLE" if "DOUBLE" in (a, b) else "HUGEINT"
    return "JSON"


def _structure(v):
    if isinstance(v, dict):
        return {k: _structure(x) for k, x in v.items()}
    if isinstance(v, list):
        out = "NULL"
        for x in v:
            out = _merged(out, _structure(x))
        return [out]
    if isinstance(v, bool):
        return "BOOLEAN"
    if isinstance(v, int):
        return "UBIGINT" if 0 <= v < 1 << 64 else "BIGINT" if -(1 << 63) <= v < 0 else "DOUBLE"
    return {str: "VARCHAR", float: "DOUBLE", type(None): "NULL"}[type(v)]


def _written(s):
    """A structure to print: an object without fields is JSON."""
    if isinstance(s, dict):
        return {k: _written(x) for k, x in s.items()} if s else "JSON"
    return [_written(s[0])] if isinstance(s, list) else s


@F.pandas_udf(T.StringType())
def structure(s: pd.Series) -> pd.Series:
    """json_structure: the types of a document's parts."""
    return s.map(lambda x: None if x is None else _json.dumps(_written(_structure(_json.loads(x))), separators=(",", ":"), ensure_ascii=False))
