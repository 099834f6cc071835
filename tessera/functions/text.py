"""String functions."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def concat(*parts: Column) -> Column:
    """concat: nulls are skipped."""
    return F.concat_ws("", *(p.cast("string") for p in parts))


def unicode(s: Column) -> Column:
    """Code point of the first character, -1 for an empty string."""
    bytes_ = F.hex(F.encode(F.substring(s, 1, 1), "UTF-32"))
    return F.when(s == "", -1).otherwise(F.conv(bytes_, 16, 10).cast("int"))


def chr(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")


def left(s: Column, n: int) -> Column:
    """The first n characters; all but the last -n for a negative n."""
    return F.left(s, F.lit(n)) if n >= 0 else F.left(s, F.greatest(F.char_length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n)) if n >= 0 else F.right(s, F.greatest(F.char_length(s) + n, F.lit(0)))


def string_split(s: Column, sep: str) -> Column:
    """Split at a literal separator."""
    return F.split(s, re.escape(sep)) if sep else F.split(s, "")


def glob(s: Column, pattern: str) -> Column:
    """GLOB: * ? and [...] over the whole string."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out += "[" + pattern[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return s.rlike(f"(?s)^{out}$")


def similar_to(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})$")


def regexp_matches(s: Column, pattern: str, options: str = "") -> Column:
    flags = "".join(f for f in options if f in "is")
    return s.rlike((f"(?{flags})" if flags else "") + pattern)


def regexp_replace(s: Column, pattern: str, replacement: str, options: str = "") -> Column:
    r"""The first match only, unless options have g; \1 in the replacement is a group."""
    flags = "(?i)" if "i" in options else ""
    text = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
    if "g" in options:
        return F.regexp_replace(s, flags + pattern, text)
    shifted = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 2}" if int(m[1]) else "$2", text)
    return F.regexp_replace(s, f"(?s){flags}^(.*?)({pattern})", "$1" + shifted)


def regexp_extract(s: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(s, pattern, group)


def to_base(n: Column, radix: int, length: int = 0) -> Column:
    digits = F.conv(n.cast("string"), 10, radix)
    return F.when(F.length(digits) < length, F.lpad(digits, length, "0")).otherwise(digits) if length else digits


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def hamming(a: Column, b: Column) -> Column:
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return F.size(F.filter(pairs, lambda p: p["x"] != p["y"])).cast("bigint")


def format_text(pattern: str, *args: Column) -> Column:
    """format: {} in turn, {0} by position."""
    pieces, k, out = re.split(r"(\{\d*\})", pattern), 0, []
    for piece in pieces:
        if re.fullmatch(r"\{\d*\}", piece):
            out.append(args[int(piece[1:-1]) if piece != "{}" else k].cast("string"))
            k += 1
        elif piece:
            out.append(F.lit(piece.replace("{{", "{").replace("}}", "}")))
    return F.concat(*out)


def format_bytes(n: Column, decimal: bool = False) -> Column:
    base, units = (1000, ["kB", "MB", "GB", "TB", "PB"]) if decimal else (1024, ["KiB", "MiB", "GiB", "TiB", "PiB"])
    out = F.when(n == 1, F.concat(n.cast("string"), F.lit(" byte"))).when(F.abs(n) < base, F.concat(n.cast("string"), F.lit(" bytes")))
    for i, unit in enumerate(units, 1):
        size = F.concat(F.format_string("%.1f", F.floor(n / float(base**i) * 10) / 10.0), F.lit(" " + unit))
        out = out.when(F.abs(n) < base ** (i + 1), size) if i < len(units) else out.otherwise(size)
    return out


def parse_filename(path: Column, trim_extension: bool = False) -> Column:
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "") if trim_extension else name


def parse_dirpath(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def parse_dirname(path: Column) -> Column:
    pieces = F.split(path, r"[/\\]")
    return F.when(F.size(pieces) > 1, pieces[0]).otherwise("")


def url_encode(s: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_decode(s: Column) -> Column:
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def md5_number(s: Column, half: str) -> Column:
    at = {"upper": 1, "lower": 17}[half]
    swapped = F.concat(*(F.substring(F.md5(s), at + 2 * i, 2) for i in reversed(range(8))))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def bar(x: Column, low: float, high: float, width: int = 80) -> Column:
    """A bar of eighths of a block."""
    eighths = F.floor(F.greatest(F.lit(0.0), F.least((x - low) / (high - low), F.lit(1.0))) * width * 8).cast("int")
    rest = F.element_at(F.array(*(F.lit(c) for c in [" ", "▏", "▎", "▍", "▌", "▋", "▊", "▉"])), eighths % 8 + 1)
    full = F.repeat(F.lit("█"), F.floor(eighths / 8).cast("int"))
    return F.rpad(F.when(eighths % 8 > 0, F.concat(full, rest)).otherwise(full), width, " ")


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def nfc_normalize(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.LongType())
def length_grapheme(s: pd.Series) -> pd.Series:
    import regex

    return s.map(lambda x: None if x is None else len(regex.findall(r"\X", x)))


@F.pandas_udf(T.LongType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _transposing_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def _transposing_distance(x: str, y: str) -> int:
    """Edits, insertions, deletions and transpositions, the latter also of characters that are later edited apart."""
    big = len(x) + len(y)
    rows = [[big] * (len(y) + 2)] + [[big, i] + [0] * len(y) for i in range(len(x) + 1)]
    rows[1][1:] = range(len(y) + 1)
    seen: dict[str, int] = {}
    for i, c in enumerate(x, 1):
        match = 0
        for j, d in enumerate(y, 1):
            k, before = seen.get(d, 0), match
            match = j if c == d else match
            rows[i + 1][j + 1] = min(rows[i][j] + (c != d), rows[i + 1][j] + 1, rows[i][j + 1] + 1, rows[k][before] + i - k + j - before - 1)
        seen[c] = i
    return rows[-1][-1]


@F.pandas_udf(T.DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        j = _jaro(x, y)
        same = next((i for i, (c, d) in enumerate(zip(x[:4], y[:4])) if c != d), min(4, len(x), len(y)))
        return j + same * 0.1 * (1 - j) if j > 0.7 else j

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _jaro(x: str, y: str) -> float:
    if not x and not y:
        return 1.0
    reach, used, left = max(max(len(x), len(y)) // 2 - 1, 0), [False] * len(y), []
    for i, c in enumerate(x):
        for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
            if not used[j] and y[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    swaps = sum(c != d for c, d in zip(left, (y[j] for j in range(len(y)) if used[j]), strict=True)) // 2
    m = len(left)
    return (m / len(x) + m / len(y) + (m - swaps) / m) / 3


@F.pandas_udf(T.DoubleType())
def gamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.gamma(v) if v > 0 or v != int(v) else math.nan)


@F.pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma)
