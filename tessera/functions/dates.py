"""Dates, timestamps and intervals. Timestamps without zone are taken as UTC; set the session's time zone to UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strftime codes and their date_format letters.
CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%g": "SSS", "%y": "yy", "%j": "DDD", "%I": "hh", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%-d": "d", "%-m": "M", "%-H": "H", "%-I": "h", "%z": "xx", "%Z": "zzz", "%%": "'%'"}

SECONDS = {"microsecond": 1e-6, "millisecond": 1e-3, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def pattern(code: str) -> str:
    """A date_format pattern for a strftime one."""
    pieces = re.split(r"(%-?[A-Za-z%])", code)
    unknown = [p for p in pieces if p.startswith("%") and p not in CODES]
    if unknown:
        raise ValueError(f"format codes not supported: {unknown}")
    return "".join(CODES[p] if p in CODES else re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", p.replace("'", "''")) for p in pieces)


def strftime(t: Column, code: str) -> Column:
    return F.date_format(t, pattern(code))


def strptime(s: Column, *codes: str) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(pattern(c))) for c in codes)).cast("timestamp_ntz")


def date_diff(part: str, a: Column, b: Column) -> Column:
    """Boundaries of the part that lie between a and b; weeks are whole sevens of days."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if part in ("year", "decade", "century", "millennium"):
        n = {"year": 1, "decade": 10, "century": 100, "millennium": 1000}[part]
        return (F.floor(F.year(b) / n) - F.floor(F.year(a) / n)).cast("bigint")
    if part == "quarter":
        return ((F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)).cast("bigint")
    if part == "month":
        return months.cast("bigint")
    if part == "day":
        return F.datediff(b, a).cast("bigint")
    if part == "week":
        return (F.datediff(b, a) / 7).cast("bigint")
    unit = int(SECONDS[part] * 1_000_000)
    return (F.floor(micros(b) / unit) - F.floor(micros(a) / unit)).cast("bigint")


def date_sub(part: str, a: Column, b: Column) -> Column:
    """Whole units of the part between a and b."""
    if part in SECONDS:
        return ((micros(b) - micros(a)) / int(SECONDS[part] * 1_000_000)).cast("bigint")
    n = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}[part]
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    clock = lambda t: F.dayofmonth(t) * 86_400_000_000 + micros(t) % 86_400_000_000
    end = lambda t: F.dayofmonth(t) == F.dayofmonth(F.last_day(t))
    early = (clock(b) < clock(a)) & ~(end(b) & (F.dayofmonth(b) < F.dayofmonth(a)) & (micros(b) % 86_400_000_000 >= micros(a) % 86_400_000_000))
    late = (clock(b) > clock(a)) & ~(end(a) & (F.dayofmonth(a) < F.dayofmonth(b)))
    whole = F.when((months > 0) & early, months - 1).when((months < 0) & late, months + 1).otherwise(months)
    return (whole / n).cast("bigint")


def dayofweek(t: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(t) - 1).cast("bigint")


def isodow(t: Column) -> Column:
    return (F.weekday(t) + 1).cast("bigint")


def isoyear(t: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), t).cast("bigint")


def yearweek(t: Column) -> Column:
    return isoyear(t) * 100 + F.weekofyear(t)


def century(t: Column) -> Column:
    return F.floor((F.year(t) - 1) / 100) + 1


def decade(t: Column) -> Column:
    return F.floor(F.year(t) / 10)


def millennium(t: Column) -> Column:
    return F.floor((F.year(t) - 1) / 1000) + 1


def epoch(t: Column) -> Column:
    return micros(t) / 1e6


def julian(t: Column) -> Column:
    return F.unix_date(t.cast("date")) + 2440588 + (micros(t) % 86_400_000_000) / 86_400_000_000


def dayname(t: Column) -> Column:
    return F.date_format(t, "EEEE")


def monthname(t: Column) -> Column:
    return F.date_format(t, "MMMM")


def time_bucket(width_us: int, t: Column, origin_us: int = 946_857_600_000_000) -> Column:
    """Start of the bucket; buckets count from the origin, 2000-01-03 by default."""
    return F.timestamp_micros(((F.floor((micros(t) - origin_us) / width_us)) * width_us + origin_us).cast("bigint")).cast("timestamp_ntz")


def time_bucket_months(months: int, t: Column) -> Column:
    """Buckets of whole months, counted from January 2000."""
    at = F.floor(((F.year(t) - 2000) * 12 + F.month(t) - 1) / months) * months
    return F.add_months(F.lit("2000-01-01").cast("date"), at.cast("int")).cast("timestamp_ntz")


def age(a: Column, b: Column) -> Column:
    """a - b as a struct of months, days and microseconds, for a >= b."""
    months = date_sub("month", b, a)
    anchor = F.add_months(b.cast("date"), months.cast("int"))
    rest = micros(a) - (F.unix_date(anchor) * F.lit(86_400_000_000) + micros(b) % 86_400_000_000)
    return F.struct(months.alias("months"), F.floor(rest / 86_400_000_000).alias("days"), (rest % 86_400_000_000).alias("micros"))
