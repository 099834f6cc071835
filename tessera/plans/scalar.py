"""Queries for scalar functions, a family at a time, over columns of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.catalogue import query, table
from tessera.functions import dates as D
from tessera.functions import json as J
from tessera.functions import nested as L
from tessera.functions import numbers as N
from tessera.functions import text as T


def pack(name: str, source: str, key: str, columns: dict[str, tuple[Callable[[], Column] | str, str]]) -> None:
    """Registers a query of the key and the named columns, each given as a function that makes the Column (or as Spark SQL) and as DuckDB SQL."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, *((F.expr(c) if isinstance(c, str) else c()).alias(n) for n, (c, _) in columns.items()))

    run.__name__ = name
    query(f"SELECT {key}, {', '.join(f'{sql} AS {n}' for n, (_, sql) in columns.items())} FROM {source}")(run)


def text(l: Column) -> Column:
    return F.array_join(F.transform(l, lambda x: x.cast("string")), ",", "NULL")


def s(sql: str) -> tuple[str, str]:
    """Both engines read the same."""
    return sql, sql


name = lambda: F.col("p_name")
brand = lambda: F.col("p_brand")
size = lambda: F.col("p_size")
pack("string_case", "part", "p_partkey", {"u": s("upper(p_name)"), "l": s("lower(p_brand)"), "n": ("cast(char_length(p_name) as bigint)", "length(p_name)"), "o": ("cast(octet_length(p_name) as bigint)", "strlen(p_name)"), "b": ("cast(bit_length(p_name) as bigint)", "bit_length(p_name)"), "r": s("reverse(p_name)"), "rp": s("repeat(p_type, 2)"), "rl": s("replace(p_name, 'i', '_')"), "t": s("translate(p_name, 'abc', 'xyz')")})
pack("string_slices", "part", "p_partkey", {"l": (lambda: T.left(name(), 3), "left(p_name, 3)"), "ln": (lambda: T.left(name(), -3), "left(p_name, -3)"), "r": (lambda: T.right(name(), 4), "right(p_name, 4)"), "rn": (lambda: T.right(name(), -4), "right(p_name, -4)"), "s": s("substring(p_name, 2, 3)"), "sn": s("substring(p_name, -3, 2)"), "lp": s("lpad(p_type, 12, '*')"), "rp": s("rpad(p_type, 4, '*')"), "tr": ("trim(BOTH 'sd' FROM p_name)", "trim(p_name, 'sd')"), "lt": ("trim(LEADING 's' FROM p_name)", "ltrim(p_name, 's')"), "rt": ("trim(TRAILING 't' FROM p_name)", "rtrim(p_name, 't')"), "sp": s("split_part(p_name, ' ', 2)"), "spn": s("split_part(p_name, ' ', -1)")})
pack("string_search", "part", "p_partkey", {"i": ("cast(instr(p_name, 'r') as bigint)", "instr(p_name, 'r')"), "c": s("contains(p_name, 'red')"), "sw": (lambda: name().startswith("sm"), "starts_with(p_name, 'sm')"), "ew": (lambda: name().endswith("t"), "suffix(p_name, 't')"), "lk": s("p_name LIKE '_e%'"), "il": s("p_name ILIKE '%RING%'"), "g": (lambda: T.glob(name(), "[a-m]*r?ng"), "p_name GLOB '[a-m]*r?ng'"), "st": (lambda: T.similar_to(name(), "(red|blue) .*"), "p_name SIMILAR TO '(red|blue) .*'"), "le": ("p_name LIKE '%\\\\_%'", "p_name LIKE '%$_%' ESCAPE '$'")})
pack("string_regex", "part", "p_partkey", {"m": (lambda: T.regexp_matches(name(), "^S", "i"), "regexp_matches(p_name, '^S', 'i')"), "f": (lambda: T.similar_to(name(), "[a-z]+ [a-z]+"), "regexp_full_match(p_name, '[a-z]+ [a-z]+')"), "e": (lambda: T.regexp_extract(brand(), r"(\d)", 1), r"regexp_extract(p_brand, '(\d)', 1)"), "e0": (lambda: T.regexp_extract(name(), "[aeiou]+"), "regexp_extract(p_name, '[aeiou]+')"), "r1": (lambda: T.regexp_replace(name(), "([aeiou])", r"<\1>"), r"regexp_replace(p_name, '([aeiou])', '<\1>')"), "rg": (lambda: T.regexp_replace(name(), "([aeiou])", r"<\1>", "g"), r"regexp_replace(p_name, '([aeiou])', '<\1>', 'g')"), "all": (lambda: text(F.regexp_extract_all(name(), F.lit("[aeiou]"), F.lit(0))), "array_to_string(regexp_extract_all(p_name, '[aeiou]'), ',')"), "sp": (lambda: text(F.split(name(), "[ei]")), "array_to_string(string_split_regex(p_name, '[ei]'), ',')"), "ss": (lambda: text(T.string_split(brand(), "#")), "array_to_string(string_split(p_brand, '#'), ',')")})
pack("string_concat", "part", "p_partkey", {"c": (lambda: T.concat(name(), F.nullif(size(), F.lit(5)), F.lit("!")), "concat(p_name, nullif(p_size, 5), '!')"), "o": s("p_name || '-' || p_brand"), "w": s("concat_ws('/', p_brand, nullif(p_type, 'PROMO'), p_name)"), "f": (lambda: T.format_text("<{}|{}>", name(), size()), "format('<{}|{}>', p_name, p_size)"), "p": ("printf('%d %s %.2f', p_size, p_type, p_retailprice)", "printf('%d %s %.2f', p_size, p_type, p_retailprice)"), "a": ("ascii(p_name)", "ascii(p_name)"), "u": (lambda: T.unicode(name()), "unicode(p_name)"), "ch": (lambda: T.chr(F.lit(8364) + size()), "chr(8364 + p_size)")})
pack("string_hash", "part", "p_partkey", {"m": s("md5(p_name)"), "s1": ("sha1(p_name)", "sha1(p_name)"), "s2": ("sha2(p_name, 256)", "sha256(p_name)"), "h": s("hex(p_name)"), "b": ("base64(encode(p_name, 'UTF-8'))", "base64(encode(p_name))"), "ub": ("decode(unbase64(base64(encode(p_name, 'UTF-8'))), 'UTF-8')", "decode(from_base64(base64(encode(p_name))))"), "tb": (lambda: T.to_base(size(), 2, 8), "to_base(p_size, 2, 8)"), "bin": ("bin(p_size)", "to_binary(p_size)"), "ue": (lambda: T.url_encode(F.concat(name(), F.lit("/ä?"), brand())), "url_encode(p_name || '/ä?' || p_brand)"), "ud": (lambda: T.url_decode(F.lit("a%20b%2Fc+")), "url_decode('a%20b%2Fc+')")})
pack("string_distance", "part", "p_partkey", {"lv": ("cast(levenshtein(p_name, p_type) as bigint)", "levenshtein(p_name, p_type)"), "dl": (lambda: T.damerau_levenshtein(name(), F.reverse(name())), "damerau_levenshtein(p_name, reverse(p_name))"), "hm": (lambda: T.hamming(name(), F.reverse(name())), "hamming(p_name, reverse(p_name))"), "jc": (lambda: F.round(T.jaccard(name(), brand()), 9), "round(jaccard(p_name, p_brand), 9)"), "js": (lambda: F.round(T.jaro_similarity(name(), F.lit("red ring")), 9), "round(jaro_similarity(p_name, 'red ring'), 9)"), "jw": (lambda: F.round(T.jaro_winkler_similarity(name(), F.lit("red ring")), 9), "round(jaro_winkler_similarity(p_name, 'red ring'), 9)")})
pack("string_unicode", "nation", "n_nationkey", {"sa": (lambda: T.strip_accents(F.concat(F.lit("éñüç "), F.col("n_name"))), "strip_accents('éñüç ' || n_name)"), "nf": (lambda: T.nfc_normalize(F.concat(F.lit("e\u0301"), F.col("n_name"))), "nfc_normalize('e\u0301' || n_name)"), "lg": (lambda: T.length_grapheme(F.concat(F.lit("e\u0301\U0001f926\U0001f3fc"), F.col("n_name"))), "length_grapheme('e\u0301\U0001f926\U0001f3fc' || n_name)"), "fb": (lambda: T.format_bytes(F.col("n_nationkey").cast("bigint") * F.col("n_nationkey") * 97_531), "format_bytes(n_nationkey::BIGINT * n_nationkey * 97531)"), "br": (lambda: T.bar(F.col("n_nationkey"), 0, 24, 10), "bar(n_nationkey, 0, 24, 10)")})
pack("string_paths", "pages", "page_id", {"fn": (lambda: T.parse_filename(F.col("url")), "parse_filename(url)"), "fx": (lambda: T.parse_filename(F.lit("a/b/c.tar.gz"), True), "parse_filename('a/b/c.tar.gz', true)"), "dp": (lambda: T.parse_dirpath(F.lit("/a/b/c.x")), "parse_dirpath('/a/b/c.x')"), "dn": (lambda: T.parse_dirname(F.lit("a/b/c.x")), "parse_dirname('a/b/c.x')")})

x = lambda: F.col("l_extendedprice")
q = lambda: F.col("l_quantity")
d = lambda: F.col("l_discount")
pack("math_rounding", "lineitem", "l_orderkey", {"c": ("cast(ceil(l_discount * 10) as double)", "ceil(l_discount * 10)"), "f": ("cast(floor(l_extendedprice / 7) as double)", "floor(l_extendedprice / 7)"), "r": s("round(l_extendedprice, -2)"), "r1": s("round(l_quantity / 4, 1)"), "t": (lambda: N.trunc(-x() / 3), "trunc(-l_extendedprice / 3)"), "e": (lambda: N.even(q() / 3), "even(l_quantity / 3)"), "sg": ("cast(signum(l_quantity - 25) as int)", "sign(l_quantity - 25)::INT"), "ab": s("abs(l_quantity - 25)")})
pack("math_functions", "lineitem", "l_orderkey", {"sq": ("round(sqrt(l_extendedprice), 6)", "round(sqrt(l_extendedprice), 6)"), "cb": s("round(cbrt(l_extendedprice), 6)"), "ex": s("round(exp(l_discount), 9)"), "ln": s("round(ln(l_quantity), 9)"), "lg": ("round(log10(l_quantity), 9)", "round(log(l_quantity), 9)"), "l2": s("round(log2(l_quantity), 9)"), "pw": s("round(pow(l_quantity, 1.5), 6)"), "fd": (lambda: N.fdiv(x(), q() + 0.5), "fdiv(l_extendedprice, l_quantity + 0.5)"), "fm": (lambda: F.round(N.fmod(x(), F.lit(7.5)), 6), "round(fmod(l_extendedprice, 7.5), 6)")})
pack("math_trigonometry", "lineitem", "l_orderkey", {k: s(f"round({k}(l_discount), 9)") for k in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "degrees", "radians")} | {"cot": s("round(cot(l_quantity), 7)"), "at2": s("round(atan2(l_discount, l_tax + 1), 9)"), "acosh": s("round(acosh(l_quantity), 9)"), "atanh": s("round(atanh(l_discount), 9)")})
k = lambda: F.col("o_orderkey")
pack("math_integers", "orders", "o_orderkey", {"dv": (lambda: N.divide(F.col("o_custkey"), k() % 3), "o_custkey / (o_orderkey % 3)"), "id": (lambda: N.integer_divide(F.col("o_custkey"), k() % 7 + 1), "o_custkey // (o_orderkey % 7 + 1)"), "md": s("o_custkey % 7"), "an": s("o_custkey & 12"), "orr": ("o_custkey | 12", "o_custkey | 12"), "xr": ("o_custkey ^ 12", "xor(o_custkey, 12)"), "nt": s("~o_custkey"), "sl": ("shiftleft(o_custkey, 2)", "o_custkey << 2"), "sr": ("shiftright(o_custkey, 2)", "o_custkey >> 2"), "bc": ("cast(bit_count(o_custkey) as int)", "bit_count(o_custkey)::INT"), "g": (lambda: N.gcd(F.col("o_custkey"), k()), "gcd(o_custkey, o_orderkey)::BIGINT"), "lc": (lambda: N.lcm(F.col("o_custkey"), F.lit(12)), "lcm(o_custkey, 12)::BIGINT"), "fa": (lambda: N.factorial((k() % 18).cast("int")).cast("bigint"), "factorial((o_orderkey % 18)::INT)::BIGINT"), "gr": s("greatest(o_custkey, o_orderkey, nullif(o_custkey, 7))"), "le": s("least(o_custkey, o_orderkey)")})

ts = lambda: F.col("ts")
day = lambda: F.col("o_orderdate")
pack("date_parts", "events", "event_id", {p: (f"cast({p}(ts) as bigint)", f"{p}(ts)") for p in ("year", "month", "day", "hour", "minute", "quarter", "weekofyear", "dayofmonth", "dayofyear")} | {"sec": ("cast(floor(second(ts)) as bigint)", "second(ts)"), "dow": (lambda: D.dayofweek(ts()), "dayofweek(ts)"), "isod": (lambda: D.isodow(ts()), "isodow(ts)"), "isoy": (lambda: D.isoyear(ts()), "isoyear(ts)"), "yw": (lambda: D.yearweek(ts()), "yearweek(ts)"), "cen": (lambda: D.century(ts()), "century(ts)"), "dec": (lambda: D.decade(ts()), "decade(ts)"), "mil": (lambda: D.millennium(ts()), "millennium(ts)"), "ep": (lambda: D.epoch(ts()), "epoch(ts)"), "eu": (lambda: D.micros(ts()), "epoch_us(ts)"), "ju": (lambda: F.round(D.julian(ts()), 4), "round(julian(ts), 4)"), "dn": (lambda: D.dayname(ts()), "dayname(ts)"), "mn": (lambda: D.monthname(ts()), "monthname(ts)")})
pack("date_trunc", "events", "event_id", {p: (lambda p=p: F.date_trunc(p, ts()).cast("timestamp_ntz"), f"date_trunc('{p}', ts)::TIMESTAMP") for p in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")} | {"ld": (lambda: F.last_day(ts()).cast("timestamp_ntz"), "last_day(ts)::TIMESTAMP"), "tb": (lambda: D.time_bucket(7_200_000_000, ts()), "time_bucket(INTERVAL 2 HOURS, ts)"), "tm": (lambda: D.time_bucket_months(2, ts()), "time_bucket(INTERVAL 2 MONTHS, ts)::TIMESTAMP")})
other = lambda: F.lit("1999-02-28 13:45:10").cast("timestamp_ntz")
O2 = "TIMESTAMP '1999-02-28 13:45:10'"
pack("date_difference", "orders", "o_orderkey", {f"d_{p}": (lambda p=p: D.date_diff(p, day(), other()), f"date_diff('{p}', o_orderdate, {O2})") for p in ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "decade", "century")} | {f"s_{p}": (lambda p=p: D.date_sub(p, day(), other()), f"date_sub('{p}', o_orderdate, {O2})") for p in ("year", "quarter", "month", "day", "hour")})
pack("date_arithmetic", "orders", "o_orderkey", {"a": ("o_orderdate + INTERVAL '3' DAY", "o_orderdate + INTERVAL 3 DAY"), "m": ("o_orderdate + INTERVAL '1' MONTH", "o_orderdate + INTERVAL 1 MONTH"), "h": ("o_orderdate - INTERVAL '90' MINUTE", "o_orderdate - INTERVAL 90 MINUTE"), "mk": ("cast(make_date(year(o_orderdate), 2, 28) as timestamp_ntz)", "make_date(year(o_orderdate), 2, 28)::TIMESTAMP"), "mt": ("make_timestamp_ntz(year(o_orderdate), 1, 2, 3, 4, 5.5)", "make_timestamp(year(o_orderdate), 1, 2, 3, 4, 5.5)"), "f": (lambda: D.strftime(day(), "%Y/%m/%d %H-%M week %A %b"), "strftime(o_orderdate, '%Y/%m/%d %H-%M week %A %b')"), "p": (lambda: D.strptime(F.date_format(day(), "dd.MM.yyyy"), "%Y-%m-%d", "%d.%m.%Y"), "strptime(strftime(o_orderdate, '%d.%m.%Y'), ['%Y-%m-%d', '%d.%m.%Y'])")})

name_list = lambda: F.split(name(), "")
LST = "string_split(p_name, '')"
i = lambda: F.array(size(), F.lit(3), F.nullif(size(), F.lit(7)), F.lit(1), F.lit(3))
ILST = "[p_size, 3, nullif(p_size, 7), 1, 3]"
pack("list_access", "part", "p_partkey", {"e": (lambda: L.list_extract(name_list(), 2), f"{LST}[2]"), "en": (lambda: L.list_extract(name_list(), -1), f"{LST}[-1]"), "oob": (lambda: L.list_extract(name_list(), 99), f"{LST}[99]"), "sl": (lambda: text(L.list_slice(name_list(), 2, 4)), f"array_to_string({LST}[2:4], ',')"), "st": (lambda: text(L.list_slice(name_list(), 1, 9, 2)), f"array_to_string({LST}[1:9:2], ',')"), "n": (lambda: F.size(name_list()).cast("bigint"), f"len({LST})"), "c": (lambda: F.array_contains(i(), 3), f"list_contains({ILST}, 3)"), "p": (lambda: L.list_position(i(), 1), f"list_position({ILST}, 1)"), "ha": (lambda: F.arrays_overlap(name_list(), F.array(F.lit("q"), F.lit("z"))), f"list_has_any({LST}, ['q', 'z'])"), "hl": (lambda: L.list_has_all(name_list(), F.array(F.lit("r"), F.lit("e"))), f"list_has_all({LST}, ['r', 'e'])")})
pack("list_order", "part", "p_partkey", {"s": (lambda: text(L.list_sort(i())), f"array_to_string(list_transform(list_sort({ILST}, 'ASC', 'NULLS LAST'), lambda x: coalesce(x::VARCHAR, 'NULL')), ',')"), "d": (lambda: text(F.array_sort(L.list_distinct(i()))), f"array_to_string(list_sort(list_distinct({ILST})), ',')"), "u": (lambda: L.list_unique(i()), f"list_unique({ILST})::BIGINT"), "r": (lambda: text(F.reverse(name_list())), f"array_to_string(list_reverse({LST}), ',')"), "g": (lambda: text(L.list_grade_up(F.array(size(), F.lit(30), F.lit(2)))), "array_to_string(list_grade_up([p_size, 30, 2]), ',')"), "z": (lambda: text(L.list_resize(F.array(size(), F.lit(1)), 3, 9)), "array_to_string(list_resize([p_size, 1], 3, 9), ',')"), "sel": (lambda: text(L.list_select(name_list(), F.array(F.lit(2), F.lit(1)))), f"array_to_string(list_select({LST}, [2, 1]), ',')"), "w": (lambda: text(L.list_where(F.array(size(), F.lit(8)), F.array(size() > 20, F.lit(True)))), "array_to_string(list_where([p_size, 8], [p_size > 20, true]), ',')"), "cc": (lambda: text(L.list_concat(F.array(size()), F.array(F.lit(4)))), "array_to_string(list_concat([p_size], [4]), ',')"), "ap": (lambda: text(F.array_append(F.array(size()), 7)), "array_to_string(list_append([p_size], 7), ',')"), "pp": (lambda: text(F.array_prepend(F.array(size()), 7)), "array_to_string(list_prepend(7, [p_size]), ',')"), "ix": (lambda: text(F.array_sort(F.array_intersect(name_list(), F.split(brand(), "")))), f"array_to_string(list_sort(list_intersect({LST}, string_split(p_brand, ''))), ',')")})
j = lambda: F.array(size(), F.lit(3), F.lit(10))
pack("list_lambda", "part", "p_partkey", {"t": (lambda: text(F.transform(j(), lambda v: v * 2 + 1)), "array_to_string(list_transform([p_size, 3, 10], lambda x: x * 2 + 1), ',')"), "ti": (lambda: text(F.transform(j(), lambda v, n: v + n + 1)), "array_to_string(list_transform([p_size, 3, 10], lambda x, i: x + i), ',')"), "f": (lambda: text(F.filter(j(), lambda v: v > 5)), "array_to_string(list_filter([p_size, 3, 10], lambda x: x > 5), ',')"), "r": (lambda: L.list_reduce(j(), lambda a, b: a * 2 + b), "list_reduce([p_size, 3, 10], lambda a, b: a * 2 + b)"), "lc": (lambda: text(F.transform(F.filter(j(), lambda v: v % 2 == 0), lambda v: v + 1)), "array_to_string([x + 1 for x in [p_size, 3, 10] if x % 2 = 0], ',')"), "sm": (lambda: L.list_sum(j()), "list_sum([p_size, 3, 10])::DOUBLE"), "mx": (lambda: F.array_max(j()), "list_max([p_size, 3, 10])"), "av": (lambda: F.round(L.list_avg(j()), 9), "round(list_avg([p_size, 3, 10]), 9)"), "fl": (lambda: text(F.flatten(F.array(j(), j()))), "array_to_string(flatten([[p_size, 3, 10], [p_size, 3, 10]]), ',')"), "gs": (lambda: text(F.sequence(F.lit(1), size() % 4 + 1)), "array_to_string(generate_series(1, p_size % 4 + 1), ',')"), "rg": (lambda: text(L.range_list(0, 10, 3)), "array_to_string(range(0, 10, 3), ',')")})
v = lambda: F.transform("embedding", lambda e: e.cast("double"))
w = lambda: F.reverse(v())
pack("list_vectors", "embeddings", "vec_id", {"ip": (lambda: F.round(L.inner_product(v(), w()), 6), "round(list_inner_product(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6)"), "ds": (lambda: F.round(L.distance(v(), w()), 6), "round(list_distance(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6)"), "cs": (lambda: F.round(L.cosine_similarity(v(), w()), 6), "round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6)"), "cp": (lambda: text(F.transform(L.cross_product(F.array(F.col("vec_id"), F.lit(2), F.lit(3)), F.array(F.lit(1), F.col("vec_id"), F.lit(5))), lambda z: z.cast("bigint"))), "array_to_string(list_transform(array_cross_product([vec_id, 2, 3]::DOUBLE[3], [1, vec_id, 5]::DOUBLE[3])::DOUBLE[], lambda x: x::BIGINT), ',')")})
m = lambda: F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(size(), F.lit(2)))
DM = "map(['a', 'b'], [p_size, 2])"
pack("map_functions", "part", "p_partkey", {"k": (lambda: text(F.map_keys(m())), f"array_to_string(map_keys({DM}), ',')"), "v": (lambda: text(F.map_values(m())), f"array_to_string(map_values({DM}), ',')"), "e": (lambda: F.try_element_at(m(), F.lit("a")), f"map_extract_value({DM}, 'a')"), "x": (lambda: F.size(L.map_extract(m(), "zz")).cast("bigint"), f"len(map_extract({DM}, 'zz'))"), "c": (lambda: F.map_contains_key(m(), "b"), f"map_contains({DM}, 'b')"), "n": (lambda: F.cardinality(m()).cast("bigint"), f"cardinality({DM})::BIGINT"), "en": (lambda: F.map_entries(m())[0]["value"], f"map_entries({DM})[1].value"), "cc": (lambda: text(F.map_keys(F.map_concat(m(), F.create_map(F.lit("c"), F.lit(1))))), f"array_to_string(map_keys(map_concat({DM}, map(['c'], [1]))), ',')")})
st = lambda: F.struct(size().alias("a"), name().alias("b"))
pack("struct_functions", "part", "p_partkey", {"a": (lambda: st()["a"], "struct_extract({'a': p_size, 'b': p_name}, 'a')"), "b": (lambda: st()["b"], "({'a': p_size, 'b': p_name}).b"), "i": (lambda: L.struct_insert(st(), c=size() + 1)["c"], "struct_insert({'a': p_size}, c := p_size + 1).c"), "u": (lambda: L.union_value({"num": "int", "str": "string"}, "num", size())["tag"], "union_tag(union_value(num := p_size))::VARCHAR"), "uv": (lambda: L.union_value({"num": "int", "str": "string"}, "num", size())["num"], "union_extract(union_value(num := p_size), 'num')"), "ec": (lambda: L.enum_code(["SMALL", "ECONOMY", "PROMO", "STANDARD", "MEDIUM", "LARGE"], F.lit("PROMO")), "enum_code('PROMO'::ENUM('SMALL', 'ECONOMY', 'PROMO', 'STANDARD', 'MEDIUM', 'LARGE'))::INT")})
pr = lambda: F.col("props")
pack("json_functions", "events", "event_id", {"s": (lambda: J.extract_string(pr(), "$.k"), "json_extract_string(props, '$.k')"), "p": (lambda: J.extract_string(pr(), "/k"), "json_extract_string(props, '/k')"), "k": (lambda: J.extract_string(pr(), "k"), "props ->> 'k'"), "e": (lambda: J.extract(pr(), "$.k"), "json_extract(props, '$.k')::VARCHAR"), "x": (lambda: J.exists(pr(), "$.nope"), "json_exists(props, '$.nope')"), "v": (lambda: J.valid(pr()), "json_valid(props)"), "ks": (lambda: text(J.keys(pr())), "array_to_string(json_keys(props), ',')"), "n": (lambda: J.array_length(F.lit("[1,2,3]")).cast("bigint"), "json_array_length('[1,2,3]')::BIGINT"), "t": (lambda: J.kind(pr()), "json_type(props)"), "mp": (lambda: J.merge_patch(pr(), F.lit('{"z":1}')), "json_merge_patch(props, '{\"z\":1}')::VARCHAR"), "c": (lambda: J.contains(pr(), F.lit('{"k":69}')), "json_contains(props, '{\"k\":69}')"), "mn": (lambda: J.minify(pr()), "json(props)::VARCHAR"), "o": (lambda: F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("t"))), "json_object('id', event_id, 't', event_type)::VARCHAR")})
pack("generic_functions", "supplier", "s_suppkey", {"c": s("coalesce(nullif(s_nationkey, 3), -1)"), "i": s("if(s_acctbal > 0, 'pos', 'neg')"), "cn": ("case when nullif(s_nationkey, 3) is null then null else 1 end", "constant_or_null(1, nullif(s_nationkey, 3))"), "tc": ("try_cast(s_name as int)", "try_cast(s_name AS INT)"), "ca": ("cast(cast(s_acctbal as decimal(12,1)) as double)", "s_acctbal::DECIMAL(12,1)::DOUBLE"), "st": ("cast(s_nationkey as string)", "s_nationkey::VARCHAR"), "nan": (lambda: F.isnan(F.lit(float("nan")) * F.col("s_acctbal")), "isnan('nan'::DOUBLE * s_acctbal)"), "inf": (lambda: N.is_infinite(F.col("s_acctbal")), "isinf(s_acctbal)"), "fin": (lambda: N.is_finite(F.col("s_acctbal")), "isfinite(s_acctbal)")})
