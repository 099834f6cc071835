"""decide(), diagnose() and explain() over DataFrames."""

from __future__ import annotations

import re
import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.decide.choice import NotSeparable, solve_choice
from tessera.decide.formulate import Builder
from tessera.decide.parse import DecideError, Node, Problem, parse
from tessera.decide.solve import SOLVERS, Answer, Model, Status
from tessera.decide.spread import solve_spread
from tessera.operators.rows import settle, with_row_index

FINDING = T.StructType([T.StructField(n, T.DoubleType() if n in ("amount", "total") else T.StringType()) for n in ("state", "clause", "suggested_change", "amount", "total", "scope", "edit_source", "group", "row")])
SPREAD_ROWS = 1_000_000  # beyond these, problems whose rows meet in a few sums are solved where the rows are
KINDS = {"BOOL": "int", "INT": "bigint", "REAL": "double"}


def checked(df: DataFrame, text: str, relations: dict[str, list[str]]) -> Problem:
    p = parse(text)
    names = {c.lower() for c in df.columns}
    for v in p.variables.values():
        if v.name.lower() in names:
            raise DecideError(f"the variable {v.name} has the name of a column")
        if v.scope not in ("row", "scalar") and v.scope not in relations:
            raise DecideError(f"the columns of relation {v.scope} are not given")
    return p


def nodes(p: Problem):
    for c in p.constraints:
        yield from c.left.walk()
        yield from c.right.walk()
    if p.objective:
        yield from p.objective.body.walk()


def bare(text: str, columns: list[str]) -> str:
    """Column names without the names of their relations, outside subqueries."""
    if re.search(r"(?i)\bselect\b", text):
        return text
    return re.sub(r"\b[A-Za-z_]\w*\.([A-Za-z_]\w*)", lambda m: m[1] if m[1] in columns else m[0], text)


def gathered(df: DataFrame, p: Problem, relations: dict[str, list[str]], limit: int):
    """The rows with their numbers, settled, and the arrays that the clauses need."""
    rows = settle(with_row_index(df, "__row"))
    n = rows.count()
    if n > limit:
        raise DecideError(f"{n} rows are beyond the row budget of {limit}; raise row_limit or plug in a solver")
    texts = {x.text for x in nodes(p) if x.op == "data"}
    whens = {x.when for x in nodes(p) if x.when} | {c.when for c in p.constraints if c.when} | ({p.objective.when} if p.objective and p.objective.when else set())
    pers = {c.per for c in p.constraints if c.per} | ({p.objective.per} if p.objective and p.objective.per else set())
    used = {v.scope for v in p.variables.values()} - {"row", "scalar"} | {r for x in nodes(p) for r in x.relations}
    for r in used:
        if r not in relations:
            raise DecideError(f"the columns of relation {r} are not given")
    columns, select = df.columns, ["__row"]
    names: dict[str, str] = {}
    for i, t in enumerate(sorted(texts)):
        names[t] = f"d{i}"
        select.append(f"cast({bare(t, columns)} as double) as d{i}")
    for i, t in enumerate(sorted(whens)):
        names[("when", t)] = f"w{i}"
        select.append(f"cast(({bare(t, columns)}) <=> true as int) as w{i}")
    keys = {per: [bare(c, columns) for c in per] for per in pers} | {("rel", r): relations[r] for r in used}
    for i, (k, cols) in enumerate(sorted(keys.items(), key=str)):
        names[("key", k)] = f"k{i}"
        null = " or ".join(f"{c} is null" for c in cols) if k not in [("rel", r) for r in used] else "false"
        select.append(f"case when {null} then null else to_json(struct({', '.join(cols)}), map('ignoreNullFields', 'false')) end as k{i}")
    rows.createOrReplaceTempView("__decide_input")
    got = rows.sparkSession.sql(f"select {', '.join(select)} from __decide_input").toArrow().sort_by("__row")
    rows.sparkSession.catalog.dropTempView("__decide_input")
    data = {t: got.column(names[t]).to_numpy(zero_copy_only=False).astype(float) for t in texts}
    data |= {t: got.column(names[("when", t)]).to_numpy() for t in whens}

    def numbered(k) -> np.ndarray:
        column = got.column(names[("key", k)]).combine_chunks().dictionary_encode()
        return column.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    return rows, n, data, {per: numbered(per) for per in pers}, {r: numbered(("rel", r)) for r in used}


def model(p: Problem, n, data, keys, entities, elastic: bool = False) -> tuple[Model, Builder]:
    b = Builder(p, n, data, keys, entities)
    b.elastic = elastic
    return b.build(), b


def attached(rows: DataFrame, p: Problem, b: Builder, x: np.ndarray) -> DataFrame:
    return joined(rows, p, b.rows, {v: x[b.columns[v]] for v in p.variables})


def joined(rows: DataFrame, p: Problem, n: int, found: dict[str, np.ndarray]) -> DataFrame:
    """The rows with their variables' values, by row number."""
    import pandas as pd

    columns = {"__id": np.arange(n)}
    for v in p.variables.values():
        columns[v.name] = np.rint(found[v.name]).astype(np.int64) if v.kind != "REAL" else found[v.name] + 0.0
    schema = "__id bigint, " + ", ".join(f"`{v.name}` {'bigint' if v.kind != 'REAL' else 'double'}" for v in p.variables.values())
    values = rows.sparkSession.createDataFrame(pd.DataFrame(columns), schema)
    out = rows.join(values, rows["__row"] == values["__id"]).drop("__row", "__id")
    return out.withColumns({v.name: F.col(v.name).cast(KINDS[v.kind]) for v in p.variables.values()})


def direct(df: DataFrame, p: Problem) -> DataFrame | None:
    """Problems that Spark solves itself: a BOOL choice under one cardinality limit, and variables bounded row by row."""
    o = p.objective
    if o is None or o.when or o.per or o.body.op != "agg" or o.body.fn != "SUM" or o.body.when or o.body.relations or any(v.scope != "row" for v in p.variables.values()):
        return None
    cost = linear(o.body.args[0], df.columns)
    nearest = None if cost is not None else least_square(o.body.args[0], p, df.columns) if o.sense == 1 else None
    if cost is None and nearest is None:
        return None
    if cost is not None and len(p.variables) == 1 and len(p.constraints) == 1:
        (v,), (c,) = p.variables.values(), p.constraints
        count = c.left.op == "agg" and c.left.fn == "SUM" and not c.left.when and not c.left.relations and c.left.args[0].op == "var"
        if v.kind == "BOOL" and count and c.right.op == "num" and not c.when and c.op in ("<=", "="):
            gain = F.expr(f"cast(({cost.get(v.name, '0')}) as double) * {-o.sense}")
            most, fits = int(np.floor(c.right.args[0])), c.right.args[0] >= 0 and (c.op == "<=" or float(c.right.args[0]).is_integer())
            if not fits:
                raise DecideError("INFEASIBLE: use diagnose() to see why")
            null = df.where(gain.isNull()).limit(1).count()
            if null:
                raise DecideError(f"{cost[v.name]} is NULL on some row; wrap it in COALESCE")
            if c.per:
                keys = [bare(k, df.columns) for k in c.per]
                key = F.when(~F.expr(" or ".join(f"{k} is null" for k in keys)), F.struct(*keys))
                place = F.row_number().over(W.partitionBy(key).orderBy(gain.desc()))
                chosen = F.when(key.isNull(), gain > 0).otherwise((place <= most) & ((gain > 0) if c.op == "<=" else F.lit(True)))
                if c.op == "=" and not df.where(key.isNotNull()).groupBy(key).count().where(F.col("count") < most).isEmpty():
                    raise DecideError("INFEASIBLE: use diagnose() to see why")
                return df.withColumn(v.name, F.coalesce(chosen, F.lit(False)).cast("int"))
            ranked = with_row_index(df.withColumn("__gain", gain).orderBy(F.desc("__gain")), "__place")
            if c.op == "=" and ranked.count() < most:
                raise DecideError("INFEASIBLE: use diagnose() to see why")
            pick = (F.col("__place") < most) & ((F.col("__gain") > 0) if c.op == "<=" else F.lit(True))
            return ranked.withColumn(v.name, pick.cast("int")).drop("__gain", "__place")
    low = {v.name: F.lit(0.0) for v in p.variables.values()}
    high = {v.name: F.lit(1.0 if v.kind == "BOOL" else float("inf")) for v in p.variables.values()}
    explicit: set[str] = set()
    for c in p.constraints:
        if c.left.op != "var" or c.right.op not in ("num", "data") or c.op not in ("<=", ">=") or c.when or "select" in c.text.lower():
            return None
        bound, name = F.expr(f"cast(({bare(c.right.text, df.columns)}) as double)"), c.left.args[0]
        if c.op == "<=":
            high[name] = F.least(high[name], bound)
        else:
            low[name] = F.greatest(low[name], bound) if name in explicit or p.variables[name].kind == "BOOL" else bound
            explicit.add(name)
    out, checks = df, F.lit(False)
    for v in p.variables.values():
        lo, hi = (F.ceil(low[v.name]).cast("double"), F.floor(F.least(high[v.name], F.lit(9e15))).cast("double")) if v.kind != "REAL" else (low[v.name], high[v.name])
        if nearest is not None:
            value = F.least(F.greatest(F.expr(f"cast({nearest} as double)"), lo), hi)
            value = F.when(F.expr(f"({nearest}) is not null"), value)
        else:
            gain = F.expr(f"cast(({cost.get(v.name, '0')}) as double) * {-o.sense}")
            value = F.when(gain > 0, hi).when(gain <= 0, lo)
        checks = checks | value.isNull() | (lo > hi) | (F.abs(value) >= 9e15)
        out = out.withColumn(v.name, value.cast(KINDS[v.kind]))
    if not df.where(checks).isEmpty():
        return None  # the general way says what is wrong
    return out


def least_square(node: Node, p: Problem, columns: list[str]) -> str | None:
    """Where the square of one REAL variable less data, POWER(x - data, 2), is zero, as SQL; null for any other form."""
    if node.op != "pow" or len(p.variables) != 1 or next(iter(p.variables.values())).kind != "REAL":
        return None
    base = node.args[0]
    if base.op == "add" and len(base.args) == 2 and base.args[0].op == "var":
        other = base.args[1]
        if other.op == "neg" and other.args[0].op in ("num", "data") and "select" not in other.args[0].text.lower():
            return f"({bare(other.args[0].text, columns)})"
        if other.op in ("num", "data") and "select" not in other.text.lower():
            return f"-({bare(other.text, columns)})"
    return None


def linear(node: Node, columns: list[str]) -> dict[str, str] | None:
    """Coefficients of an expression that is a sum of data times variable, as SQL; null if it is not."""
    if node.op == "var":
        return {node.args[0]: "1"}
    if node.op in ("num", "data"):
        return {}
    if node.op == "neg":
        inner = linear(node.args[0], columns)
        return None if inner is None else {k: f"-({v})" for k, v in inner.items()}
    if node.op == "add":
        out: dict[str, str] = {}
        for a in node.args:
            inner = linear(a, columns)
            if inner is None:
                return None
            for k, v in inner.items():
                out[k] = f"{out[k]} + ({v})" if k in out else v
        return out
    if node.op == "mul":
        a, b = node.args if node.args[1].decides() else node.args[::-1]
        if a.decides() or "select" in a.text.lower():
            return None
        inner = linear(b, columns)
        return None if inner is None else {k: f"({bare(a.text, columns)}) * ({v})" for k, v in inner.items()}
    return None


def decide(df: DataFrame, text: str, relations: dict[str, list[str]] | None = None, row_limit: int = 2_000_000, time_limit: float = 300.0, solver: str = "built-in") -> DataFrame:
    """df with a column for each variable; relations gives the columns of relations that clauses name."""
    relations = relations or {}
    p = checked(df, text, relations)
    quick = direct(df, p)
    if quick is not None:
        return quick
    if not relations and solver == "built-in" and df.count() > min(SPREAD_ROWS, row_limit):
        try:
            return solve_spread(df, p, time.monotonic() + time_limit)[1]
        except NotSeparable:
            pass  # the driver takes it, within its row budget
    rows, n, data, keys, entities = gathered(df, p, relations, row_limit)
    if not n:
        return df.withColumns({v.name: F.lit(None).cast(KINDS[v.kind]) for v in p.variables.values()})
    try:
        b = Builder(p, n, data, keys, entities)
        answer, found = solve_choice(p, b, time.monotonic() + time_limit / 2)
        if answer.x is not None:
            return joined(rows, p, n, found)
    except NotSeparable:
        m, b = model(p, n, data, keys, entities)
        answer = SOLVERS[solver](m, time.monotonic() + time_limit)
    if answer.x is None:
        raise DecideError(f"{answer.status.value}: the query has no answer; use diagnose() to see why")
    return attached(rows, p, b, answer.x)


def router(answer: Answer) -> str:
    return {Status.OPTIMAL: "SOLVED", Status.SUBOPTIMAL: "SOLVED", Status.UNBOUNDED: "UNBOUNDED", Status.INFEASIBLE: "INFEASIBLE"}.get(answer.status, "UNDIAGNOSED")


def diagnose(df: DataFrame, text: str, relations: dict[str, list[str]] | None = None, scope: str = "query", row_limit: int = 200_000, time_limit: float = 60.0, solver: str = "built-in") -> DataFrame:
    """Findings on a query: state, clause, suggested_change, amount, total, scope, edit_source, group, row; one row if it has an answer.

    scope: query (one change for a clause) or expanded (one for each of its rows).
    """
    relations = relations or {}
    p = checked(df, text, relations)
    rows, n, data, keys, entities = gathered(df, p, relations, row_limit)
    spark, solve = df.sparkSession, SOLVERS[solver]
    m, b = model(p, n, data, keys, entities)
    until = time.monotonic() + time_limit
    answer = solve(m, until)
    state = router(answer)
    if state == "SOLVED":
        return spark.createDataFrame([(state, None, None, None, None, None, None, None, None)], FINDING)
    found: list[tuple] = []
    if state == "UNBOUNDED":
        open_ = ~np.isfinite(m.high) | ~np.isfinite(m.low)
        ray = Model(low=np.where(np.isfinite(m.low), 0.0, -1.0), high=np.where(np.isfinite(m.high), 0.0, 1.0), whole=np.zeros(len(m.low), bool), cost=m.cost.copy(), square=np.zeros(len(m.low)), row=m.row, col=m.col, value=m.value, ops=m.ops, right=[np.zeros_like(r) for r in m.right], clause=m.clause, rows=m.rows)
        move = solve(ray, until)
        for v in p.variables.values():
            c = b.columns[v.name]
            grows = move.x is not None and np.abs(move.x[c]).max(initial=0) > 1e-9
            if grows or (move.x is None and open_[c].any()):
                toward = "+infinity" if move.x is None or move.x[c].sum() > 0 else "-infinity"
                found.append((state, None, f"bound {v.name}, which grows towards {toward}", None, None, "query", "variable", None, None))
    elif state == "INFEASIBLE":
        e, b2 = model(p, n, data, keys, entities, elastic=True)
        clause, right, ops = (np.concatenate(x) for x in (e.clause, e.right, e.ops))
        which = np.flatnonzero(clause >= 0)
        if scope == "query":
            ids, slot = np.unique(clause[which], return_inverse=True)
        else:
            ids, slot = clause[which], np.arange(len(which))
        e.cost[:], e.square[:], e.offset = 0, 0, 0.0
        up, down = e.columns(len(ids), 0, np.inf, False), e.columns(len(ids), 0, np.inf, False)
        e.cost[up], e.cost[down] = 1, 1
        loosens = ops[which] <= 0
        e.row.append(which[loosens])
        e.col.append(up[slot[loosens]])
        e.value.append(np.full(loosens.sum(), -1.0))
        loosens = ops[which] >= 0
        e.row.append(which[loosens])
        e.col.append(down[slot[loosens]])
        e.value.append(np.ones(loosens.sum()))
        repaired = solve(e, until)
        if repaired.x is None:
            found.append(("UNDIAGNOSED", None, None, None, None, scope, None, None, None))
        else:
            total = float(repaired.x[up].sum() + repaired.x[down].sum())
            for i, k in enumerate(ids):
                amount = float(repaired.x[up[i]] + repaired.x[down[i]])
                if amount > 1e-9:
                    c = p.constraints[int(k)]
                    way = "raise the limit" if repaired.x[up[i]] > repaired.x[down[i]] else "lower the limit"
                    place = None if scope == "query" else str(i - int(np.searchsorted(ids, k)) if np.all(ids[:-1] <= ids[1:]) else i)
                    found.append((state, c.text, f"{way} by {amount:.6g}", amount, total, scope, "constraint", ", ".join(c.per) or None, place))
    else:
        found.append((state, None, answer.status.value, None, None, scope, None, None, None))
    return spark.createDataFrame(found, FINDING)


def explain(df: DataFrame, text: str, relations: dict[str, list[str]] | None = None) -> str:
    """Variables, objective and constraints as they were read, and how the query would be solved."""
    p = checked(df, text, relations or {})
    lines = ["Variables"] + [f"  {v.name} {v.kind} ({v.scope})" for v in p.variables.values()]
    lines += ["Objective", f"  {p.objective.text if p.objective else 'none: any feasible answer'}", "Constraints"]
    lines += [f"  {t}" for t in dict.fromkeys(c.text for c in p.constraints)]
    return "\n".join(lines)
