"""Problems whose rows meet only in a few sums, solved where the rows are; the driver holds sums and prices, never rows.

For given prices of the sums every row has a best point of its own: one of its candidate points if everything is linear
between kinks (see choice), or the minimum of a parabola between its bounds. Passes over the stored rows add up what the
points cost and use at several prices at once. The prices are narrowed down until two neighbouring ones lie on either side
of the limits; rows whose points differ between the two change over in order until the limits hold, and the last one stops
in between where its variables are REAL.
"""

from __future__ import annotations

import itertools
import pickle
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.decide.choice import MOST_POINTS, MOST_SUMS, ROUNDS, NotSeparable, Points, kinks, split
from tessera.decide.formulate import OPS, Builder
from tessera.decide.parse import Constraint, DecideError, Node, Problem
from tessera.decide.solve import Status, by_sign, simplex
from tessera.operators.rows import settle

PART, PRICES, BUCKETS = 33, 24, 4096  # bits of a row's place in its part; prices of one pass; slices of the rows of a part
SLIP = 1e-13  # of a limit, for what adding up may be off


@dataclass
class Plan:
    p: Problem
    bounds: list[Constraint] = field(default_factory=list)
    row_wise: list[tuple[Constraint, Node]] = field(default_factory=list)
    sums: list[tuple[Constraint, Node]] = field(default_factory=list)
    groups: dict[tuple[str, ...], int] = field(default_factory=dict)
    names: dict = field(default_factory=dict)  # a data text, ("when", text) or ("key", columns) to its column
    right: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bent: bool = False  # squares: the points are minima of parabolas

    def builder(self, batch: pa.RecordBatch | pa.Table) -> Builder:
        column = lambda k: batch.column(self.names[k]).to_numpy(zero_copy_only=False)
        data = {k: column(k).astype(float) if isinstance(k, str) else column(k) for k in self.names if isinstance(k, str)}
        data |= {k[1]: column(k) for k in self.names if k[0] == "when" and not isinstance(k, str)}
        b = Builder(self.p, batch.num_rows, data, {k[1]: column(k).astype(np.int64) for k in self.names if k[0] == "key" and not isinstance(k, str)}, {})
        for c in self.bounds:
            b.constraint(0, c)
        return b

    def parts(self, b: Builder) -> Iterator[tuple[np.ndarray, list[tuple[float, Node]]]]:
        """The rows and the aggregates of each sum; every sum is to be at most its right side."""
        for c, whole in self.sums:
            sign = -1.0 if OPS[c.op] > 0 else 1.0
            group = np.where(b.mask(c.when), b.keys[c.per] if c.per else 0, -1)
            found = [(sign * f, a) for f, a in split(whole, 1.0, b)[0]]
            for g in range(self.groups.get(c.per, 1)):
                yield group == g, found

    def aims(self, b: Builder) -> tuple[np.ndarray, list[tuple[float, Node]]]:
        return b.mask(self.p.objective.when), split(self.p.objective.body, float(self.p.objective.sense), b)[0]


def times(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """How many rows each row of a batch stands for."""
    return batch.column("__n").to_numpy().astype(float) if "__n" in batch.schema.names else np.ones(batch.num_rows)


class Choices:
    """The candidate points of a batch's rows, with what each costs and uses."""

    def __init__(self, plan: Plan, batch: pa.RecordBatch | pa.Table):
        self.plan, self.b, p = plan, (b := plan.builder(batch)), plan.p
        self.times = times(batch)
        self.low, self.high = ({v: side[b.columns[v]] for v in p.variables} for side in (b.m.low, b.m.high))
        if not all(np.isfinite(x).all() for x in (*self.low.values(), *self.high.values())):
            raise NotSeparable
        for v in p.variables.values():
            if v.kind != "REAL":
                self.low[v.name], self.high[v.name] = np.ceil(self.low[v.name] - 1e-9), np.floor(self.high[v.name] + 1e-9)
        if any((self.low[v] > self.high[v] + 1e-9).any() for v in p.variables):
            raise DecideError("INFEASIBLE: use diagnose() to see why")
        trees = [n for c in p.constraints for x in (c.left, c.right) for n in x.walk()] + [*p.objective.body.walk()]
        bent = [n.args[0] for n in trees if n.op in ("abs", "nonzero")] + [w for _, w in plan.row_wise]
        bent += [Node("add", [n.args[0], Node("mul", [Node("num", [s]), n.args[1]])]) for n in trees if n.op == "nonzero" and n.args[1:] for s in (1.0, -1.0)]
        if any(len({x.args[0] for x in n.walk() if x.op == "var" and p.variables[x.args[0]].kind != "BOOL"}) > 1 for n in bent):
            raise NotSeparable  # kinks of two free variables may cross inside the box
        roots, values = kinks(b, [n for n in bent if n.decides()], self.low, self.high), {}
        for v in p.variables.values():
            points = [self.low[v.name], self.high[v.name], *roots[v.name]]
            if v.kind != "REAL":
                points = [np.clip(f(x), self.low[v.name], self.high[v.name]) for x in points for f in (np.floor, np.ceil)]
            table = np.sort(np.stack(points), axis=0)
            values[v.name] = table[np.concatenate([[True], (np.diff(table, axis=0) > 1e-9).any(1)])]
        if np.prod([len(x) for x in values.values()]) > MOST_POINTS:
            raise NotSeparable
        self.at, cost, use = [], [], []
        self.parts, self.goal = list(plan.parts(b)), plan.aims(b)
        for combo in itertools.product(*(range(len(x)) for x in values.values())):
            at = {v: values[v][i] for v, i in zip(values, combo, strict=True)}
            own, each = self.measured(at)
            self.at.append(at)
            cost.append(own)
            use.append(each)
        self.cost, self.use = np.array(cost), np.array(use).transpose(1, 0, 2)
        if not np.isfinite(self.cost).any(0).all():
            raise DecideError("INFEASIBLE: use diagnose() to see why")

    def measured(self, at: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """What each row's point costs (infinite where its own clauses forbid it), and what it uses of each sum."""
        b, pts = self.b, Points(self.b, at)
        term = lambda own, found: sum((f * (own & b.mask(a.when)) * pts.value(a.args[0]) for f, a in found), np.zeros(b.rows))
        own, each = term(*self.goal), [term(*x) for x in self.parts]
        for c, whole in self.plan.row_wise:
            x, on = pts.value(whole), b.mask(c.when)
            slip = 1e-7 * (1 + np.abs(x))
            pts.fine &= ~on | ((x <= slip) if OPS[c.op] < 0 else (x >= -slip) if OPS[c.op] > 0 else (np.abs(x) <= slip))
        return np.where(pts.fine, own, np.inf), np.array(each).reshape(len(each), b.rows)

    def pick(self, price: np.ndarray) -> np.ndarray:
        whole = self.cost.copy()
        for k in np.flatnonzero(price):
            whole += price[k] * self.use[k]
        return np.argmin(whole, axis=0)

    def totals(self, price: np.ndarray) -> np.ndarray:
        """What the points at these prices cost, and what they use of each sum."""
        pick, every = self.pick(price), np.arange(self.b.rows)
        return np.array([(self.cost[pick, every] * self.times).sum(), *((u[pick, every] * self.times).sum() for u in self.use)])

    def spent(self, price: np.ndarray) -> np.ndarray:
        return self.use[:, self.pick(price), np.arange(self.b.rows)]

    def points(self, price: np.ndarray) -> dict[str, np.ndarray]:
        pick = self.pick(price)
        return {v: np.choose(pick, [a[v] for a in self.at]) if len(self.at) <= 32 else np.stack([a[v] for a in self.at])[pick, np.arange(self.b.rows)] for v in self.plan.p.variables}


class Parabolas:
    """Costs c.x + q.x^2 and one sum v.x + w.x^2 + constant over a batch's columns."""

    def __init__(self, plan: Plan, batch: pa.RecordBatch | pa.Table):
        self.plan, self.b = plan, (b := plan.builder(batch))
        self.times = np.ones(len(b.m.low))
        for v in plan.p.variables:
            self.times[b.columns[v]] = times(batch)
        self.low, self.high = b.m.low, b.m.high
        if np.any(self.low > self.high + 1e-9):
            raise DecideError("INFEASIBLE: use diagnose() to see why")
        self.c, self.q, self.constant = self.added(*plan.aims(b))
        self.sums = [self.added(*x) for x in plan.parts(b)]
        if np.any(self.q < 0) or any(np.any(w < 0) for _, w, _ in self.sums):
            raise NotImplementedError("non-convex quadratic terms are not supported by the built-in solver")
        if any(np.any((self.q <= 0) & (w <= 0)) for _, w, _ in self.sums):
            raise NotSeparable

    def added(self, own: np.ndarray, found: list[tuple[float, Node]]) -> tuple[np.ndarray, np.ndarray, float]:
        b, n = self.b, len(self.low)
        v, w, constant = np.zeros(n), np.zeros(n), 0.0
        for f, a in found:
            e = b.row(a.args[0], 0).scaled(f * (own & b.mask(a.when)))
            v += np.bincount(e.col, e.value, n)
            for _, col, value in e.squares:
                w += np.bincount(col, value, n)
            constant += float((e.const * self.times[b.columns[next(iter(self.plan.p.variables))]]).sum())
        return v, w, constant

    def x(self, price: np.ndarray) -> np.ndarray:
        c, q = self.c, self.q
        for t, (v, w, _) in zip(price, self.sums, strict=True):
            c, q = c + t * v, q + t * w
        x, open_ = by_sign(c, q, self.low, self.high, self.b.m.whole)
        if open_:
            raise NotImplementedError("a quadratic constraint over variables without bounds")
        return x

    def totals(self, price: np.ndarray) -> np.ndarray:
        x, n = self.x(price), self.times
        return np.array([((self.c * x + self.q * x * x) * n).sum(), *(((v * x + w * x * x) * n).sum() + k for v, w, k in self.sums)])

    def points(self, price: np.ndarray) -> dict[str, np.ndarray]:
        x = self.x(price)
        return {v: x[self.b.columns[v]] for v in self.plan.p.variables}


def planned(df: DataFrame, p: Problem) -> Plan:
    """How the problem is spread; NotSeparable if it is not of this kind."""
    o, plan = p.objective, Plan(p)
    if o is None or o.per or any(v.scope != "row" for v in p.variables.values()):
        raise NotSeparable
    constraints = [replace(c, left=counted(df, c.left, c), right=counted(df, c.right, c)) for c in p.constraints]
    plan.p = p = replace(p, constraints=constraints, objective=(o := replace(o, body=counted(df, o.body, o))))
    trees = [n for c in constraints for x in (c.left, c.right) for n in x.walk()] + [*o.body.walk()]
    if any(n.relations or n.op == "agg" and not n.decides() or n.op == "data" and "select" in n.text.lower() for n in trees):
        raise NotSeparable
    for c in constraints:
        whole = Node("add", [c.left, Node("neg", [c.right])], c.text)
        if c.op not in OPS or c.values is not None or (whole.aggregates() and c.op == "="):
            raise NotSeparable
        if c.left.op == "agg" and (c.left.fn, c.op) in (("MAX", "<="), ("MIN", ">=")) and not c.left.when and not c.per and not c.right.decides() and not c.right.aggregates():
            whole = Node("add", [c.left.args[0], Node("neg", [c.right])], c.text)  # a limit of every row
        if whole.aggregates():
            plan.sums.append((c, whole))
        elif c.left.op == "var" and not c.right.decides() and not c.when:
            plan.bounds.append(c)
        else:
            plan.row_wise.append((c, whole))
    if any(a.fn != "SUM" for x in (o.body, *(w for _, w in plan.sums)) for a in x.aggregates()):
        raise NotSeparable
    plan.bent = any(n.op == "pow" and n.decides() for n in trees)
    if plan.bent and (len(plan.sums) != 1 or plan.sums[0][0].per or plan.row_wise or any(v.kind != "REAL" for v in p.variables.values()) or any(n.op in ("abs", "nonzero") for n in trees)):
        raise NotSeparable
    return plan


def counted(df: DataFrame, node: Node, clause) -> Node:
    """The tree with aggregates of data alone, over all rows that the clause counts, as numbers."""
    from tessera.decide.api import bare

    if node.op == "agg" and not node.decides() and not node.relations and not clause.per and node.fn in ("SUM", "AVG", "COUNT", "MIN", "MAX") and "select" not in node.args[0].text.lower():
        body = node.args[0]
        text = str(body.args[0]) if body.op == "num" else f"cast({bare(body.text, df.columns)} as double)"
        own = " and ".join(f"(({bare(w, df.columns)}) <=> true)" for w in (clause.when, node.when) if w) or "true"
        n, null, value = df.where(own).select(F.expr(text).alias("x")).agg(F.count("*"), F.count_if(F.col("x").isNull() | F.isnan("x")), getattr(F, node.fn.lower())("x")).first()
        if null and node.fn != "COUNT":
            raise DecideError(f"{body.text} is NULL on some row; wrap it in COALESCE")
        if not n and node.fn in ("MIN", "MAX"):
            raise NotSeparable
        return Node("num", [float(n if node.fn == "COUNT" else value or 0.0)], node.text)
    return replace(node, args=[counted(df, a, clause) if isinstance(a, Node) else a for a in node.args])


def stored(df: DataFrame, plan: Plan) -> tuple[DataFrame, list]:
    """The rows, written to the shared folder with their places, and the columns that the clauses need."""
    from tessera.decide.api import bare

    spark, p, columns = df.sparkSession, plan.p, df.columns
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="tessera-"))
    path = f"{folder}/decide-{uuid.uuid4().hex}"
    df.withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    trees = [n for c in p.constraints for x in (c.left, c.right) for n in x.walk()] + [*p.objective.body.walk()]
    needed = [F.col("__m")]
    for t in sorted({n.text for n in trees if n.op == "data"}):
        plan.names[t] = f"__d{len(needed)}"
        needed.append(F.expr(f"cast({bare(t, columns)} as double)").alias(plan.names[t]))
    if len(needed) > 1:
        made = rows.select(*needed[1:])
        nulls = made.agg(*(F.count_if(F.col(c).isNull() | F.isnan(c)) for c in made.columns)).first()
        for t, n in zip(plan.names, nulls, strict=True):
            if n:
                raise DecideError(f"{t} is NULL on some row; wrap it in COALESCE")
    for t in sorted({n.when for n in trees if n.when} | {c.when for c in (*p.constraints, p.objective) if c.when}):
        plan.names["when", t] = f"__w{len(needed)}"
        needed.append(F.expr(f"cast(({bare(t, columns)}) <=> true as int)").alias(plan.names["when", t]))
    for per in sorted({c.per for c, _ in plan.sums if c.per}):
        keys = [bare(c, columns) for c in per]
        null = " or ".join(f"{c} is null" for c in keys)
        key = F.expr(f"case when {null} then null else to_json(struct({', '.join(keys)}), map('ignoreNullFields', 'false')) end")
        found = sorted(r[0] for r in rows.select(key.alias("k")).distinct().limit(MOST_SUMS + 2).collect() if r[0] is not None)
        plan.groups[per] = len(found)
        number = F.lit(-1)
        for i, k in enumerate(found):
            number = F.when(key == k, i).otherwise(number)
        plan.names["key", per] = f"__k{len(needed)}"
        needed.append(number.alias(plan.names["key", per]))
    return rows, needed


def added(rows: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum over all batches of the array that `work` makes of one; the driver gets one array from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sums"])

    try:
        parts = [pickle.loads(x) for x in rows.mapInArrow(run, "sums binary").toArrow().column(0).to_pylist()]
    except PythonException as failed:
        if "NotSeparable" in str(failed):
            raise NotSeparable from failed
        if said := re.search(r"DecideError: (.*)", str(failed)):
            raise DecideError(said[1]) from failed
        raise
    return np.sum(parts, axis=0) if parts else None


def folded(made: DataFrame) -> DataFrame:
    """Rows that are alike in all that the clauses read as one row with their number, where that leaves far fewer; else the rows as they are."""
    keys = [c for c in made.columns if c != "__m"]
    if keys:
        n, kinds = made.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*keys))).first()
        if kinds * 8 <= n:
            return settle(made.groupBy(*keys).agg(F.count("*").alias("__n")))
    return made


def solve_spread(df: DataFrame, p: Problem, until: float, gap: float = 1e-4) -> tuple[Status, DataFrame]:
    """df with the variables' columns, and whether the answer is shown to be within the gap."""
    from tessera import share_path

    plan = planned(df, p)
    share_path(df.sparkSession)
    rows, needed = stored(df, plan)
    view = Parabolas if plan.bent else Choices
    some = rows.select(*needed).limit(64).toArrow().combine_chunks()
    first = plan.builder(some)
    right = []
    for c, whole in plan.sums:
        constants = split(whole, 1.0, first)[1]
        if any(n.op != "num" for _, n in constants):
            raise NotSeparable
        sign = -1.0 if OPS[c.op] > 0 else 1.0
        right += [-sign * sum(f * n.args[0] for f, n in constants)] * plan.groups.get(c.per, 1)
    if len(right) > MOST_SUMS:
        raise NotSeparable
    plan.right = right = np.array(right)
    view(plan, some)
    slip, made = SLIP * (1 + np.abs(right)), rows.select(*needed)
    alike = folded(made)

    def totals(prices: list[np.ndarray]) -> np.ndarray:
        def work(batch: pa.RecordBatch) -> np.ndarray:
            own = view(plan, batch)
            return np.array([own.totals(t) for t in prices])

        return added(alike, work)

    fits = lambda total: bool(np.all(total[1:] - right <= slip))
    zero = np.zeros(len(right))
    free = totals([zero])[0]
    if fits(free):
        return Status.OPTIMAL, answered(df, p, rows, needed, plan, view, zero, zero, None, 0.0)
    if len(right) == 1:
        base, ways, bound = zero, [np.ones(1)], None
    else:
        base, ways, bound = priced(totals, alike, plan, free, until)
    unit = 1.0 if bound is None else 1e-9
    grid = [unit * 4.0**j for j in range(-20, 44)]
    for along in ways:
        lo, hi = 0.0, None
        for t, total in zip(grid, totals([base + t * along for t in grid]), strict=True):
            if fits(total):
                hi, there = t, total
                break
            lo = t
        if hi is not None:
            break
    if hi is None:
        if len(right) == 1:
            raise DecideError("INFEASIBLE: use diagnose() to see why")
        raise NotSeparable
    sharp = 1e-14 if bound is None else 1e-6
    while hi - lo > sharp * hi:
        if plan.bent and np.abs(there[1] - right[0]) <= 1e-14 * abs(right[0]):
            break
        inner = lo + (hi - lo) * np.arange(1, PRICES + 1) / (PRICES + 1)
        inner = np.unique(inner[(inner > lo) & (inner < hi)])
        if not len(inner):
            break
        for t, total in zip(inner, totals([base + t * along for t in inner]), strict=True):
            if fits(total):
                hi, there = t, total
                break
            lo = t
    low_price, high_price = base + lo * along, base + hi * along
    if plan.bent:
        return Status.OPTIMAL, answered(df, p, rows, needed, plan, view, high_price, high_price, None, 0.0)
    at, room = crossing(made, plan, low_price, high_price, totals([low_price])[0][1:] - right)
    near = bound is None or there[0] - bound <= gap * max(1.0, abs(bound))
    return (Status.OPTIMAL if near else Status.SUBOPTIMAL), answered(df, p, rows, needed, plan, view, low_price, high_price, at, room)


def priced(totals, made: DataFrame, plan: Plan, free: np.ndarray, until: float) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Prices of several sums by cutting planes on the dual, directions in which those of tight sums and those of all rise, and the dual bound.

    A pass makes a cut at each of several prices; the search stays in a box about the best ones, which follows its steps.
    """

    def ends(batch: pa.RecordBatch) -> np.ndarray:
        own = Choices(plan, batch)
        cost = np.where(np.isfinite(own.cost), own.cost, np.nan)
        return np.array([((np.nanmax(cost, 0) - np.nanmin(cost, 0)) * own.times).sum(), *(np.abs(own.use).max(1) * own.times).sum(1)])

    spread, *unit = added(made, ends)
    k, right = len(plan.right), plan.right
    roof = np.array([100.0 * (spread or 1.0) / (x or 1.0) for x in unit])
    price, over = np.zeros(k), free[1:] - right
    best, value, slack, wide = price, float(free[0]), over, roof.copy()
    at, slope = np.array([value]), over[None]  # cuts: value at price 0, slope
    for _ in range(ROUNDS):
        if time.monotonic() > until:
            break
        low, high = np.maximum(0, best - wide), np.minimum(roof, best + wide)
        width = high - low
        above = at + slope @ low - value
        scale = float(np.abs(slope[-3 * PRICES :] * width).max()) or 1.0
        state, y = simplex(np.array([0.0] * k + [-1.0]), np.hstack([-slope * width / scale, np.ones((len(at), 1))]), -np.ones(len(at)), above / scale, np.array([0.0] * k + [-1.0]), np.array([1.0] * k + [1e6]))
        if state is not Status.OPTIMAL:
            break
        x = low + y[:k] * width
        edge = ((y[:k] < 1e-6) & (low > 0)) | ((y[:k] > 1 - 1e-6) & (high < roof))
        if y[-1] * scale <= 1e-9 * max(1.0, abs(value)) and not edge.any():
            break
        wide = np.where(edge, 2 * wide, np.clip(4 * np.abs(x - best), wide / 10, wide))
        step = [best + a * (x - best) for a in (1.0, 0.7, 0.5, 0.35, 0.25, 0.12, 0.06, 0.03)]
        if k <= MOST_SUMS // 2:
            step += [np.where(np.arange(k) == i, x, best) for i in range(k)] + [np.where(np.arange(k) == i, best, x) for i in range(k)]
        found = totals(step)
        overs = found[:, 1:] - right
        values = found[:, 0] + (np.array(step) * overs).sum(1)
        at, slope = np.concatenate([at, found[:, 0]]), np.concatenate([slope, overs])
        i = int(np.argmax(values))
        if values[i] > value:
            best, value, slack = step[i], float(values[i]), overs[i]
        near = np.argsort(at + slope @ best - value, kind="stable")[: 8 * PRICES]
        at, slope = at[near], slope[near]
    tight = (best > 1e-9 * roof) | (slack > 0)
    return best, [(best + 1e-6 * roof) * tight, best + 1e-6 * roof], value


def crossing(made: DataFrame, plan: Plan, low: np.ndarray, high: np.ndarray, over: np.ndarray) -> tuple[int, np.ndarray]:
    """The place of the row with which, when all rows up to it stand at their points for the high prices, the limits hold; and what is still over before it."""
    slip = SLIP * (1 + np.abs(plan.right))

    def given(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own = Choices(plan, batch)
        return batch.column("__m").to_numpy(), own.spent(low) - own.spent(high)

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                m, less = given(batch)
                for part in np.unique(m >> PART):
                    found[int(part)] = found.get(int(part), 0.0) + less[:, (m >> PART) == part].sum(1)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["part", "sums"])

    sums: dict[int, np.ndarray] = {}
    got = made.mapInArrow(by_part, "part bigint, sums binary").toArrow()
    for part, raw in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        sums[part] = sums.get(part, 0.0) + np.frombuffer(raw)
    order, left = sorted(sums), over.astype(float)
    for part in order:
        if np.all(left - sums[part] <= slip) or part == order[-1]:
            break
        left = left - sums[part]
    start, width = part << PART, 1 << PART
    while width > 1:
        step = max(1, -(-width // BUCKETS))

        def sliced(batch: pa.RecordBatch, start=start, step=step) -> np.ndarray:
            m, less = given(batch)
            return np.stack([np.bincount((m - start) // step, x, BUCKETS) for x in less])

        slices = added(made.where((F.col("__m") >= start) & (F.col("__m") < start + width)), sliced)
        last = int(np.flatnonzero(slices.any(0))[-1])
        for i in range(last + 1):
            if np.all(left - slices[:, i] <= slip) or i == last:
                break
            left = left - slices[:, i]
        start, width = start + i * step, step
    return start, left


def answered(df: DataFrame, p: Problem, rows: DataFrame, needed: list, plan: Plan, view, low: np.ndarray, high: np.ndarray, at: int | None, room) -> DataFrame:
    """The rows with their points: for the high prices up to place `at`, for the low ones behind it, between the two in it where it may be divided."""
    kinds = {"BOOL": T.IntegerType(), "INT": T.LongType(), "REAL": T.DoubleType()}
    columns, arrow = df.columns, {"BOOL": pa.int32(), "INT": pa.int64(), "REAL": pa.float64()}
    schema = T.StructType([*df.schema.fields, *(T.StructField(v.name, kinds[v.kind]) for v in p.variables.values())])
    divided = len(plan.right) == 1 and all(v.kind == "REAL" for v in p.variables.values())

    def between(own: Choices, i: int, lo: dict, hi: dict) -> dict[str, float]:
        less = (own.spent(low) - own.spent(high))[0]
        if not divided or less[i] <= 0:
            return {}
        share = min(1.0, max(0.0, float(room[0] / less[i])))
        mid = {v: lo[v] + share * (hi[v] - lo[v]) for v in lo}
        (cost, use), (a, ua), (z, _) = own.measured(mid), own.measured(lo), own.measured(hi)
        fine = cost[i] <= a[i] + share * (z[i] - a[i]) + 1e-7 * (1 + abs(a[i])) and use[0, i] <= ua[0, i] - room[0] + 1e-7 * (1 + abs(ua[0, i]))
        return {v: mid[v][i] for v in lo} if fine else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = view(plan, batch)
            x = own.points(high)
            if at is not None:
                m, lo, hi = batch.column("__m").to_numpy(), own.points(low), x
                x = {v: np.where(m <= at, hi[v], lo[v]) for v in hi}
                for i in np.flatnonzero(m == at):
                    for v, value in between(own, i, lo, hi).items():
                        x[v][i] = value
            made = [pa.array(np.rint(x[v.name]) if v.kind != "REAL" else x[v.name] + 0.0).cast(arrow[v.kind]) for v in p.variables.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), *made], names=[*columns, *p.variables])

    return rows.select(*(F.col(f"`{c}`") for c in columns), *needed).mapInArrow(run, schema)
