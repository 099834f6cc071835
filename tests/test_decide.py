"""Constrained optimisation against enumeration and known answers."""

import itertools

import numpy as np
import pytest

from tessera.decide import DecideError, decide, diagnose, explain
from tessera.decide.solve import Model, Status, solve

ITEMS = [(1, 10, 5, "a"), (2, 40, 4, "a"), (3, 30, 6, "b"), (4, 50, 3, "b"), (5, 35, 7, "a"), (6, 5, 2, None)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "id int, value int, weight int, category string")


def chosen(df, name="x"):
    return {r["id"]: r[name] for r in df.collect()}


def best(objective, feasible, domain=(0, 1), n=len(ITEMS)):
    return max(objective(x) for x in itertools.product(domain, repeat=n) if feasible(x))


V, WT = [i[1] for i in ITEMS], [i[2] for i in ITEMS]
A, B = [i for i, r in enumerate(ITEMS) if r[3] == "a"], [i for i, r in enumerate(ITEMS) if r[3] == "b"]
dot = lambda a, x: sum(p * q for p, q in zip(a, x))

CASES = [
    ("SUM(x * weight) <= 10", "MAXIMIZE SUM(x * value)", lambda x: dot(WT, x) <= 10, lambda x: dot(V, x)),
    ("SUM(x * weight) <= 9 AND SUM(x) >= 2", "MINIMIZE SUM(x * value)", lambda x: dot(WT, x) <= 9 and sum(x) >= 2, lambda x: -dot(V, x)),
    ("SUM(x) <= 1 PER category", "MAXIMIZE SUM(x * value)", lambda x: all(sum(x[i] for i in g) <= 1 for g in (A, B)), lambda x: dot(V, x)),
    ("SUM(x * weight) <= 7 WHEN category = 'a' AND SUM(x) <= 4", "MAXIMIZE SUM(x * value)", lambda x: sum(WT[i] * x[i] for i in A) <= 7 and sum(x) <= 4, lambda x: dot(V, x)),
    ("SUM(x) WHEN (category = 'a') + SUM(x) WHEN (category = 'b') <= 3", "MAXIMIZE SUM(x * value)", lambda x: sum(x[i] for i in A + B) <= 3, lambda x: dot(V, x)),
    ("AVG(x * weight) <= 2", "MAXIMIZE SUM(x * value)", lambda x: dot(WT, x) <= 12, lambda x: dot(V, x)),
    ("SUM(x * weight) <= SUM(weight) - 15", "MAXIMIZE SUM(x * value)", lambda x: dot(WT, x) <= sum(WT) - 15, lambda x: dot(V, x)),
    ("SUM(x) <= COUNT(*) - 4", "MAXIMIZE SUM(x * value)", lambda x: sum(x) <= 2, lambda x: dot(V, x)),
    ("SUM(x) < 4 AND SUM(x) > 1 AND SUM(x) <> 3", "MAXIMIZE SUM(x * value)", lambda x: sum(x) == 2, lambda x: dot(V, x)),
    ("MAX(x * weight) <= 5 AND SUM(x) <= 3", "MAXIMIZE SUM(x * value)", lambda x: max(p * q for p, q in zip(WT, x)) <= 5 and sum(x) <= 3, lambda x: dot(V, x)),
    ("MAX(x * weight) >= 6", "MINIMIZE SUM(x * value)", lambda x: max(p * q for p, q in zip(WT, x)) >= 6, lambda x: -dot(V, x)),
    ("SUM(x) >= 3", "MINIMIZE MAX(x * weight)", lambda x: sum(x) >= 3, lambda x: -max(p * q for p, q in zip(WT, x))),
    ("SUM(x) <= 2", "MAXIMIZE MAX(x * value) + SUM(x)", lambda x: sum(x) <= 2, lambda x: max(p * q for p, q in zip(V, x)) + sum(x)),
    ("SUM(x * value) >= 60", "MINIMIZE SUM(x * weight) + MAX(x * value) / 10", lambda x: dot(V, x) >= 60, lambda x: -dot(WT, x) - max(p * q for p, q in zip(V, x)) / 10),
    ("SUM(ABS(x * weight - 3)) <= 14", "MAXIMIZE SUM(x * value)", lambda x: sum(abs(p * q - 3) for p, q in zip(WT, x)) <= 14, lambda x: dot(V, x)),
    ("SUM(ABS(x * weight - 3)) >= 19", "MAXIMIZE SUM(x * value)", lambda x: sum(abs(p * q - 3) for p, q in zip(WT, x)) >= 19, lambda x: dot(V, x)),
    ("SUM(x * weight) <= 14", "MAXIMIZE MIN(SUM(x * value)) PER category", lambda x: dot(WT, x) <= 14, lambda x: min(sum(V[i] * x[i] for i in A), sum(V[i] * x[i] for i in B))),
    ("SUM(x) >= 3", "MINIMIZE MAX(SUM(x * value)) PER category", lambda x: sum(x) >= 3, lambda x: -max(sum(V[i] * x[i] for i in A), sum(V[i] * x[i] for i in B))),
    ("SUM(x * weight) BETWEEN 6 AND 8", "MAXIMIZE SUM(x * value)", lambda x: 6 <= dot(WT, x) <= 8, lambda x: dot(V, x)),
    ("SUM(x * weight) <= (SELECT 11)", "MAXIMIZE SUM(x * value) WHEN category = 'b'", lambda x: dot(WT, x) <= 11, lambda x: sum(V[i] * x[i] for i in B)),
    ("SUM(x * POWER(weight, 2)) <= 40", "MAXIMIZE SUM(x * value)", lambda x: sum(w * w * q for w, q in zip(WT, x)) <= 40, lambda x: dot(V, x)),
    ("norm(x, 1) <= 2", "MAXIMIZE SUM(x * value)", lambda x: sum(x) <= 2, lambda x: dot(V, x)),
]


@pytest.mark.parametrize("such_that,objective,feasible,value", CASES, ids=[f"{c[0]} {c[1]}" for c in CASES])
def test_boolean_choices(items, such_that, objective, feasible, value):
    got = chosen(decide(items, f"DECIDE x(BOOL) SUCH THAT {such_that} {objective}"))
    x = [got[i[0]] for i in ITEMS]
    assert feasible(x) and value(x) == pytest.approx(best(value, feasible))


def test_integers(items):
    q = "DECIDE n(INT) SUCH THAT n BETWEEN 0 AND 3 AND n IN (0, 1, 3) AND -n <= 0 AND n / 2 <= 2 AND SUM(n) <> 7 AND SUM(n * weight) <= 21 MAXIMIZE SUM(n * value)"
    got = [chosen(decide(items, q), "n")[i[0]] for i in ITEMS]
    ok = lambda x: sum(x) != 7 and dot(WT, x) <= 21
    assert ok(got) and set(got) <= {0, 1, 3} and dot(V, got) == best(lambda x: dot(V, x), ok, (0, 1, 3))


def test_reals_and_scalars(items):
    r = decide(items, "DECIDE y(REAL), scalar cap(REAL) SUCH THAT y <= weight AND y <= cap AND SUM(y) >= 20 MINIMIZE cap").collect()
    assert sum(x["y"] for x in r) >= 20 - 1e-6 and len({x["cap"] for x in r}) == 1 and r[0]["cap"] == pytest.approx(max(3.75, r[0]["cap"])) and r[0]["cap"] == pytest.approx(3.75)
    r = decide(items, "DECIDE y(REAL) SUCH THAT y >= -5 AND y <= 5 AND SUM(y) <= 3 MAXIMIZE SUM(y * value)").collect()
    by = sorted(((x["value"], x["y"]) for x in r), reverse=True)
    assert [y for _, y in by] == pytest.approx([5, 5, 5, -2, -5, -5])


def test_entities_and_qualified_reducers(spark):
    rows = [(1, 7, "p", 3.0), (1, 7, "q", 2.0), (2, 9, "p", 1.0), (2, 9, "q", 4.0), (None, 4, "p", 5.0)]
    df = spark.createDataFrame(rows, "depot int, opening int, region string, cost double")
    q = "DECIDE D.open(BOOL), ship(REAL) SUCH THAT ship BETWEEN 0 AND 10 * open AND SUM(ship) >= 6 PER region MINIMIZE SUM(ship * cost) + SUM(D: opening * open)"
    r = decide(df, q, relations={"D": ["depot", "opening"]}).collect()
    assert all(x["ship"] <= 10 * x["open"] + 1e-6 for x in r) and len({(x["depot"], x["open"]) for x in r}) == 3
    total = sum(x["ship"] * x["cost"] for x in r) + sum({x["depot"]: x["opening"] * x["open"] for x in r}.values())
    assert total == pytest.approx(min(6 * 3 + 6 * 2 + 7, 6 * 1 + 6 * 4 + 9, 6 * 1 + 6 * 2 + 16))


def test_products(items):
    r = decide(items, "DECIDE pick(BOOL), boost(REAL) SUCH THAT boost <= 4 AND SUM(pick) <= 2 AND SUM(pick * boost) <= 6 MAXIMIZE SUM(pick * boost * weight)").collect()
    assert sum(x["pick"] * x["boost"] for x in r) <= 6 + 1e-6
    assert sum(x["pick"] * x["boost"] * x["weight"] for x in r) == pytest.approx(7 * 4 + 6 * 2)


def test_convex_quadratics(items):
    r = chosen(decide(items, "DECIDE y(REAL) SUCH THAT y <= 5 MINIMIZE SUM(POWER(y - weight, 2))"), "y")
    assert [r[i[0]] for i in ITEMS] == pytest.approx([min(5, w) for w in WT])
    r = chosen(decide(items, "DECIDE y(REAL) SUCH THAT y <= 30 AND SUM(y) <= 15 MINIMIZE norm(y - weight, 2)"), "y")
    assert sum(r.values()) == pytest.approx(15) and [r[i[0]] for i in ITEMS] == pytest.approx([w - 2 for w in WT])


def test_norms(items):
    r = decide(items, "DECIDE y(REAL) SUCH THAT y BETWEEN -20 AND 20 AND norm(y, 'inf') <= 4 AND SUM(y) >= 9 MINIMIZE norm(y, 0) + 0.001 * norm(y, 1)").collect()
    assert sum(abs(x["y"]) > 1e-6 for x in r) == 3 and max(abs(x["y"]) for x in r) <= 4 + 1e-6


def test_feasibility_only_and_empty_input(items, spark):
    assert sum(chosen(decide(items, "DECIDE x(BOOL) SUCH THAT SUM(x) = 2")).values()) == 2
    assert decide(items.limit(0), "DECIDE x(BOOL) SUCH THAT SUM(x * weight) <= 2 MAXIMIZE SUM(x)").columns[-1] == "x"


def test_direct_answers_match_the_solver(items):
    from tessera.decide import api

    for text in ("DECIDE x(BOOL) SUCH THAT SUM(x) <= 2 MAXIMIZE SUM(x * (value - 20))", "DECIDE x(BOOL) SUCH THAT SUM(x) <= 1 PER category MAXIMIZE SUM(x * value)", "DECIDE x(BOOL) SUCH THAT SUM(x) = 3 MINIMIZE SUM(x * value)", "DECIDE y(REAL) SUCH THAT y <= weight AND y >= 1 MAXIMIZE SUM((value - 30) * y)"):
        quick = api.direct(items, api.parse(text))
        rows, n, data, keys, entities = api.gathered(items, api.parse(text), {}, 100)
        m, b = api.model(api.parse(text), n, data, keys, entities)
        answer, name = solve(m), text[7]
        x = chosen(quick, name)
        body = m.cost[b.columns[name]]
        order = [r["id"] for r in rows.orderBy("__row").collect()]
        assert sum(c * x[i] for c, i in zip(body, order)) == pytest.approx(answer.objective - m.offset)


@pytest.mark.parametrize(
    "text",
    [
        "DECIDE x SUCH THAT SUM(x) <= 1",
        "DECIDE x(TEXT) SUCH THAT SUM(x) <= 1",
        "DECIDE x(BOOL) MAXIMIZE SUM(x)",
        "DECIDE value(BOOL) SUCH THAT SUM(value) <= 1",
        "DECIDE x(BOOL), x(INT) SUCH THAT SUM(x) <= 1",
        "DECIDE x(BOOL) SUCH THAT SUM(x) <= 1, SUM(x) >= 0",
        "DECIDE x(BOOL) SUCH THAT x <= 1 PER category",
        "DECIDE x(BOOL) SUCH THAT COUNT(x) <= 1",
        "DECIDE x(BOOL) SUCH THAT SUM(CASE WHEN value > 1 THEN 1 ELSE 0 END) >= 1",
        "DECIDE x(BOOL) SUCH THAT SUM(x) <= 1 WHEN x = 1",
        "DECIDE x(BOOL) SUCH THAT SUM(x * weight) <= 3 WHEN id > 99",
        "DECIDE x(BOOL) SUCH THAT SUM(x) + x <= 1",
        "DECIDE x(REAL) SUCH THAT SUM(x) < 1 MAXIMIZE SUM(x)",
        "DECIDE x(BOOL) SUCH THAT MAX(x) <> 1",
        "DECIDE x(BOOL) SUCH THAT SUM(x * nullif(weight, 5)) <= 9 MAXIMIZE SUM(x)",
        "DECIDE x(BOOL) SUCH THAT SUM(x) = 99 AND SUM(x) >= 0",
        "DECIDE x(REAL) SUCH THAT x >= 0 AND SUM(x) >= 1 MAXIMIZE SUM(x)",
        "DECIDE x(INT) SUCH THAT SUM(x % 2) <= 1",
        "DECIDE x(REAL) SUCH THAT SUM(POWER(x, 3)) <= 1",
        "DECIDE x(BOOL) SUCH THAT SUM(x) <= 3 MAXIMIZE MAX(x * value) PER category",
    ],
)
def test_refusals(items, text):
    with pytest.raises(DecideError):
        decide(items, text).collect()


def test_bounds_collapse_to_the_tightest(items):
    got = chosen(decide(items, "DECIDE x(BOOL) SUCH THAT SUM(x) <= weight MAXIMIZE SUM(x * value)"))
    assert sum(got.values()) == min(WT)


def test_diagnosis(items):
    assert [r.state for r in diagnose(items, "DECIDE x(BOOL) SUCH THAT SUM(x) <= 2 MAXIMIZE SUM(x)").collect()] == ["SOLVED"]
    r = diagnose(items, "DECIDE x(REAL) SUCH THAT x <= 5 AND SUM(x) >= 40 MAXIMIZE SUM(x)").collect()
    assert {x.state for x in r} == {"INFEASIBLE"} and r[0].total == pytest.approx(min(10, 10 / 6)) and r[0].clause in ("x <= 5", "SUM(x) >= 40")
    r = diagnose(items, "DECIDE x(REAL), y(REAL) SUCH THAT y <= 3 MAXIMIZE SUM(x + y)").collect()
    assert len(r) == 1 and r[0].state == "UNBOUNDED" and "x" in r[0].suggested_change


def test_explanation(items):
    text = explain(items, "DECIDE x(BOOL) SUCH THAT SUM(x) <= 2 AND x <= 1 MAXIMIZE SUM(x * value)")
    assert "SUM(x) <= 2" in text and "MAXIMIZE SUM(x * value)" in text


def test_time_limit():
    rng = np.random.default_rng(0)
    m = Model()
    m.columns(60, 0, 1, True)
    m.cost = -rng.integers(20, 60, 60).astype(float)
    for _ in range(8):
        m.add(np.zeros(60, int), np.arange(60), rng.integers(10, 60, 60), -1, 600, 0)
    assert solve(m, deadline=0.001).status is Status.TIME_LIMIT


def test_large_blocks_with_few_rows():
    """The long-step dual simplex against the plain one, and whole numbers within the gap of the bound."""
    from tessera.decide.solve import few_rows, long_step, simplex

    rng = np.random.default_rng(1)
    for _ in range(150):
        n, m = rng.integers(2, 12), rng.integers(1, 5)
        a, ops, low = rng.integers(-3, 6, (m, n)).astype(float), rng.integers(-1, 2, m), rng.integers(-2, 1, n).astype(float)
        high, c = low + rng.integers(1, 4, n), rng.integers(-6, 7, n).astype(float)
        right = np.round(a @ (low + (high - low) * rng.random(n)))
        one, two = simplex(c, a, ops, right, low, high), long_step(c, a, ops, right, low, high)
        assert one[0] == two[0] and (one[1] is None or c @ one[1] == pytest.approx(c @ two[1]))
    n = 20_000
    a = np.stack([rng.integers(1, 50, n), rng.random(n) * 9, (rng.random(n) < 0.3) * 1.0]).astype(float)
    c, right = -rng.random(n) * (rng.random(n) < 0.5), np.array([90_000.0, 16_000, 900])
    status, x = few_rows(c, a, np.array([-1, -1, -1]), right, np.zeros(n), np.ones(n), np.ones(n, bool), None, 1e-4)
    assert status is Status.OPTIMAL and set(np.unique(x)) <= {0.0, 1.0} and np.all(a @ x <= right + 1e-6)


SEPARABLE = [
    ("DECIDE y(REAL) SUCH THAT y BETWEEN 0 AND 30 AND SUM(y) <= {a} AND SUM(ABS(y - 15)) >= {b} MAXIMIZE SUM(ABS(y - w))", {"a": 30_000, "b": 34_000}),
    ("DECIDE y(REAL) SUCH THAT y BETWEEN -20 AND 20 AND SUM(ABS(y)) >= {a} AND norm(y, 'inf') <= 15 MINIMIZE SUM(ABS(y - w)) + 0.3 * norm(y, 0, 40)", {"a": 20_000}),
    ("DECIDE p(BOOL), y(REAL) SUCH THAT y <= 100 AND SUM(p) <= {a} AND SUM(p * y) <= {b} AND SUM(p * y) <= {c} WHEN w > 5 PER g MAXIMIZE SUM(p * y + 0.1 * p * w)", {"a": 900, "b": 50_000, "c": 9_000}),
]


@pytest.mark.parametrize("text,sizes", SEPARABLE, ids=["abs", "norms", "products"])
def test_separable_problems_reach_their_bound(spark, text, sizes):
    from tessera.decide import api
    from tessera.decide.choice import solve_choice
    from tessera.decide.formulate import Builder

    rng = np.random.default_rng(8)
    rows = [(i, float(round(w, 2)), int(i % 4)) for i, w in enumerate(rng.random(2500) * 40)]
    df = spark.createDataFrame(rows, "id int, w double, g int")
    p = api.parse(text.format(**sizes))
    found, n, data, keys, entities = api.gathered(df, p, {}, 10_000)
    answer, values = solve_choice(p, Builder(p, n, data, keys, entities), 1e18)
    assert answer.status in (Status.OPTIMAL, Status.SUBOPTIMAL) and answer.x is not None
    out = decide(df, text.format(**sizes)).toPandas()
    y, w = out.y.to_numpy(), out.w.to_numpy()
    if "ABS(y - 15)" in text:
        assert y.sum() <= 30_000 + 1e-6 and np.abs(y - 15).sum() >= 34_000 - 1e-6
        # the relaxation that lets every row take its own best end under one price is a bound from above
        bound = min((np.maximum(np.abs(0 - w), np.abs(30 - w) - t * 30).sum() + t * 30_000) for t in np.linspace(0, 2, 401))
        assert np.abs(y - w).sum() >= bound * (1 - 2e-3)
    elif "norm" in text:
        assert np.abs(y).sum() >= 20_000 - 1e-6 and np.abs(y).max() <= 15 + 1e-6
    else:
        gain = out.p * y
        assert out.p.sum() <= 900 and gain.sum() <= 50_000 + 1e-6 and out[out.w > 5].assign(s=gain).groupby("g").s.sum().max() <= 9_000 + 1e-6
        assert (gain + 0.1 * out.p * w).sum() >= 0.999 * (50_000 + 0.1 * np.sort(out.w)[-500:].sum() * 0.5)


def test_separable_squares_are_answered_by_spark(items):
    from tessera.decide import api

    text = "DECIDE y(REAL) SUCH THAT y <= 5 AND y >= 3 MINIMIZE SUM(POWER(y - weight, 2))"
    got = chosen(api.direct(items, api.parse(text)), "y")
    assert [got[i[0]] for i in ITEMS] == [min(5, max(3, w)) for w in WT]
    assert api.direct(items, api.parse("DECIDE y(REAL) SUCH THAT y <= 5 MAXIMIZE SUM(POWER(y - weight, 2))")) is None


def test_one_quadratic_limit(items):
    text = "DECIDE y(REAL) SUCH THAT y >= 0 AND y <= 50 AND SUM(POWER(y, 2)) <= {k} MINIMIZE norm(y - weight, 2) + 0.01 * SUM(y)"
    r = chosen(decide(items, text.format(k=1000)), "y")
    assert [r[i[0]] for i in ITEMS] == pytest.approx([w - 0.005 for w in WT])
    r = chosen(decide(items, text.format(k=20)), "y")
    y = np.array([r[i[0]] for i in ITEMS])
    assert (y**2).sum() == pytest.approx(20) and np.allclose((y / (np.array(WT) - 0.005)), y[0] / (WT[0] - 0.005))
    with pytest.raises(DecideError):
        decide(items, "DECIDE y(REAL) SUCH THAT y >= 2 AND y <= 9 AND SUM(POWER(y, 2)) <= 3 MINIMIZE SUM(y)").collect()


def test_knapsacks_by_weight(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(v), int(w)) for i, (v, w) in enumerate(zip(rng.integers(100, 999, 150), rng.integers(5, 60, 150)))]
    out = decide(spark.createDataFrame(rows, "id int, v int, w int"), "DECIDE x(BOOL) SUCH THAT SUM(x * w) <= 777 MAXIMIZE SUM(x * v)").collect()
    best = np.zeros(778)
    for _, v, w in rows:
        best[w:] = np.maximum(best[w:], best[:-w] + v)
    assert sum(r.x * r.w for r in out) <= 777 and sum(r.x * r.v for r in out) == best[-1]


def test_choices_under_large_limits_stay_choices(spark):
    rows = spark.range(4000, numPartitions=3).selectExpr("id", "1e8 * (1 + pmod(id * 7919, 4001) / 100) as price", "id % 5 as g", "id % 2 = 0 as f")
    total = 1e8 * sum(1 + i * 7919 % 4001 / 100 for i in range(4000))
    out = decide(rows, f"DECIDE x(BOOL) SUCH THAT SUM(x * price) <= {0.3 * total} AND SUM(x) <= 200 PER g AND SUM(x * price) <= {0.04 * total} WHEN f MAXIMIZE SUM(x * id)").toPandas()
    assert set(out.x) <= {0, 1} and (out.groupby("g").x.sum() <= 200).all()
    assert (out.x * out.price).sum() <= 0.3 * total and (out.x * out.price)[out.f].sum() <= 0.04 * total
