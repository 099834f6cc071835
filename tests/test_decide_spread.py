"""Problems beyond the driver's rows, against known answers; each was refused for its rows before."""

import numpy as np
import pytest

from tessera.decide import DecideError, decide

Q = [float(x) for x in np.random.default_rng(3).integers(1, 51, 700)]


@pytest.fixture(scope="module")
def stock(spark):
    return spark.createDataFrame([(i, q, "abc"[i % 3], i % 7 == 0) for i, q in enumerate(Q)], "id int, q double, g string, f boolean").repartition(5).cache()


def far(df, text):
    return decide(df, text, row_limit=100).toPandas()


def test_absolute_values(stock):
    out = far(stock, f"DECIDE x(REAL) SUCH THAT x BETWEEN 5 AND 40 AND SUM(x) <= {20 * len(Q) - 0.75} MINIMIZE SUM(ABS(x - q))")
    near = np.clip(Q, 5, 40)
    assert len(out) == len(Q) and out.x.between(5, 40).all() and out.x.sum() <= 20 * len(Q) - 0.75 + 1e-6
    assert (out.x - out.q).abs().sum() == pytest.approx(np.abs(near - Q).sum() + near.sum() - 20 * len(Q) + 0.75)
    with pytest.raises(DecideError, match="INFEASIBLE"):
        far(stock, "DECIDE x(REAL) SUCH THAT x BETWEEN 5 AND 40 AND SUM(x) <= 100 MINIMIZE SUM(ABS(x - q))")


def test_norms(stock):
    out = far(stock, f"DECIDE x(REAL) SUCH THAT x BETWEEN 0 AND 30 AND SUM(x) >= {18 * len(Q)} MINIMIZE norm(x - 0.5 * q, 1)")
    assert out.x.sum() >= 18 * len(Q) - 1e-6
    assert (out.x - 0.5 * out.q).abs().sum() == pytest.approx(max(0, 18 * len(Q) - 0.5 * sum(Q)))


def test_coupled_squares(stock):
    cap = round(sum(Q) / 2)
    out = far(stock, f"DECIDE x(REAL) SUCH THAT x <= 30 AND SUM(x) <= {cap} MINIMIZE SUM(POWER(x - q, 2))")
    assert out.x.sum() == pytest.approx(cap, abs=1e-6) and out.x.between(0, 30).all()
    inside = out[(out.x > 0) & (out.x < 30)]
    give = (inside.q - inside.x).to_numpy()
    assert np.ptp(give) < 1e-9 and (out.q[out.x == 0] <= give[0] + 1e-9).all()


def test_sums_of_many_rows_keep_their_places(spark):
    from tessera.plans.optimisation import _sum

    many = spark.range(4_000_000, numPartitions=1).selectExpr("12.7503592 + id % 50 / 7 as x").agg(_sum("x")).first()[0]
    assert many == pytest.approx(4_000_000 * 12.7503592 + 80_000 * sum(range(50)) / 7, abs=2e-7)


def test_quadratic_limit(stock):
    most = round(sum(q * q for q in Q) / 2)
    out = far(stock, f"DECIDE x(REAL) SUCH THAT x BETWEEN 0 AND 60 AND SUM(POWER(x, 2)) <= {most} MINIMIZE SUM(POWER(x - q, 2))")
    assert (out.x / out.q).to_numpy() == pytest.approx(np.sqrt(most / sum(q * q for q in Q)))


def test_linear_allocation(stock):
    cap = sum(Q) / 2 + 0.25
    out = far(stock, f"DECIDE x(REAL) SUCH THAT x <= 1 AND SUM(x * q) <= {cap} MAXIMIZE SUM(x)")
    best, left = 0.0, cap
    for q in sorted(Q):
        best, left = best + min(1.0, left / q), left - min(q, left)
    assert (out.x * out.q).sum() <= cap + 1e-6 and out.x.sum() == pytest.approx(best)


def test_selection_under_several_limits(stock):
    text = f"DECIDE x(BOOL) SUCH THAT SUM(x * q) <= {0.3 * sum(Q)} AND SUM(x) <= 60 PER g AND SUM(x * q) <= {0.02 * sum(Q)} WHEN f MAXIMIZE SUM(x * id)"
    out = far(stock, text)
    assert (out.x * out.q).sum() <= 0.3 * sum(Q) and (out.x * out.q)[out.f].sum() <= 0.02 * sum(Q) and (out.groupby("g").x.sum() <= 60).all()
    near = decide(stock, text).toPandas()
    assert (out.x * out.id).sum() >= 0.99 * (near.x * near.id).sum()
    with pytest.raises(DecideError, match="row budget"):
        far(stock, "DECIDE x(BOOL) SUCH THAT SUM(x * q) <= 40 PER id MAXIMIZE SUM(x * id)")


def test_rows_without_a_point(spark):
    rows = spark.range(500, numPartitions=3).selectExpr("id", "if(id = 400, 4.5, 9.5) as q")
    with pytest.raises(DecideError, match="INFEASIBLE"):
        far(rows, "DECIDE x(REAL) SUCH THAT x BETWEEN 5 AND q AND SUM(x) <= 3000 MINIMIZE SUM(ABS(x - q))")
    with pytest.raises(DecideError, match="INFEASIBLE"):
        far(rows, "DECIDE x(INT) SUCH THAT x BETWEEN 4.2 AND q AND x >= 4.2 AND SUM(x) <= 3000 MINIMIZE SUM(ABS(x - q))")
    out = far(rows, "DECIDE x(INT) SUCH THAT x BETWEEN 3.2 AND q AND SUM(x) <= 3000 MINIMIZE SUM(ABS(x - q))")
    assert out.x.between(4, 9).all() and out.x.sum() == 3000 and out.x[400] == 4
