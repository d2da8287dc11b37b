"""The projection in the JVM against the plain form and against its optimality conditions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import portfolio


def cases():
    r = np.random.default_rng(12)
    out = []
    for k in range(120):
        n = int(r.integers(1, 30))
        w = r.normal(r.choice([0.0, 0.1, -0.2]), r.choice([0.02, 0.2, 1.0]), n)
        if k % 5 == 0:
            w = np.round(w, 1)  # ties
        out.append(w)
    return out + [np.zeros(4), np.full(8, 0.3), np.full(8, -0.3), np.array([5.0]), np.array([1.0, -1.0, 1.0, -1.0]), np.array([0.10, 0.10, -0.10])]


@pytest.mark.parametrize(("cap", "gross", "net"), [(0.1, 1.0, 0.2), (0.3, 0.8, 0.1), (0.05, 2.0, 0.0), (1.0, 1.0, 1.0), (0.2, 0.5, 0.05), (0.1, 1.0, 3.0)])
def test_projection(spark, cap, gross, net):
    given = cases()
    rows = [(d, f"T{i:02d}", float(x), i) for d, w in enumerate(given) for i, x in enumerate(w)] + [(d, "null", None, -1) for d in range(0, len(given), 2)] + [(999, "a", None, 0)]
    df = spark.createDataFrame(rows, "date int, ticker string, target_weight double, other int").repartition(4)
    out = portfolio.constrained(df, cap, gross, net)
    assert out.columns == df.columns
    got = {(r["date"], r["ticker"]): r["target_weight"] for r in out.collect()}
    assert len(got) == len(rows) and all(got[d, "null"] is None for d in range(0, len(given), 2)) and got[999, "a"] is None
    for d, w in enumerate(given):
        v = np.array([got[d, f"T{i:02d}"] for i in range(len(w))])
        assert np.abs(v).max() <= cap + 1e-6 and np.abs(v).sum() <= gross + 2e-6 and abs(v.sum()) <= net + 2e-6
        plain = portfolio.project(w, cap, gross, net)
        assert v == pytest.approx(plain, abs=2e-6), (d, w)
        assert ((v - w) ** 2).sum() <= ((plain - w) ** 2).sum() + 1e-6


def test_level(spark):
    r = np.random.default_rng(3)
    for cap, share in itertools.product((0.1, 1.0), (0.0, 0.3, 1.0, 2.0)):
        y = np.round(r.normal(0, 1, 12), 1).tolist()
        target = share * 12 * cap / 2
        df = spark.createDataFrame([(y,)], "y array<double>").select(portfolio.level(F.col("y"), cap, F.lit(target)).alias("t"))
        t = df.first()["t"]
        assert np.clip(np.array(y) - t, 0, cap).sum() == pytest.approx(target, abs=1e-9)
    one = spark.createDataFrame([([1.0, 2.0],)], "y array<double>")
    assert one.select(portfolio.level(F.col("y"), 0.5, F.lit(9.0)).alias("t")).first()["t"] == 0.5  # more than it reaches


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", 0.5)], "date int, ticker string, target_weight double")
    plan = portfolio.constrained(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
