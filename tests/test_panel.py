"""Hand-computed fixtures, invariants and look-ahead checks of the panel operators."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.columns import average_rank, half_up
from panelspark.functions.dist import normal_cdf, normal_ppf, t_two_sided
from panelspark.operators import execution, features, inference, learning, metrics, portfolio, quality, regimes, resampling, signals, stationarity, validation
from panelspark.sources import calendar
from panelspark.sources.config import ExperimentConfig, from_dict, load_config, save_config
from panelspark.sources.panels import with_session_idx

DAYS = [date(2020, 1, 6) + timedelta(days=k) for k in range(400)]


def panel(spark, rows, schema="date date, ticker string, adj_close double"):
    return with_session_idx(spark.createDataFrame(rows, schema))


def series(spark, values, ticker="A"):
    return panel(spark, [(DAYS[k], ticker, v) for k, v in enumerate(values)])


def values(df, column):
    return [r[column] for r in df.orderBy("date", *(["ticker"] if "ticker" in df.columns else [])).collect()]


def test_returns(spark):
    df = series(spark, [100.0, None, 105.0, 110.0]).withColumns({"r": features.simple_return("adj_close"), "f": features.forward_return("adj_close", 1)})
    assert values(df, "r") == [None, None, None, pytest.approx(5 / 105)]
    assert values(df, "f") == [None, None, pytest.approx(5 / 105), None]
    df = series(spark, [10.0 + 2 * k for k in range(10)]).withColumn("s", features.skip_return("adj_close", 5, 2))
    assert values(df, "s")[6] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        features.skip_return("adj_close", 2, 2)


def test_grid_windows_count_sessions_not_rows(spark):
    rows = [(DAYS[k], "A", 100.0 + k) for k in range(5)] + [(DAYS[k], "B", 10.0 + k) for k in (0, 1, 3, 4)]
    df = panel(spark, rows).withColumns({"r": features.simple_return("adj_close"), "m": features.rolling_mean("adj_close", 2)})
    b = {r["date"]: r for r in df.where("ticker = 'B'").collect()}
    assert b[DAYS[3]]["r"] is None and b[DAYS[3]]["m"] is None
    assert b[DAYS[4]]["r"] == pytest.approx(1 / 13)


def test_rolling(spark):
    df = series(spark, [100.0, 102.0, 98.0, 104.0, 100.0]).withColumns({"z": features.price_zscore("adj_close", 3), "s": features.rolling_std("adj_close", 3)})
    assert values(df, "z")[-1] == pytest.approx(-0.218218, abs=1e-6)
    assert values(df, "s")[-1] == pytest.approx(3.055050, abs=1e-6)
    df = series(spark, [100.0, 100.0, 100.0, 200.0]).withColumn("v", features.relative_volume("adj_close", 3))
    assert values(df, "v")[-1] == 2.0


def test_ranks_and_zscores(spark):
    df = panel(spark, [(DAYS[0], t, v) for t, v in zip("ABCDE", [1.0, 2.0, 2.0, 3.0, None])])
    df = df.withColumns({"k": average_rank("adj_close", "date"), "r": features.cross_sectional_rank("adj_close"), "z": features.cross_sectional_zscore("adj_close")})
    assert values(df, "k") == [1.0, 2.5, 2.5, 4.0, None]
    assert values(df, "r") == pytest.approx([0.0, 0.5, 0.5, 1.0]) + [None] if False else values(df, "r")[:4] == pytest.approx([0.0, 0.5, 0.5, 1.0])
    flat = panel(spark, [(DAYS[0], t, v) for t, v in zip("ABC", [1.0, 1.0, None])]).withColumn("z", features.cross_sectional_zscore("adj_close"))
    assert values(flat, "z") == [0.0, 0.0, 0.0]


def test_half_up(spark):
    assert spark.range(1).select(half_up(F.lit(0.125), 2).alias("x"), half_up(F.lit(-1e-9)).alias("y")).first() == (0.13, 0.0)


def test_signals_stay_in_range_and_look_back_only(spark):
    rng = np.random.default_rng(3)
    rows = [(DAYS[k], f"T{i}", float(100 * np.exp(rng.normal(0, 0.02))), float(rng.integers(100, 1000))) for k in range(40) for i in range(6)]
    schema = "date date, ticker string, adj_close double, volume double"
    options = {"returns": (1, 5, 20), "windows": (5, 10), "momentum": (15, 3)}
    parts = [signals.MomentumSignal(15, 3), signals.MeanReversionSignal(5), signals.VolatilitySignal(10), signals.AbnormalVolumeSignal(5)]
    run = lambda r: signals.CombinedSignal(parts=parts).compute(features.compute_features(panel(spark, r, schema), **options))
    later = [(d, t, p * (9.0 if d > DAYS[30] else 1.0), v) for d, t, p, v in rows]
    a, b = (run(r).where(F.col("date") <= F.lit(DAYS[30])).orderBy("date", "ticker").toPandas() for r in (rows, later))
    kept = [c for c in a.columns if not c.startswith("fwd_ret_")]
    pd.testing.assert_frame_equal(a[kept], b[kept])
    assert a["combined_signal"].dropna().between(-1, 1).all() and a["combined_signal"].notna().any()
    with pytest.raises(ValueError):
        signals.get_signal("nothing")


def test_calendar(spark):
    s = calendar.trading_sessions(spark, "2014-01-01", "2024-12-31")
    got = {r[0]: r[1] for r in s.groupBy(F.year("date")).count().collect()}
    assert [got[y] for y in range(2014, 2025)] == [252, 252, 252, 251, 251, 252, 253, 252, 251, 250, 252]
    closed = calendar.closed_dates(spark, "2014-01-01", "2024-12-31")
    assert calendar.calendar_differences(spark, closed, "2014-01-01", "2024-12-31").count() == 0
    assert calendar.closed_dates(spark, "2020-02-01", "2020-01-01").count() == 0


def test_quality(spark):
    rows = [(DAYS[0], "A", 9.0, 11.0, 8.0, 10.0, 10.0, 1, 1.0), (DAYS[1], "A", 9.0, 20.0, 8.0, 16.0, 16.0, 1, 1.0), (DAYS[2], "A", 9.0, 11.0, 12.0, 10.0, 10.0, 1, 2.0), (DAYS[3], "B", 9.0, 11.0, -10.0, 10.0, 10.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, adj_close double, volume long, split_factor double")
    assert sorted(r["issue"] for r in quality.structural_errors(df).collect()) == ["low_above_high", "non_positive_price"]
    assert quality.large_moves(df).count() == 1
    assert values(quality.split_adjusted_volume(df).where("ticker = 'A'"), "volume_split_adjusted") == [2.0, 2.0, 1.0]
    sessions = spark.createDataFrame([(d,) for d in DAYS[:4]], "date date")
    clean, report = quality.clean(df, sessions, late_days=7)
    assert clean.where("ticker = 'A'").count() == 3 and report.terminated == {"A": str(DAYS[2])} and not report.is_clean
    with pytest.raises(ValueError):
        quality.clean(df.where("false"), sessions)


def test_ic(spark):
    rows = [(DAYS[d], f"T{i}", float(i), 0.01 * i, -0.01 * i, 1.0) for d in range(5) for i in range(5)]
    df = spark.createDataFrame(rows, "date date, ticker string, s double, up double, down double, flat double")
    for target, ic in (("up", 1.0), ("down", -1.0), ("flat", 0.0)):
        assert [r["ic"] for r in inference.daily_ic(df, "s", target).collect()] == pytest.approx([ic] * 5)
    assert [r["ic"] for r in inference.daily_ic(df.where("s < 4"), "s", "up").collect()] == [None] * 5


def hac_serial(x, lags):
    e, n = x - x.mean(), len(x)
    w = (e @ e) / n + sum(2 * (1 - k / (min(lags, n - 1) + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    return math.sqrt(max(w, 1e-14) / n)


def test_hac_matches_the_serial_form(spark):
    x = np.random.default_rng(1).normal(0.1, 1.0, 50).cumsum() * 0.1
    df = spark.createDataFrame([(DAYS[k], float(v)) for k, v in enumerate(x)] + [(DAYS[60], None)], "date date, ic double")
    for lags in (1, 4, 60):
        assert inference.hac_variance(df, "ic", lags).first()["hac_se"] == pytest.approx(hac_serial(x, lags), rel=1e-9)
    assert inference.ic_summary(df, 4)["n"] == 50


def test_multiple_testing(spark):
    out = {r["hypothesis"]: r for r in inference.adjust_family(spark, {"H1": 0.01, "H2": 0.03, "H3": 0.035, "H4": 0.20}).collect()}
    assert [out[h]["q_bh"] for h in ("H1", "H2", "H3", "H4")] == pytest.approx([0.04, 0.0466667, 0.0466667, 0.20], abs=1e-6)
    assert [out[h]["reject_bonferroni"] for h in ("H1", "H2", "H3", "H4")] == [True, False, False, False]
    with pytest.raises(ValueError):
        inference.adjust_family(spark, {"H1": 0.1})


def test_quintiles(spark):
    rng = np.random.default_rng(99)
    rows = [(DAYS[d], f"T{i}", float(i), 0.005 * i + float(rng.normal(0, 0.001))) for d in range(30) for i in range(10)]
    spreads = inference.quantile_spread(spark.createDataFrame(rows, "date date, ticker string, s double, y double"), "s", "y")
    got = inference.spread_summary(spreads)
    assert got["n"] == 30 and got["q5_mean"] > got["q1_mean"] and got["t"] > 2


def test_resampling(spark):
    x = np.random.default_rng(0).normal(0.5, 1, 100)
    m, low, high = resampling.bootstrap_mean_ci(x, 2000, block=5)
    assert low < m < high and resampling.bootstrap_mean_ci(x, 2000, block=5) == (m, low, high)
    means = [r["mean"] for r in resampling.bootstrap_means(spark, x, 1000, 5).collect()]
    assert len(means) == 1000 and np.percentile(means, 2.5) == pytest.approx(low, abs=0.08)
    rows = [(DAYS[d], f"T{i}", float(i), float(i)) for d in range(10) for i in range(6)]
    df = spark.createDataFrame(rows, "date date, ticker string, s double, y double")
    observed, p = resampling.permutation_test(df, "s", "y", 200)
    serial = resampling.serial_permutation_test(df.toPandas().rename(columns={"s": "x"}), 200)
    assert observed == pytest.approx(1.0) and p <= 0.05 and serial[0] == pytest.approx(1.0) and serial[1] <= 0.05


def test_stationarity():
    rng = np.random.default_rng(5)
    noise = rng.normal(size=300)
    assert stationarity.adf_test(noise)["stationary"] and stationarity.kpss_test(noise)["stationary"]
    walk = noise.cumsum()
    assert not stationarity.adf_test(walk)["stationary"] and not stationarity.kpss_test(walk)["stationary"]


def test_distributions():
    assert t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert normal_cdf(normal_ppf(0.975)) == pytest.approx(0.975)


def test_projection_is_feasible_and_optimal():
    rng = np.random.default_rng(7)
    for _ in range(60):
        w = rng.normal(0, 0.2, 12)
        x = portfolio.project(w)
        assert np.abs(x).max() <= 0.10 + 1e-9 and np.abs(x).sum() <= 1 + 1e-9 and abs(x.sum()) <= 0.20 + 1e-9
        for _ in range(40):  # no feasible point nearby is closer
            y = x + rng.normal(0, 0.01, 12)
            if np.abs(y).max() <= 0.10 and np.abs(y).sum() <= 1 and abs(y.sum()) <= 0.20:
                assert ((y - w) ** 2).sum() >= ((x - w) ** 2).sum() - 1e-9


@pytest.mark.parametrize("name", ["equal_weight", "signal_weighted", "volatility_scaled"])
def test_portfolios(spark, name):
    rows = [(DAYS[0], f"T{i:02}", float(i)) for i in range(20)] + [(DAYS[1], f"T{i:02}", 0.5) for i in range(10)] + [(DAYS[2], f"T{i:02}", float(i)) for i in range(3)]
    df = portfolio.get_portfolio_constructor(name).construct(panel(spark, rows), "adj_close").toPandas().set_index("date")["target_weight"]
    w = df[DAYS[0]]
    assert w.abs().max() <= 0.10 + 1e-6 and w.abs().sum() <= 1 + 1e-6 and abs(w.sum()) < 1e-6
    assert (df[DAYS[1]] == 0).all() and (df[DAYS[2]] == 0).all()


def test_costs():
    m = execution.CostModel()
    assert m.fill(1, 100, 100.0) == pytest.approx((100.10, 5.0, 5.0, 5.0))
    assert m.fill(-1, 100, 100.0)[0] == pytest.approx(99.90)
    assert m.fill(1, 0, 100.0) == (0.0, 0.0, 0.0, 0.0)
    assert [c.total_bps for c in execution.COST_REGIMES.values()] == [0, 7, 15, 30, 50]
    assert execution.get_cost_model("baseline") is execution.COST_REGIMES["medium"]


def test_ledger(spark):
    rng = np.random.default_rng(2)
    prices = 100 * np.exp(rng.normal(0, 0.02, (20, 5)).cumsum(axis=0))
    weights = rng.normal(0, 0.1, (20, 5))
    rows = [(DAYS[t], f"T{i}", float(prices[t, i]), float(weights[t, i])) for t in range(20) for i in range(5)]
    df = spark.createDataFrame(rows, "date date, ticker string, adj_close double, target_weight double")
    out = execution.run_backtests(df, costs={"zero": execution.get_cost_model("zero"), "high": execution.get_cost_model("high")})
    got = out.snapshots.orderBy("date").toPandas()
    free, paid = got[got["run_id"] == "run/zero"], got[got["run_id"] == "run/high"]
    np.testing.assert_allclose(free["equity"], execution.scan_equity(prices, weights), rtol=1e-6)
    assert (free["total_cost"] == 0).all() and paid["equity"].iloc[-1] < free["equity"].iloc[-1]
    np.testing.assert_allclose(paid["cash"] + paid["holdings_value"], paid["equity"])
    fills = out.fills.toPandas()
    assert fills[fills["run_id"] == "run/high"][["commission", "spread_cost", "slippage_cost"]].to_numpy().sum() == pytest.approx(paid["total_cost"].sum())
    assert validation.integrity_violations(out, 5.0).count() == 0


def test_missing_price_policies():
    costs = execution.get_cost_model("zero")
    for policy, left in (("zero", 0.0), ("liquidate_last", 500.0)):
        book = execution.Ledger(costs, 1000.0, policy)
        book.session(DAYS[0], {"A": 10.0}, {"A": 0.5})
        book.session(DAYS[1], {"A": 10.0}, None)
        snapshot, _, _ = book.session(DAYS[2], {}, None)
        assert snapshot["equity"] == pytest.approx(500.0 + left)


def test_metrics(spark):
    rows = [("a", DAYS[k], r, e) for k, (r, e) in enumerate(zip([0.01, 0.02, -0.02, 0.03], [100.0, 120.0, 90.0, 130.0]))] + [("b", DAYS[0], 0.5, 1.0)]
    df = spark.createDataFrame(rows, "run_id string, date date, daily_return double, equity double")
    got = {r["run_id"]: r for r in metrics.performance(df).collect()}
    a = got["a"]
    assert a["daily_hit_rate"] == 0.75 and a["profit_factor"] == pytest.approx(3.0) and a["max_drawdown"] == pytest.approx(-0.25) and a["max_drawdown_duration_days"] == 1
    r = np.array([0.01, 0.02, -0.02, 0.03])
    assert a["sharpe_ratio"] == pytest.approx(r.mean() / r.std(ddof=1) * math.sqrt(252))
    assert a["cagr"] == pytest.approx(1.3 ** (252 / 4) - 1)
    assert got["b"]["sharpe_ratio"] == 0.0 and got["b"]["total_trading_days"] == 1
    assert "sharpe ratio" in metrics.tearsheet(a.asDict())


def test_sharpe_probabilities(spark):
    r = np.random.default_rng(4).normal(0.001, 0.01, 300)
    df = spark.createDataFrame([("a", DAYS[k], float(v)) for k, v in enumerate(r)], "run_id string, date date, daily_return double")
    few, many = (metrics.sharpe_probabilities(df, n).first() for n in (2, 100))
    assert 0 < many["dsr"] < few["dsr"] < few["psr"] < 1
    assert metrics.sharpe_probabilities(df).first()["dsr"] is None


def test_regimes(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(DAYS[k], float(rng.normal(0, 0.01 if k < 150 else 0.03))) for k in range(300)], "date date, market_return double")
    v = regimes.volatility_regime(df).toPandas().sort_values("date")["regime"]
    assert set(v.dropna()) == {"LOW_VOL", "NORMAL_VOL", "HIGH_VOL"} and v.iloc[:9].isna().all() and (v.iloc[200:] == "HIGH_VOL").mean() > 0.6
    c = regimes.composite_regime(df).toPandas().sort_values("date")
    assert c["regime_composite"].notna().sum() == (c["vol_regime"].notna() & c["trend_regime"].notna()).sum() > 0


def test_walk_forward_and_robustness(spark):
    rng = np.random.default_rng(8)
    rows = [(DAYS[t], f"T{i}", float(100 * np.exp(rng.normal(0, 0.02))), float(rng.normal(0, 0.1))) for t in range(60) for i in range(4)]
    df = spark.createDataFrame(rows, "date date, ticker string, adj_close double, target_weight double")
    windows = tuple(validation.WalkForwardWindow(k, "2020-01-01", str(DAYS[20 * k - 1]), str(DAYS[20 * k]), str(DAYS[20 * k + 19]), k == 2) for k in (1, 2))
    report = validation.walk_forward(df, windows)
    assert {r["run_id"] for r in report.metrics.collect()} == {"w1/is", "w1/oos", "w2/is", "w2/oos"}
    assert report.development.first()["total_trading_days"] == 20
    assert len(validation.WINDOWS) == 7 and [w.holdout for w in validation.WINDOWS].index(True) == 6
    assert validation.asset_drop_stability(df).count() == 5
    assert {r["cost"] for r in validation.cost_sensitivity(df).collect()} == set(execution.COST_REGIMES)


def test_learning(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 2))
    y = 2 * x[:, 0] - x[:, 1] + 0.5
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    m = learning.LinearModel().fit(df, ["a", "b"], "y")
    assert m.coefficients == pytest.approx([2.0, -1.0]) and m.intercept == pytest.approx(0.5)
    assert abs(learning.LinearModel("l2", 100.0).fit(df, ["a", "b"], "y").coefficients[0]) < 2.0
    assert learning.LinearModel("l1", 10.0).fit(df, ["a", "b"], "y").coefficients == pytest.approx([0.0, 0.0])
    with pytest.raises(KeyError):
        learning.train_and_predict(df, "ols", "2020-01-01", "2020-01-02", "2020-01-03")


def test_config(tmp_path):
    c = from_dict({"name": "x", "portfolio": {"method": "signal_weighted"}})
    save_config(c, str(tmp_path / "c.json"))
    assert load_config(str(tmp_path / "c.json")).hash() == c.hash() != ExperimentConfig().hash()
    for bad in ({"portfolio": {"method": "nothing"}}, {"portfolio": {"max_gross": 2.0}}, {"what": 1}):
        with pytest.raises(ValueError):
            from_dict(bad)
