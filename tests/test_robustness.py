"""Robustness checks, model comparison, audit, registry, empty series, and how often plans do their work."""

from datetime import date, timedelta
from types import SimpleNamespace

import numpy as np
import pytest

from panelspark.operators import execution, inference, learning, validation
from panelspark.plans.queries import QUERIES

DAYS = [date(2020, 1, 1) + timedelta(days=k) for k in range(80)]
SF = "/root/testdata/sf0.001"


def weights(spark, n=80, tickers=6):
    rng = np.random.default_rng(3)
    rows = [(DAYS[t], f"T{i}", float(100 * np.exp(rng.normal(0, 0.02))), float(rng.normal(0, 0.1))) for t in range(n) for i in range(tickers)]
    return spark.createDataFrame(rows, "date date, ticker string, adj_close double, target_weight double")


def test_pnl_bootstrap():
    r = np.random.default_rng(1).normal(0.001, 0.01, 300)
    got = validation.pnl_bootstrap(r, 300)
    own = r.mean() / r.std(ddof=1) * np.sqrt(252)
    assert got["sharpe"][0] < own < got["sharpe"][1] and got["cagr"][0] < got["cagr"][1]
    assert got == validation.pnl_bootstrap(np.concatenate([r, [np.nan]]), 300)
    assert validation.pnl_bootstrap(r[:5])["sharpe"] == (0.0, 0.0)


def test_robustness_suite(spark):
    got = validation.robustness_suite(weights(spark), split="2020-02-01")
    assert {r["cost"] for r in got["costs"].collect()} == set(execution.COST_REGIMES)
    assert {r["run_id"]: r["total_trading_days"] for r in got["subperiods"].collect()} == {"pre": 31, "post": 49}
    assert got["jackknife"].count() == 5 and got["trimmed"].first()["total_trading_days"] == 70
    drags = {r["cost"]: r["cost_drag_bps"] for r in got["costs"].collect()}
    assert drags["zero"] == pytest.approx(0, abs=1e-6) and drags["very_high"] > drags["low"] > 0
    assert set(got["bootstrap"]) == {"sharpe", "cagr"}


def test_compare_with_baseline(spark):
    rng = np.random.default_rng(5)
    rows = [(DAYS[d], f"T{i}", float(y), float(y + rng.normal(0, 0.5)), float(rng.normal())) for d in range(40) for i in range(12) for y in [rng.normal()]]
    df = spark.createDataFrame(rows, "date date, ticker string, y double, good double, noise double")
    got = learning.compare_with_baseline(df, "good", "noise", "y", 5)
    assert got["n"] == 40 and got["mean_ic"] > 0.6 > abs(got["baseline_ic"]) and got["delta_ic"] == pytest.approx(got["mean_ic"] - got["baseline_ic"])
    assert got["t"] > 3 and got["p"] < 0.01
    same = learning.compare_with_baseline(df, "good", "good", "y", 5)
    assert same["delta_ic"] == 0 and (same["t"], same["p"]) == (0.0, 1.0)


def test_audit(spark):
    fills = [("r", DAYS[0], "A"), ("r", DAYS[5], "A"), ("r", DAYS[6], "B"), ("r", DAYS[7], "A")]
    snaps = [("r", DAYS[k], 100.0, 50.0, 50.0 if k != 3 else 49.0, 1.0 if k != 4 else 1.2, 0.1 if k != 5 else -0.3) for k in range(8)]
    result = SimpleNamespace(
        fills=spark.createDataFrame(fills, "run_id string, date date, ticker string"),
        snapshots=spark.createDataFrame(snaps, "run_id string, date date, equity double, cash double, holdings_value double, gross_exposure double, net_exposure double"),
    )
    found = {(r["date"], r["problem"]) for r in validation.integrity_violations(result, ended={"A": DAYS[5]}, blocked=["B"], max_net=0.2).collect()}
    assert found == {(DAYS[0], "trade_on_first_session"), (DAYS[7], "trade_after_termination"), (DAYS[6], "blocked_ticker"), (DAYS[3], "books"), (DAYS[4], "gross_exposure"), (DAYS[5], "net_exposure")}


def test_registry():
    r = inference.Registry()
    assert [h.id for h in r.hypotheses] == ["H1_MOMENTUM", "H2_MEAN_REVERSION", "H3_LOW_VOLATILITY", "H4_ABNORMAL_VOLUME"]
    assert r.get("H1_MOMENTUM") is r.get("H1") is r.get("momentum_12_1") and r.get("low_vol").target == "fwd_ret_20d"
    assert r.get("H2").as_predicted(0.01) and not r.get("H2").as_predicted(-0.01) and r.family_size == 4
    with pytest.raises(KeyError):
        r.get("H9")


def test_series_without_ics(spark):
    none = spark.createDataFrame([("a", DAYS[0], None), ("b", DAYS[0], 0.5), ("b", DAYS[1], 0.1)], "k string, date date, ic double")
    one = inference.ic_statistics(none.where("k = 'a'"), 5).first()
    assert one["n"] == 0 and one["mean_ic"] is None and one["hac_se"] is None and one["hit_rate"] is None
    both = {r["k"]: r for r in inference.ic_statistics(none, 5, ["k"]).collect()}
    assert both["a"]["n"] == 0 and both["b"]["n"] == 2 and both["b"]["hit_rate"] == 1.0
    assert np.isnan(inference.ic_summary(none.where("false"), 5)["mean_ic"])


@pytest.mark.parametrize("name", ["backtest_metrics", "cost_sensitivity", "walk_forward", "asset_drop_stability", "subperiods"])
def test_a_backtest_query_folds_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "lineitem" not in plan  # bars are a table by then


def test_daily_maps(spark):
    days = {r["date"]: r for r in execution.run_backtests(weights(spark, 4, 3)).daily_maps().collect()}
    assert set(days[DAYS[1]]["positions"]) == {"T0", "T1", "T2"} == set(days[DAYS[1]]["weights"]) and DAYS[0] not in days


def test_ordinal_spearman():
    from panelspark.operators.resampling import ordinal_spearman

    x = np.array([[3.0, 1.0, 2.0, 4.0], [1.0, 1.0, 2.0, 3.0]])
    y = np.array([[30.0, 10.0, 20.0, 40.0], [4.0, 3.0, 2.0, 1.0]])
    assert ordinal_spearman(x, y) == pytest.approx([1.0, -1.0])  # ties rank in order of place


@pytest.mark.parametrize(("name", "rows"), [("bootstrap_mean", 0), ("permutation_test", 0), ("pnl_bootstrap", 2)])
def test_queries_of_series_without_values(spark, name, rows):
    assert QUERIES[name](spark, SF).count() == rows  # no signal has its history at this size


def test_models_of_no_rows(spark):
    none = spark.createDataFrame([], "a double, y double")
    some = spark.createDataFrame([(1.0, 2.0)], "a double, y double")
    for name in ("ols", "xgboost"):
        assert learning.get_model(name).fit(none, ["a"], "y").predict(some).first()["prediction"] is None
