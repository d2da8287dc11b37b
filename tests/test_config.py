"""Experiment settings and their files."""

import hashlib
import json

import pytest

from panelspark.operators import portfolio, signals
from panelspark.sources.config import SETTINGS, ExperimentConfig, from_dict, load_config, save_config

FILE = """
experiment_id: "weighted_v1"
random_seed: 42
data: {universe: "sp100_20140101", start_date: "2014-01-01", end_date: "2024-12-31", data_source: "yfinance"}
signal:
  name: "combined_signal"
  params:
    weights: {momentum_12_1: 0.25, mean_reversion_zscore: 0.25, low_vol: 0.25, abnormal_volume: 0.25}
  forward_horizon: 20
  hypothesis_type: "confirmatory"
  ranking_method: "percentile"
costs: {commission_bps: 5, spread_bps: 5.0, slippage_bps: 5.0, min_commission: 0.0}
portfolio: {method: "vol_scaled", gross_exposure: 1.0, max_position_weight: 0.10, max_net_exposure: 0.20}
backtest: {initial_cash: 1000000.0, execution_price: "next_adj_close"}
walk_forward: {min_train_years: 3, val_years: 1, test_years: 1, step_years: 1, method: "expanding", final_holdout: true}
output_dir: "results/experiments/weighted_v1"
"""


def test_defaults():
    c = ExperimentConfig()
    assert dict(c.section("portfolio"))["method"] == "vol_scaled" and c["backtest.initial_cash"] == 1e6 and c["walk_forward.final_holdout"] is True
    assert all(c[k] == v for k, v in SETTINGS.items())


def test_experiment_file(tmp_path):
    (tmp_path / "a.yaml").write_text(FILE)
    c = load_config(str(tmp_path / "a.yaml"))
    assert c["experiment_id"] == "weighted_v1" and c["costs.commission_bps"] == 5.0
    assert isinstance(c.signal(), signals.CombinedSignal) and c.signal().weights["volatility_signal"] == 0.25
    assert isinstance(c.constructor(), portfolio.InverseVolatilitySignalWeighted) and c.costs().total_bps == 15
    assert [(w.train_end, w.test_start, w.holdout) for w in c.windows()][-1] == ("2023-12-31", "2024-01-01", True) and len(c.windows()) == 7
    # the hash is that of all settings as nested JSON with sorted keys
    assert c.hash() == hashlib.sha256(json.dumps(c.to_dict(), sort_keys=True).encode()).hexdigest()
    assert set(c.to_dict()) == {"experiment_id", "random_seed", "output_dir", "data", "signal", "costs", "portfolio", "backtest", "walk_forward"}
    (tmp_path / "named.yaml").write_text("signal: {name: low_vol, params: {lookback: 60}}\n")
    named = load_config(str(tmp_path / "named.yaml"))
    assert named["experiment_id"] == "named" and named["output_dir"].endswith("/named") and named.signal().window == 60


@pytest.mark.parametrize("suffix", ["yaml", "json"])
def test_round_trip(tmp_path, suffix):
    c = from_dict({"experiment_id": "x", "random_seed": 123, "costs": {"regime": "high"}, "signal": {"name": "abnormal_volume", "params": {"volume_lookback": 20, "volume_threshold": None, "direction_horizon": 1}}})
    save_config(c, str(tmp_path / "sub" / f"c.{suffix}"))
    again = load_config(str(tmp_path / "sub" / f"c.{suffix}"))
    assert again.hash() == c.hash() != ExperimentConfig().hash() and again.costs().total_bps == 30 and again.signal().window == 20


def test_refused():
    with pytest.raises(ValueError, match=r"Gross exposure \(1.5\) exceeds 1.0"):
        from_dict({"portfolio": {"gross_exposure": 1.5}})
    for bad in ({"portfolio": {"what": 1}}, {"random_seed": "x"}, {"walk_forward": {"final_holdout": 1}}, {"signal": {"name": "nothing"}}, {"data": 3}, {"costs": {"regime": "odd"}}):
        with pytest.raises(ValueError):
            from_dict(bad)
    assert from_dict({"signal": {"name": "ml_xgboost", "params": {"max_depth": 3}}})["signal.name"] == "ml_xgboost"
