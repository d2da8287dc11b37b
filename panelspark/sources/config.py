"""Experiment settings: a flat table of dotted keys with their defaults, and YAML or JSON files that set some of them.

A file nests the keys (`portfolio: {method: equal_weight}` sets `portfolio.method`). Keys that the table lacks, values
of another type than the default's, and values that break a rule raise ValueError.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping
from pathlib import Path

#: The keys of experiment files, and what holds where a file says nothing.
SETTINGS = {
    "experiment_id": "default_experiment", "random_seed": 42, "output_dir": "results/experiments/default",
    "data.universe": "sp100_20140101", "data.start_date": "2014-01-01", "data.end_date": "2024-12-31", "data.data_source": "yfinance",
    "data.raw_dir": "data/raw", "data.processed_dir": "data/processed", "data.universe_dir": "data/universe",
    "signal.name": "momentum_12_1", "signal.params": {"lookback": 252, "skip": 21}, "signal.forward_horizon": 20,
    "signal.hypothesis_type": "confirmatory", "signal.ranking_method": "percentile",
    "costs.commission_bps": 5.0, "costs.spread_bps": 5.0, "costs.slippage_bps": 5.0, "costs.min_commission": 0.0,
    "portfolio.method": "vol_scaled", "portfolio.gross_exposure": 1.0, "portfolio.max_position_weight": 0.10, "portfolio.max_net_exposure": 0.20,
    "portfolio.long_quantile": 5, "portfolio.short_quantile": 1, "portfolio.n_quantiles": 5,
    "backtest.initial_cash": 1_000_000.0, "backtest.execution_price": "next_adj_close",
    "walk_forward.min_train_years": 3, "walk_forward.val_years": 1, "walk_forward.test_years": 1, "walk_forward.step_years": 1,
    "walk_forward.method": "expanding", "walk_forward.final_holdout": True,
}
#: Settings of this engine alone; they count in a configuration's hash only where they are set.
EXTRA = {"data.panel": "data/panel.parquet", "data.price": "adj_close", "costs.regime": "", "backtest.rebalance_frequency": 1, "walk_forward.trials": 0}
OTHER_NAMES = {
    "name": "experiment_id", "seed": "random_seed", "signal.horizon": "signal.forward_horizon", "backtest.initial_capital": "backtest.initial_cash",
    "portfolio.max_position": "portfolio.max_position_weight", "portfolio.max_gross": "portfolio.gross_exposure", "portfolio.max_net": "portfolio.max_net_exposure",
}
#: What a signal's settings are called in files, and here.
PARAMS = {
    "momentum": {"lookback": "total", "lookback_days": "total", "skip_days": "skip"},
    "mean_reversion": {"lookback": "window", "lookback_days": "window"},
    "volatility": {"lookback": "window", "lookback_days": "window"},
    "abnormal_volume": {"volume_lookback": "window", "volume_threshold": "threshold"},
}


def _defaults() -> dict:
    return SETTINGS | EXTRA


def _flat(raw: Mapping, known: Mapping, above: str = "") -> Iterator[tuple[str, object]]:
    for name, value in raw.items():
        key = OTHER_NAMES.get(above + name, above + name)
        if key in known:
            yield key, value
        elif any(k.startswith(f"{key}.") for k in known) and (value is None or isinstance(value, Mapping)):
            yield from _flat(value or {}, known, f"{key}.")
        else:
            raise ValueError(f"unknown setting {key!r}")


def _typed(key: str, value, default):
    if isinstance(default, float) and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if type(value) is not type(default):
        raise ValueError(f"{key} is of type {type(default).__name__}, not {type(value).__name__}")
    return value


class ExperimentConfig(Mapping):
    """All settings by dotted key; what is given replaces defaults."""

    def __init__(self, given: Mapping | None = None):
        known = _defaults()
        self._values = known | {k: _typed(k, v, known[k]) for k, v in _flat(given or {}, known)}
        self._check()

    def __getitem__(self, key: str):
        return self._values[key]

    def __iter__(self):
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def _check(self) -> None:
        from panelspark.operators.execution import get_cost_model
        from panelspark.operators.learning import get_model
        from panelspark.operators.portfolio import get_portfolio_constructor
        from panelspark.operators.signals import get_signal

        gross = self["portfolio.gross_exposure"]
        if not 0 < gross <= 1.0:
            raise ValueError(f"Gross exposure ({gross}) exceeds 1.0 or is none: positions are not leveraged")
        name = self["signal.name"]
        get_model(name.removeprefix("ml_")) if name.startswith("ml_") else get_signal(name)
        get_portfolio_constructor(self["portfolio.method"])
        if self["costs.regime"]:
            get_cost_model(self["costs.regime"])

    def section(self, name: str) -> dict:
        return {k.partition(".")[2]: v for k, v in self.items() if k.startswith(f"{name}.")}

    def to_dict(self) -> dict:
        """Nested, as in a file."""
        out: dict = {}
        for key, value in self.items():
            if key in SETTINGS or value != EXTRA[key]:
                above, _, name = key.rpartition(".")
                (out.setdefault(above, {}) if above else out)[name] = value
        return out

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()

    def signal(self):
        """The configured signal."""
        from panelspark.operators.signals import CombinedSignal, get_signal

        kind = type(get_signal(self["signal.name"]))
        method = {"percentile": "rank"}.get(self["signal.ranking_method"], self["signal.ranking_method"])
        given = self["signal.params"]
        if kind is CombinedSignal:
            weights = {get_signal(k).name: float(w) for k, w in given.get("weights", {}).items()}
            return CombinedSignal(weights=weights) if weights else CombinedSignal()
        names = PARAMS[kind.name.removesuffix("_signal")]
        options = {names.get(k, k): v for k, v in given.items()}
        if options.pop("direction_horizon", 1) != 1:
            raise ValueError("abnormal volume takes the direction of one session")
        return kind(method=method, **options)

    def costs(self):
        from panelspark.operators.execution import CostModel, get_cost_model

        own = self.section("costs")
        regime = own.pop("regime")
        return get_cost_model(regime) if regime else CostModel(**own)

    def constructor(self):
        from panelspark.operators.portfolio import EqualWeightLongShort, get_portfolio_constructor

        limits = {"max_position": self["portfolio.max_position_weight"], "max_gross": self["portfolio.gross_exposure"], "max_net": self["portfolio.max_net_exposure"]}
        method = self["portfolio.method"]
        if isinstance(get_portfolio_constructor(method), EqualWeightLongShort):
            limits["quantile"] = 1.0 / self["portfolio.n_quantiles"]
        return get_portfolio_constructor(method, **limits)

    def windows(self) -> tuple:
        """The walk-forward windows: tests of test_years each after min_train_years, every step_years."""
        from panelspark.operators.validation import WalkForwardWindow

        own, first, last = self.section("walk_forward"), int(self["data.start_date"][:4]), int(self["data.end_date"][:4])
        starts = range(first + own["min_train_years"] + own["val_years"], last - own["test_years"] + 2, own["step_years"])
        begins = lambda y: f"{y - own['min_train_years'] - own['val_years'] if own['method'] == 'rolling' else first}-01-01"
        return tuple(
            WalkForwardWindow(k, begins(y), f"{y - 1}-12-31", f"{y}-01-01", f"{y + own['test_years'] - 1}-12-31", own["final_holdout"] and y == starts[-1]) for k, y in enumerate(starts, 1)
        )


def from_dict(raw: Mapping) -> ExperimentConfig:
    return ExperimentConfig(raw)


def load_config(path: str) -> ExperimentConfig:
    """Of a YAML or JSON file, whose name is the experiment's where it gives none."""
    file = Path(path)
    text = file.read_text(encoding="utf-8")
    if file.suffix == ".json":
        raw = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need the yaml package; JSON files do not") from e
        raw = yaml.safe_load(text) or {}
    named = {"experiment_id": file.stem, "output_dir": f"results/experiments/{file.stem}"}
    return ExperimentConfig({k: v for k, v in named.items() if k not in {OTHER_NAMES.get(r, r) for r in raw}} | raw)


def save_config(config: ExperimentConfig, path: str) -> None:
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    if file.suffix == ".json":
        file.write_text(json.dumps(config.to_dict(), indent=2, sort_keys=True), encoding="utf-8")
    else:
        import yaml

        file.write_text(yaml.safe_dump(config.to_dict(), sort_keys=False), encoding="utf-8")
