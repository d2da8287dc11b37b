"""Transaction costs and the execution ledger.

Orders made at a session's close fill at the next one's. The state (cash, shares, pending orders) makes a run a
sequence, so a run is one group of one task, a row a session; runs (constructors, cost models, windows, samples) are
the parallelism. A run's panel is sessions x tickers numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASH = 1e7
DUST_NOTIONAL = 10.0
DUST_SHARES = 1e-6
#: A change of equity by this share or less is what sums of doubles leave, and no return.
ROUNDING = 1e-12


@dataclass(frozen=True)
class CostModel:
    """In basis points one way."""

    commission_bps: float = 5.0
    spread_bps: float = 5.0
    slippage_bps: float = 5.0
    min_commission: float = 0.0

    @property
    def total_bps(self) -> float:
        return self.commission_bps + self.spread_bps + self.slippage_bps

    def fill(self, side: int, quantity: float, price: float) -> tuple[float, float, float, float]:
        """(fill price, commission, spread cost, slippage cost); side +1 buys, -1 sells."""
        if not quantity > 0 or not price > 0:
            return 0.0, 0.0, 0.0, 0.0
        move = (self.spread_bps + self.slippage_bps) / 1e4
        at = price * (1.0 + move) if side > 0 else max(price * (1.0 - move), 0.01)
        notional = price * quantity
        return at, max(self.min_commission, notional * self.commission_bps / 1e4), notional * self.spread_bps / 1e4, notional * self.slippage_bps / 1e4

    def columns(self, side: Column, quantity: Column, price: Column) -> dict[str, Column]:
        """The same as column expressions."""
        ok = (quantity > 0) & (price > 0)
        move = F.lit((self.spread_bps + self.slippage_bps) / 1e4)
        zero = F.lit(0.0)
        pick = lambda c: F.when(ok, c).otherwise(zero)
        notional = price * quantity
        return {
            "fill_price": pick(F.when(side > 0, price * (1 + move)).otherwise(F.greatest(price * (1 - move), F.lit(0.01)))),
            "commission": pick(F.greatest(F.lit(self.min_commission), notional * F.lit(self.commission_bps / 1e4))),
            "spread_cost": pick(notional * F.lit(self.spread_bps / 1e4)),
            "slippage_cost": pick(notional * F.lit(self.slippage_bps / 1e4)),
        }


#: Commission, spread and slippage of each regime (0, 7, 15, 30 and 50 bps in all).
COST_REGIMES = {
    "zero": CostModel(0.0, 0.0, 0.0),
    "low": CostModel(2.0, 3.0, 2.0),
    "medium": CostModel(5.0, 5.0, 5.0),
    "high": CostModel(10.0, 10.0, 10.0),
    "very_high": CostModel(15.0, 15.0, 20.0),
}
COST_ALIASES = {"zero_cost": "zero", "low_cost": "low", "base_case": "medium", "baseline": "medium", "high_cost": "high", "extreme_cost": "very_high"}


def get_cost_model(name: str) -> CostModel:
    key = COST_ALIASES.get(name.lower(), name.lower())
    if key not in COST_REGIMES:
        raise ValueError(f"unknown cost regime {name!r}")
    return COST_REGIMES[key]


def cost_table(spark: SparkSession) -> DataFrame:
    rows = [(k, m.commission_bps, m.spread_bps, m.slippage_bps, m.min_commission) for k, m in COST_REGIMES.items()]
    return spark.createDataFrame(rows, "cost string, commission_bps double, spread_bps double, slippage_bps double, min_commission double")


@dataclass
class Ledger:
    """One run's state. missing_price: `zero` values a holding without a price at nothing that day; `liquidate_last`
    sells it at its last price once, for good."""

    costs: CostModel = field(default_factory=CostModel)
    cash: float = CASH
    missing_price: str = "zero"
    shares: dict[str, float] = field(default_factory=dict)
    last_price: dict[str, float] = field(default_factory=dict)
    pending: list[tuple[str, float, float]] = field(default_factory=list)
    equity: float = 0.0

    def __post_init__(self):
        self.equity = self.cash

    def session(self, date, prices: dict[str, float], weights: dict[str, float] | None) -> tuple[dict, list[dict], list[dict]]:
        """One session: fills, the mark, then orders if weights are given. Returns the snapshot, fills and holdings."""
        orders, self.pending = self.pending, []
        fills = []
        for ticker, quantity, weight in orders:
            p = prices.get(ticker)
            if p is not None and p > 0:
                fills.append(self._fill(date, ticker, quantity, p, weight))
        if self.missing_price == "liquidate_last":
            for t in [t for t in sorted(self.shares) if not prices.get(t) and t in self.last_price]:
                fills.append(self._fill(date, t, -self.shares[t], self.last_price[t], 0.0))
        self.last_price |= {t: p for t, p in prices.items() if p is not None and p > 0}
        values = {t: n * p for t, n in sorted(self.shares.items()) if (p := prices.get(t)) is not None and p > 0}
        long, short = sum(v for v in values.values() if v > 0), -sum(v for v in values.values() if v < 0)
        before, self.equity = self.equity, self.cash + sum(values.values())
        up = self.equity > 0
        change = self.equity - before if abs(self.equity - before) > ROUNDING * before else 0.0
        traded = sum(f["fill_price"] * f["quantity"] for f in fills)
        cost = {k: sum(f[k] for f in fills) for k in ("commission", "slippage_cost", "spread_cost")}
        snapshot = {
            "date": date, "equity": self.equity, "cash": self.cash, "holdings_value": long - short,
            "gross_exposure": (long + short) / self.equity if up else 0.0, "net_exposure": (long - short) / self.equity if up else 0.0,
            "cash_ratio": self.cash / self.equity if up else 1.0, "daily_return": change / before if before > 0 else 0.0,
            "turnover": traded / self.equity if up else 0.0, **cost, "total_cost": sum(cost.values()),
        }
        held = [{"date": date, "ticker": t, "shares": n, "weight": values.get(t, 0.0) / self.equity if up else 0.0} for t, n in sorted(self.shares.items())]
        if weights is not None:
            for t in sorted({*weights, *self.shares}):
                p = prices.get(t)
                if p is None or not p > 0:
                    continue
                change = weights.get(t, 0.0) * self.equity / p - self.shares.get(t, 0.0)
                if abs(change * p) >= DUST_NOTIONAL:
                    self.pending.append((t, change, weights.get(t, 0.0)))
        return snapshot, fills, held

    def _fill(self, date, ticker: str, quantity: float, price: float, weight: float) -> dict:
        side = 1 if quantity > 0 else -1
        n = abs(quantity)
        at, commission, spread, slippage = self.costs.fill(side, n, price)
        self.cash -= side * at * n + commission
        self.shares[ticker] = self.shares.get(ticker, 0.0) + side * n
        if abs(self.shares[ticker]) < DUST_SHARES:
            del self.shares[ticker]
        return {"date": date, "ticker": ticker, "direction": "BUY" if side > 0 else "SELL", "quantity": n, "reference_price": price, "fill_price": at, "commission": commission, "spread_cost": spread, "slippage_cost": slippage, "target_weight": weight}


NUMBERS = ("equity", "cash", "holdings_value", "gross_exposure", "net_exposure", "cash_ratio", "daily_return", "turnover", "commission", "slippage_cost", "spread_cost", "total_cost", "shares", "weight", "quantity", "reference_price", "fill_price", "target_weight")
FOLD = "run_id string, kind string, date date, ticker string, direction string, " + ", ".join(f"{c} double" for c in NUMBERS)


def simulate(pdf: pd.DataFrame, costs: CostModel, cash: float = CASH, every: int = 1, missing_price: str = "zero") -> pd.DataFrame:
    """The fold over one run's (date, ticker, price, target_weight) rows: tagged rows of kind snapshot, fill, holding."""
    ledger = Ledger(costs, cash, missing_price)
    out: list[dict] = []
    days = [*pdf.sort_values(["date", "ticker"]).groupby("date", sort=True)]
    for i, (day, rows) in enumerate(days):
        prices = {t: p for t, p in zip(rows["ticker"], rows["price"]) if p == p and p is not None}
        weights = {t: w for t, w in zip(rows["ticker"], rows["target_weight"]) if w == w and w is not None}
        trade = i < len(days) - 1 and i % every == 0
        snapshot, fills, held = ledger.session(day, prices, weights if trade else None)
        out.append({"kind": "snapshot", **snapshot})
        out += [{"kind": "fill", **f} for f in fills]
        out += [{"kind": "holding", **h} for h in held]
    df = pd.DataFrame(out, columns=["kind", "date", "ticker", "direction", *NUMBERS])
    for c in ("ticker", "direction"):  # also where no row has any
        df[c] = df[c].astype(object).where(df[c].notna(), None)
    return df.astype({c: "float64" for c in NUMBERS})


@dataclass(frozen=True)
class BacktestResult:
    """Of all runs: snapshots (run_id, date, ...), fills and holdings, in long form."""

    rows: DataFrame

    @property
    def snapshots(self) -> DataFrame:
        return self.rows.where("kind = 'snapshot'").select("run_id", "date", *NUMBERS[:12])

    @property
    def fills(self) -> DataFrame:
        return self.rows.where("kind = 'fill'").select("run_id", "date", "ticker", "direction", "quantity", "reference_price", "fill_price", "commission", "spread_cost", "slippage_cost", "target_weight")

    @property
    def holdings(self) -> DataFrame:
        return self.rows.where("kind = 'holding'").select("run_id", "date", "ticker", "shares", "weight")

    def daily_maps(self) -> DataFrame:
        """(run_id, date, positions, weights) with maps by ticker."""
        pairs = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", v))))
        return self.holdings.groupBy("run_id", "date").agg(pairs("shares").alias("positions"), pairs("weight").alias("weights"))


def run_backtests(weights: DataFrame, price: str = "adj_close", costs: dict[str, CostModel] | CostModel | None = None, cash: float = CASH, every: int = 1, missing_price: str = "zero") -> BacktestResult:
    """weights: (date, ticker, price, target_weight), with run_id for several runs. costs: one model for all, or models
    by name, each of which makes a run `run_id/name` of every run."""
    models = costs if isinstance(costs, dict) else {"": costs or COST_REGIMES["medium"]}
    df = weights if "run_id" in weights.columns else weights.withColumn("run_id", F.lit("run"))
    df = df.select("run_id", F.col("date").cast("date").alias("date"), "ticker", F.col(price).cast("double").alias("price"), F.col("target_weight").cast("double").alias("target_weight"))
    named = F.array(*(F.lit(k) for k in models))
    df = df.withColumn("cost", F.explode(named))
    df = df.withColumn("run_id", F.when(F.col("cost") == "", F.col("run_id")).otherwise(F.concat_ws("/", "run_id", "cost")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = simulate(pdf, models[pdf["cost"].iloc[0]], cash, every, missing_price)
        out.insert(0, "run_id", pdf["run_id"].iloc[0])
        return out

    return BacktestResult(df.groupBy("run_id").applyInPandas(fold, FOLD))


def scan_equity(prices: np.ndarray, weights: np.ndarray, cash: float = CASH) -> np.ndarray:
    """Equity without costs, dust or gaps, in closed form: a cross-check of the ledger. Rows are sessions."""
    equity = np.full(len(prices), cash)
    shares = np.zeros(prices.shape[1])
    for t in range(1, len(prices)):
        filled = weights[t - 1] * equity[t - 1] / prices[t - 1]
        equity[t] = equity[t - 1] + (shares * (prices[t] - prices[t - 1])).sum()
        shares = filled
    return equity
