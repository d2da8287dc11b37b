"""Walk-forward evaluation and robustness checks: many runs of the ledger in one plan, told apart by run_id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .execution import CASH, COST_REGIMES, BacktestResult, CostModel, run_backtests
from .metrics import performance, sharpe_probabilities
from .resampling import bootstrap_intervals, bootstrap_replicates


@dataclass(frozen=True)
class WalkForwardWindow:
    id: int
    train_start: str
    train_end: str
    test_start: str
    test_end: str
    holdout: bool = False


#: Seven expanding windows from 2014; the last is the final holdout.
WINDOWS = tuple(WalkForwardWindow(k, "2014-01-01", f"{2016 + k}-12-31", f"{2017 + k}-01-01", f"{2017 + k}-12-31", k == 7) for k in range(1, 8))


def windowed(df: DataFrame, windows=WINDOWS) -> DataFrame:
    """df with run_id `w<id>/is` and `w<id>/oos`: a row for each window part that its date lies in. Windows are a
    handful: they are literals, exploded and filtered row by row."""
    parts = [(f"w{w.id}/is", w.train_start, w.train_end) for w in windows] + [(f"w{w.id}/oos", w.test_start, w.test_end) for w in windows]
    array = F.array(*(F.struct(F.lit(n).alias("run_id"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in parts))
    inside = F.filter(array, lambda p: (F.col("date") >= p["a"]) & (F.col("date") <= p["b"]))
    return df.withColumn("__p", F.explode(inside)).withColumn("run_id", F.col("__p.run_id")).drop("__p")


@dataclass(frozen=True)
class WalkForwardReport:
    """metrics: of each window part; development: of the out-of-sample parts but the holdout, strung together."""

    result: BacktestResult
    metrics: DataFrame
    development: DataFrame
    probabilities: DataFrame


def walk_forward(weights: DataFrame, windows=WINDOWS, price: str = "adj_close", costs: CostModel | None = None, cash: float = CASH, trials: int | None = None) -> WalkForwardReport:
    """weights: (date, ticker, price, target_weight). Each part starts with fresh capital."""
    result = run_backtests(windowed(weights, windows), price, costs, cash)
    snapshots = result.snapshots
    held = [f"w{w.id}/oos" for w in windows if w.holdout]
    oos = snapshots.where(F.col("run_id").endswith("/oos") & ~F.col("run_id").isin(*held)) if held else snapshots.where(F.col("run_id").endswith("/oos"))
    strung = oos.select(F.lit("development").alias("run_id"), "date", "daily_return", "turnover", "total_cost")
    return WalkForwardReport(result, performance(snapshots), performance(strung), sharpe_probabilities(snapshots, trials))


def cost_sensitivity(weights: DataFrame, price: str = "adj_close", regimes: dict[str, CostModel] | None = None, cash: float = CASH) -> DataFrame:
    """(cost, metrics) of one run under each cost regime, with the drag against the run without costs."""
    runs = run_backtests(weights, price, regimes or COST_REGIMES, cash).snapshots.withColumn("cost", F.substring_index("run_id", "/", -1))
    free = F.max(F.when(F.col("cost") == "zero", F.col("daily_return"))).over(Window.partitionBy("date"))  # a row a regime
    return performance(runs.drop("run_id").withColumn("gross_return", free), key="cost")


def subperiods(weights: DataFrame, split: str = "2020-01-01", price: str = "adj_close", costs: CostModel | None = None, cash: float = CASH, exclude_from: str | None = None) -> DataFrame:
    """(run_id pre or post, metrics), each with fresh capital. exclude_from: the first date of a holdout."""
    df = weights if exclude_from is None else weights.where(F.col("date") < F.lit(exclude_from).cast("date"))
    df = df.withColumn("run_id", F.when(F.col("date") < F.lit(split).cast("date"), "pre").otherwise("post"))
    return performance(run_backtests(df, price, costs, cash).snapshots)


def dropped_tickers(tickers: list[str], share: float = 0.10, repeats: int = 5, seed: int = 42) -> dict[str, list[str]]:
    """For each repeat the tickers left out, by one seeded stream."""
    rng = np.random.default_rng(seed)
    n = max(1, int(len(tickers) * share))
    return {f"jackknife_{k + 1}": sorted(rng.choice(tickers, size=n, replace=False).tolist()) for k in range(repeats)}


def asset_drop_stability(weights: DataFrame, price: str = "adj_close", costs: CostModel | None = None, cash: float = CASH, **options) -> DataFrame:
    """(run_id, metrics) with a tenth of the tickers left out, five times. Tickers are a few hundred names."""
    tickers = [r[0] for r in weights.select("ticker").distinct().orderBy("ticker").collect()]
    drops = dropped_tickers(tickers, **options)
    runs = F.array(*(F.when(~F.col("ticker").isin(*out), F.lit(k)) for k, out in drops.items()))
    return performance(run_backtests(weights.withColumn("run_id", F.explode(F.array_compact(runs))), price, costs, cash).snapshots)


def extreme_days_removed(returns: DataFrame, days: int = 5) -> DataFrame:
    """(metrics) without the best and worst days of a (date, daily_return) series; nothing is removed of two times days or fewer."""
    one = Window.partitionBy(F.lit(0))
    best = F.row_number().over(one.orderBy(F.desc("daily_return"), "date"))
    worst = F.row_number().over(one.orderBy("daily_return", "date"))
    rows = returns.where("daily_return is not null").select("date", "daily_return").withColumns({"__b": best, "__w": worst, "__n": F.count("*").over(one)})
    rows = rows.where((F.col("__n") <= 2 * days) | ((F.col("__b") > days) & (F.col("__w") > days))).drop("__b", "__w", "__n")
    return performance(rows.withColumn("run_id", F.lit("trimmed")))


def pnl_bootstrap(returns: np.ndarray, replicates: int = 1000, block: int = 10, confidence: float = 0.95, seed: int = 42) -> dict[str, tuple[float, float]]:
    """Confidence intervals of Sharpe ratio and CAGR by the stationary bootstrap of a daily series."""
    x = np.asarray(returns, float)
    x = x[~np.isnan(x)]
    n = len(x)
    if n < 10:
        return {"sharpe": (0.0, 0.0), "cagr": (0.0, 0.0)}
    rng, p = np.random.default_rng(seed), 1.0 / block
    sharpe, cagr = np.zeros(replicates), np.zeros(replicates)
    for k in range(replicates):
        fresh = np.concatenate([[True], rng.random(n - 1) < p])
        last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        r = x[(rng.integers(0, n, n)[last] + np.arange(n) - last) % n]
        sd = r.std(ddof=1)
        sharpe[k] = r.mean() / sd * np.sqrt(252.0) if sd > 1e-12 else 0.0
        grown = np.prod(1.0 + r)
        cagr[k] = grown ** (252.0 / n) - 1.0 if grown > 0 else -1.0
    tails = [(1 - confidence) / 2 * 100, (1 + confidence) / 2 * 100]
    return {"sharpe": tuple(np.percentile(sharpe, tails)), "cagr": tuple(np.percentile(cagr, tails))}


def pnl_intervals(snapshots: DataFrame, replicates: int = 1000, block: int = 10, confidence: float = 0.95, seed: int = 42, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(keys, metric, low, high): intervals of the Sharpe ratio and CAGR of each run's daily returns, all runs in one
    plan; 0 and 0 for runs of fewer than 10 returns."""
    drawn = bootstrap_replicates(snapshots, "daily_return", keys, replicates=replicates, block=block, seed=seed)
    found = bootstrap_intervals(drawn, ("sharpe", "cagr"), (*keys, "n"), confidence)
    bound = lambda c: F.when(F.col("n") >= 10, F.col(c)).otherwise(0.0)
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bound(f"{m}_low").alias("low"), bound(f"{m}_high").alias("high")) for m in ("sharpe", "cagr"))))
    return found.select(*keys, rows.alias("r")).select(*keys, "r.*")


def integrity_violations(result: BacktestResult, max_gross: float = 1.10, ended: dict[str, date] | None = None, blocked: Sequence[str] = (), max_net: float | None = None) -> DataFrame:
    """(run_id, date, problem): trades on a run's first session, after the day (of ended) after a ticker's last one, or
    in blocked tickers; gross or net exposure above the limit; equity that is not cash plus holdings."""
    s, fills = result.snapshots, result.fills
    problem = lambda rows, name: rows.select("run_id", "date", F.lit(name).alias("problem"))
    first = s.groupBy("run_id").agg(F.min("date").alias("first"))
    out = problem(fills.join(first, "run_id").where(F.col("date") <= F.col("first")), "trade_on_first_session")
    late = F.lit(False)
    for ticker, day in (ended or {}).items():
        late = late | ((F.col("ticker") == ticker) & (F.col("date") > F.date_add(F.lit(day), 1)))
    out = out.unionByName(problem(fills.where(late), "trade_after_termination"))
    out = out.unionByName(problem(fills.where(F.col("ticker").isin(*blocked)), "blocked_ticker"))
    out = out.unionByName(problem(s.where(F.col("gross_exposure") > max_gross), "gross_exposure"))
    if max_net is not None:
        out = out.unionByName(problem(s.where(F.abs("net_exposure") > max_net), "net_exposure"))
    return out.unionByName(problem(s.where(F.abs(F.col("equity") - F.col("cash") - F.col("holdings_value")) > 1e-4), "books"))


def robustness_suite(weights: DataFrame, price: str = "adj_close", cash: float = CASH, split: str = "2020-01-01") -> dict:
    """All checks of one set of weights."""
    base = run_backtests(weights, price, None, cash).snapshots.select("run_id", "date", "daily_return")
    return {
        "costs": cost_sensitivity(weights, price, None, cash),
        "subperiods": subperiods(weights, split, price, None, cash),
        "jackknife": asset_drop_stability(weights, price, None, cash),
        "trimmed": extreme_days_removed(base),
        "bootstrap": {r["metric"]: (r["low"], r["high"]) for r in pnl_intervals(base).collect()},
    }
