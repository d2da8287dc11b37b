"""Performance metrics of daily runs: each an aggregate over (run_id, date) rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import ratio
from panelspark.functions.dist import normal_cdf, normal_ppf

YEAR = 252
EULER = 0.5772156649015329
METRICS = ("cagr", "annualized_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "max_drawdown_duration_days", "calmar_ratio", "daily_hit_rate", "profit_factor", "average_daily_turnover", "annualized_turnover", "total_cost_usd", "cost_drag_bps", "total_trading_days")


def drawdowns(df: DataFrame, equity: str = "equity", key: str = "run_id") -> DataFrame:
    """(run_id, date, drawdown, island): island numbers the stretches without a new high."""
    w = Window.partitionBy(key).orderBy("date")
    rows = df.where(F.col(equity).isNotNull()).select(key, "date", F.col(equity).alias("e"))
    rows = rows.withColumn("drawdown", F.coalesce(ratio("e", F.max("e").over(w)) - 1.0, F.lit(0.0)))
    return rows.withColumn("island", F.sum((F.col("drawdown") >= 0).cast("int")).over(w)).drop("e")


def performance(df: DataFrame, key: str = "run_id") -> DataFrame:
    """(run_id, the fifteen metrics) of rows with date, daily_return and, where there are any, equity, turnover,
    total_cost and gross_return. Without equity returns are compounded. All zero with fewer than two returns. The rows
    are read once: drawdowns are window columns, and all metrics one aggregate."""
    w = Window.partitionBy(key).orderBy("date")
    rows = df.where(F.col("daily_return").isNotNull())
    have = set(df.columns)
    if "equity" not in have:
        rows = rows.withColumn("equity", F.exp(F.sum(F.ln(F.greatest(1.0 + F.col("daily_return"), F.lit(1e-300)))).over(w)))
    extra = {c: F.lit(None).cast("double") for c in ("turnover", "total_cost", "gross_return") if c not in have}
    rows = rows.withColumns(extra) if extra else rows
    r = F.col("daily_return")
    seen = F.count("equity").over(w)
    rows = rows.withColumns({"__fall": F.when(F.col("equity").isNotNull(), F.coalesce(ratio("equity", F.max("equity").over(w)) - 1.0, F.lit(0.0))), "__seen": seen})
    # sessions since the last high
    rows = rows.withColumn("__below", F.col("__seen") - F.max(F.when(F.col("__fall") >= 0, F.col("__seen"))).over(w))
    x = rows.groupBy(key).agg(
        F.count("*").alias("t"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"),
        F.min_by("equity", "date").alias("first"), F.max_by("equity", "date").alias("last"),
        F.sqrt(F.avg(F.when(r < 0, r * r))).alias("down"), F.avg((r > 0).cast("double")).alias("hits"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gains"), F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("losses"),
        F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover"), F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("spent"),
        F.count("gross_return").alias("n_gross"), F.sum(F.ln(F.greatest(1.0 + F.col("gross_return"), F.lit(1e-300)))).alias("log_gross"),
        F.min_by("gross_return", F.when(F.col("gross_return").isNotNull(), F.col("date"))).alias("first_gross"),
        F.min("__fall").alias("max_drawdown"), F.max("__below").alias("max_drawdown_duration_days"),
    )
    year = F.lit(float(YEAR))
    grown = F.when(F.col("first") > 0, F.col("last") / F.col("first")).otherwise(1.0)
    cagr = F.when(grown > 0, F.pow(grown, year / F.col("t")) - 1.0).otherwise(-1.0)
    x = x.withColumn("cagr", cagr)
    down = F.coalesce(F.col("down") * F.sqrt(year), F.lit(1e-6))
    gross = F.pow(F.exp(F.col("log_gross") - F.ln(1.0 + F.col("first_gross"))), year / F.greatest(F.col("n_gross"), F.lit(1))) - 1.0
    out = {
        "annualized_return": F.col("mean") * year,
        "annualized_volatility": F.col("std") * F.sqrt(year),
        "sharpe_ratio": F.when(F.col("std") > 1e-12, F.col("mean") / F.col("std") * F.sqrt(year)).otherwise(0.0),
        "sortino_ratio": F.when(down > 1e-12, F.col("mean") * year / down).otherwise(0.0),
        "calmar_ratio": F.when(F.abs("max_drawdown") > 1e-6, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0),
        "daily_hit_rate": F.col("hits"),
        "profit_factor": F.when(F.col("losses") > 1e-12, F.col("gains") / F.col("losses")).when(F.col("gains") > 0, 100.0).otherwise(0.0),
        "average_daily_turnover": F.col("turnover"),
        "annualized_turnover": F.col("turnover") * year,
        "total_cost_usd": F.col("spent"),
        "cost_drag_bps": F.when(F.col("n_gross") > 0, (gross - F.col("cagr")) * 1e4).otherwise(0.0),
        "total_trading_days": F.col("t"),
    }
    x = x.withColumns(out)
    kept = ("total_cost_usd", "total_trading_days")
    return x.select(key, *(F.col(c) if c in kept else F.when(F.col("t") < 2, F.lit(0).cast("long") if c.endswith("days") else F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in METRICS))


def return_moments(df: DataFrame, key: str = "run_id") -> DataFrame:
    """(run_id, n, mean, std, skew, kurtosis): population skewness and raw kurtosis."""
    r = F.col("daily_return")
    return df.where(r.isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3.0).alias("kurtosis"))


def probabilistic_sharpe(n: int, mean: float, std: float, skew: float, kurtosis: float, benchmark: float = 0.0) -> float:
    """P(true Sharpe ratio > benchmark, a yearly one), after Bailey and Lopez de Prado (2012)."""
    if n < 5 or not std or std < 1e-12:
        return 0.5
    daily = mean / std
    spread = 1.0 - skew * daily + (kurtosis - 1.0) / 4.0 * daily**2
    if spread <= 0:
        return 0.5
    return normal_cdf((daily - benchmark / math.sqrt(YEAR)) * math.sqrt(n - 1.0) / math.sqrt(spread))


def expected_best_sharpe(trials: int, variance: float = 0.5) -> float:
    if trials <= 1:
        return 0.0
    return math.sqrt(variance) * ((1.0 - EULER) * normal_ppf(1.0 - 1.0 / trials) + EULER * normal_ppf(1.0 - 1.0 / (trials * math.e)))


def deflated_sharpe(n: int, mean: float, std: float, skew: float, kurtosis: float, trials: int = 10, variance: float = 0.5) -> float:
    if n < 5 or trials < 1:
        return 0.5
    return probabilistic_sharpe(n, mean, std, skew, kurtosis, expected_best_sharpe(trials, variance))


def sharpe_probabilities(df: DataFrame, trials: int | None = None, variance: float = 0.5, key: str = "run_id") -> DataFrame:
    """(run_id, psr, dsr): dsr is NULL without a number of trials. A row a run reaches the function."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = [(r.n, r.mean, r.std, r.skew, r.kurtosis) for r in f.rename(columns={"std": "std"}).itertuples(index=False)]
            yield pd.DataFrame({key: f[key], "psr": [probabilistic_sharpe(*x) for x in rows], "dsr": [deflated_sharpe(*x, trials, variance) if trials else None for x in rows]}).astype({"dsr": "float64"})

    m = return_moments(df, key)
    return m.select(key, "n", "mean", "std", F.coalesce("skew", F.lit(0.0)).alias("skew"), F.coalesce("kurtosis", F.lit(3.0)).alias("kurtosis")).mapInPandas(run, f"{key} string, psr double, dsr double")


def tearsheet(row: dict, title: str = "Performance") -> str:
    """A Markdown table of one run's metrics."""
    percent = {"cagr", "annualized_return", "annualized_volatility", "max_drawdown", "daily_hit_rate", "average_daily_turnover", "annualized_turnover"}
    show = lambda k, v: f"{v:.2%}" if k in percent else f"{v:,.0f}" if k.endswith("days") or k.endswith("usd") else f"{v:.3f}"
    return "\n".join([f"# {title}", "", "| metric | value |", "| --- | ---: |", *(f"| {k.replace('_', ' ')} | {show(k, row[k])} |" for k in METRICS)])
