"""Market regimes of one return series by date, and performance within them. Series are a row a date."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import ratio

from .metrics import performance

YEAR = 252


def market_proxy(panel: DataFrame, price: str = "adj_close") -> DataFrame:
    """(date, market_return, market_price): mean of the tickers' changes since their last row, compounded from 100."""
    before = F.lag(price).over(Window.partitionBy("ticker").orderBy("date"))
    daily = panel.withColumn("r", ratio(F.col(price) - before, before)).groupBy("date").agg(F.avg("r").alias("market_return"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    grown = F.product(1.0 + F.coalesce("market_return", F.lit(0.0))).over(w)
    return daily.withColumn("market_price", F.lit(100.0) * grown)


def _gated(agg: Column, c: str, window: int, least: int) -> tuple[Column, Column]:
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-(window - 1), 0)
    return agg.over(w), F.count(c).over(w) >= least


def market_volatility(market: DataFrame, window: int = 20, least: int | None = None) -> DataFrame:
    v, ok = _gated(F.stddev_samp("market_return"), "market_return", window, window if least is None else least)
    return market.withColumn("volatility", F.when(ok, v * math.sqrt(YEAR)))


def volatility_regime(market: DataFrame, window: int = 20, low: float = 0.40, high: float = 0.60) -> DataFrame:
    """Adds volatility and regime LOW_VOL, NORMAL_VOL or HIGH_VOL by quantiles of the whole sample: it looks ahead, and
    so only describes."""
    df = market_volatility(market, window, window // 2)
    w = Window.partitionBy(F.lit(0))
    v = F.col("volatility")
    kind = F.when(v <= F.percentile("volatility", F.lit(low)).over(w), "LOW_VOL").when(v > F.percentile("volatility", F.lit(high)).over(w), "HIGH_VOL").otherwise("NORMAL_VOL")
    return df.withColumn("regime", F.when(v.isNotNull(), kind))


def trend_regime(market: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """Adds regime BULL_TREND or BEAR_TREND by two moving averages of market_price."""
    f, f_ok = _gated(F.avg("market_price"), "market_price", fast, fast // 2)
    s, s_ok = _gated(F.avg("market_price"), "market_price", slow, slow // 2)
    df = market.withColumns({"__f": F.when(f_ok, f), "__s": F.when(s_ok, s)})
    kind = F.when(F.col("__f") <= F.col("__s"), "BEAR_TREND").when(F.col("__s").isNotNull() & F.col("__f").isNotNull(), "BULL_TREND")
    return df.withColumn("regime", kind).drop("__f", "__s")


def composite_regime(market: DataFrame, volatility: int = 20, trend: int = 60, history: int = 252) -> DataFrame:
    """Adds vol_regime (low, medium, high by trailing quartiles), trend_regime and regime_composite: no look-ahead."""
    df = market_volatility(market, volatility)
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    past = w.rowsBetween(-(history - 1), 0)
    enough = F.count("volatility").over(past) >= min(60, history)
    quartile = lambda q: F.when(enough, F.percentile("volatility", F.lit(q)).over(past))
    recent = w.rowsBetween(-(trend - 1), 0)
    grown = F.when(F.count("market_return").over(recent) >= trend, F.product(1.0 + F.col("market_return")).over(recent) - 1.0)
    df = df.withColumns({"__q1": quartile(0.25), "__q3": quartile(0.75), "__g": grown})
    v = F.col("volatility")
    kind = F.when(v.isNotNull(), F.when(v < F.col("__q1"), "low").when(v > F.col("__q3"), "high").otherwise("medium"))
    df = df.withColumns({"vol_regime": kind, "trend_regime": F.when(F.col("__g") > 0, "trending").when(F.col("__g").isNotNull(), "non_trending")})
    return df.withColumn("regime_composite", F.concat(F.col("vol_regime"), F.lit("_"), F.col("trend_regime"))).drop("__q1", "__q3", "__g")


def performance_by_regime(returns: DataFrame, regimes: DataFrame, least: int = 5) -> DataFrame:
    """(regime, metrics) of regimes with least days; returns of a regime are compounded over its days in a row."""
    rows = returns.select("date", "daily_return").join(regimes.select("date", "regime"), "date").where("daily_return is not null and regime is not null")
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy("regime"))).where(F.col("__n") >= least).drop("__n")
    return performance(rows, key="regime")
