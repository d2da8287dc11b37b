"""Session-grid features and cross-sectional transforms.

The panel has (date, session_idx, ticker) and price columns. Windows count grid sessions (see functions.columns); only
lag discipline counts a ticker's rows. All features of one window specification share its sort, and forward returns are
never lagged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import at_offset, average_rank, col, n_valid, ratio, rolling

YEAR = 252


def price_column(df: DataFrame, *names: str) -> str:
    """The first of names that df has; failing that, its only value column."""
    for n in names or ("adj_close", "close"):
        if n in df.columns:
            return n
    rest = [c for c in df.columns if c not in ("date", "ticker", "session_idx")]
    if len(rest) == 1:
        return rest[0]
    raise KeyError(f"none of {names or ('adj_close', 'close')} in {df.columns}")


def simple_return(price: Column | str, periods: int = 1) -> Column:
    before = at_offset(price, -periods)
    return ratio(col(price) - before, before)


def log_return(price: Column | str, periods: int = 1) -> Column:
    r = ratio(price, at_offset(price, -periods))
    return F.when(r > 0, F.ln(r))


def skip_return(price: Column | str, total: int = 252, skip: int = 21) -> Column:
    """From total to skip sessions ago; needs no value today."""
    if total <= skip:
        raise ValueError("total must exceed skip")
    old = at_offset(price, -total)
    return ratio(at_offset(price, -skip) - old, old)


def forward_return(price: Column | str, horizon: int = 1) -> Column:
    return ratio(at_offset(price, horizon) - col(price), price)


def rolling_mean(c: Column | str, window: int) -> Column:
    return rolling(c, -(window - 1), 0, "mean")


def rolling_std(c: Column | str, window: int) -> Column:
    return rolling(c, -(window - 1), 0, "std")


def price_zscore(price: Column | str, window: int = 20) -> Column:
    return ratio(col(price) - rolling_mean(price, window), rolling_std(price, window))


def realized_volatility(returns: Column | str, window: int = 20, annualize: bool = True) -> Column:
    out = rolling_std(returns, window)
    return out * F.lit(math.sqrt(YEAR)) if annualize else out


def relative_volume(volume: Column | str, window: int = 20) -> Column:
    """Volume over the mean of the sessions before."""
    return ratio(volume, rolling(volume, -window, -1, "mean"))


def volume_zscore(volume: Column | str, window: int = 20) -> Column:
    return ratio(col(volume) - rolling(volume, -window, -1, "mean"), rolling(volume, -window, -1, "std"))


def average_daily_volume(volume: Column | str, window: int = 20) -> Column:
    return rolling(volume, -(window - 1), 0, "mean", 1)


def cross_sectional_rank(c: Column | str, *keys: str) -> Column:
    """(average rank - 1) / (n - 1) among the date's values; NULL for fewer than two."""
    keys = keys or ("date",)
    n = n_valid(c, *keys)
    return F.when(n >= 2, ratio(average_rank(c, *keys) - 1, n - 1))


def cross_sectional_zscore(c: Column | str, *keys: str) -> Column:
    """NULL for fewer than two values; where all are equal, 0 for the whole date, missing ones included."""
    c, w = col(c), Window.partitionBy(*(keys or ("date",)))
    flat = F.min(c).over(w) == F.max(c).over(w)
    return F.when(F.count(c).over(w) < 2, F.lit(None).cast("double")).when(flat, F.lit(0.0)).otherwise(ratio(c - F.avg(c).over(w), F.stddev_samp(c).over(w)))


def lagged(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """columns as they were so many rows of the ticker before."""
    if not rows:
        return df
    w = Window.partitionBy("ticker").orderBy("date")
    return df.withColumns({c: F.lag(c, rows).over(w) for c in columns})


TARGETS = (1, 5, 20)


def compute_features(panel: DataFrame, lag: int = 0, returns=(1, 5, 20, 60, 252), windows=(20, 60), momentum=(252, 21), targets=TARGETS) -> DataFrame:
    """The panel with all features and forward returns: one shuffle by ticker and one by date."""
    price = price_column(panel)
    volume = next((v for v in ("volume_split_adjusted", "volume") if v in panel.columns), None)
    own = set(panel.columns)
    total, skip = momentum
    short, long = windows
    df = panel.withColumns({f"ret_{p}d": simple_return(price, p) for p in returns} | {f"log_ret_{p}d": log_return(price, p) for p in returns[:1]})
    more = {f"ret_{total}d_skip{skip}d": skip_return(price, total, skip)}
    for w in windows:
        more |= {f"sma_{w}": rolling_mean(price, w), f"rolling_std_ret_{w}": rolling_std("ret_1d", w), f"realized_vol_{w}": realized_volatility("ret_1d", w)}
    more |= {f"zscore_price_{short}": price_zscore(price, short), f"rolling_std_price_{short}": rolling_std(price, short)}
    if volume:
        more |= {f"volume_sma_{short}": rolling_mean(volume, short), "relative_volume": relative_volume(volume, short), f"volume_zscore_{short}": volume_zscore(volume, short)}
    more |= {f"fwd_ret_{h}d": forward_return(price, h) for h in targets}
    df = df.withColumns(more)
    df = df.withColumns({"vol_ratio": ratio(f"realized_vol_{short}", f"realized_vol_{long}")})
    ranked = {"rank_ret_20d": "ret_20d", f"rank_ret_{total}d_skip{skip}d": f"ret_{total}d_skip{skip}d", f"rank_vol_{short}": f"realized_vol_{short}"}
    df = df.withColumns({k: cross_sectional_rank(v) for k, v in ranked.items() if v in df.columns})
    features = [c for c in df.columns if c not in own and not c.startswith("fwd_ret_")]
    return lagged(df, features, lag)
