"""Panels put side by side or on end: outer alignment by key, and tickers as columns and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("date", "ticker")


def aligned(left: DataFrame, right: DataFrame, how: str = "outer", keys: Sequence[str] = KEYS) -> DataFrame:
    """All columns of both by key; of columns that both have, right's get the suffix _right. how: outer keeps keys of
    either, inner those of both, left those of left."""
    twice = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.withColumnsRenamed({c: f"{c}_right" for c in twice}), list(keys), how)


def wide(df: DataFrame, value: str, tickers: Sequence[str] | None = None) -> DataFrame:
    """(date, a column a ticker): NULL where a ticker has no row. tickers: a universe, a few hundred names; without it
    they are listed first."""
    names = list(tickers) if tickers is not None else sorted(r[0] for r in df.select("ticker").distinct().collect())
    return df.groupBy("date").pivot("ticker", names).agg(F.first(value, ignorenulls=True))


def stacked(df: DataFrame, value: str) -> DataFrame:
    """(date, ticker, value) of wide(); cells that are NULL give no row."""
    names = [c for c in df.columns if c != "date"]
    return df.unpivot("date", names, "ticker", value).where(F.col(value).isNotNull())
