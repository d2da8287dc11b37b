"""Column helpers: missing values, guarded arithmetic, session-grid windows, ranks and correlations from sums.

NULL is the only missing value. ANSI mode raises on division by zero, so ratios go through ratio().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Done once, where data come in: Spark's aggregates skip NULL, but not NaN."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as a double; NULL if b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def by_ticker(*keys: str) -> WindowSpec:
    """Sessions of each ticker in order. Frames count grid sessions, whether or not the ticker has a row there."""
    return Window.partitionBy(*keys, "ticker").orderBy("session_idx")


def at_offset(c: Column | str, offset: int, *keys: str) -> Column:
    """The value so many sessions later (earlier, if negative); NULL if there is no row."""
    return F.first(col(c)).over(by_ticker(*keys).rangeBetween(offset, offset))


def rolling(c: Column | str, first: int, last: int, how: str, least: int | None = None, *keys: str) -> Column:
    """Aggregate over sessions first..last from the current one; NULL with fewer than least values (all, by default)."""
    frame = by_ticker(*keys).rangeBetween(first, last)
    agg = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}[how](col(c)).over(frame)
    if how == "std":  # of equal values exactly 0
        agg = F.when(F.min(col(c)).over(frame) == F.max(col(c)).over(frame), F.when(F.count(col(c)).over(frame) > 1, F.lit(0.0))).otherwise(agg)
    return F.when(F.count(col(c)).over(frame) >= (last - first + 1 if least is None else least), agg)


def average_rank(c: Column | str, *keys: str) -> Column:
    """Rank from 1 among non-null values of a group, ties averaged; NULL for NULL."""
    c = col(c)
    ordered = Window.partitionBy(*keys, c.isNull()).orderBy(c)
    ties = F.count("*").over(Window.partitionBy(*keys, c))
    return F.when(c.isNotNull(), F.rank().over(ordered).cast("double") + (ties - 1).cast("double") / F.lit(2.0).cast("double"))


def n_valid(c: Column | str, *keys: str) -> Column:
    return F.count(col(c)).over(Window.partitionBy(*keys))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's, an aggregate over rows with both values, from centred sums; NULL if a side is constant."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def half_up(c: Column | str, digits: int = 6) -> Column:
    """Rounded by floor(x * 10^d + 1/2) / 10^d, which every engine computes alike; never -0.0."""
    return F.floor(col(c) * F.lit(10.0**digits) + F.lit(0.5)).cast("double") / F.lit(10.0**digits)


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles by half_up(), for comparing results over engines; other: digits of single columns."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: half_up(c, other.get(c, digits)) for c in doubles}) if doubles else df
