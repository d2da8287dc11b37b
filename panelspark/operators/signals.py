"""Per-date trading signals in [-1, 1]."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import cross_sectional_rank, cross_sectional_zscore, price_column, price_zscore, realized_volatility, relative_volume, simple_return, skip_return


def to_signal(c: Column | str, method: str = "rank") -> Column:
    """Ranks stretched to [-1, 1], or z-scores over three, cut there."""
    if method == "rank":
        return 2.0 * cross_sectional_rank(c) - 1.0
    if method == "zscore":
        z = cross_sectional_zscore(c) / 3.0
        return F.when(z.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))
    raise ValueError(f"method is rank or zscore, not {method!r}")


class BaseSignal(ABC):
    """compute(panel) adds one column, named by self.name."""

    name = "signal"

    @abstractmethod
    def compute(self, df: DataFrame) -> DataFrame: ...

    @staticmethod
    def source(df: DataFrame, column: str, make) -> tuple[DataFrame, str]:
        """column if df has it, else computed from prices or returns."""
        if column in df.columns:
            return df, column
        return df.withColumn("__source", make(df)), "__source"

    def finish(self, df: DataFrame, signal: Column) -> DataFrame:
        return df.withColumn(self.name, signal).drop("__source", "__raw")


def _daily(df: DataFrame) -> tuple[DataFrame, str]:
    return (df, "ret_1d") if "ret_1d" in df.columns else (df.withColumn("ret_1d", simple_return(price_column(df), 1)), "ret_1d")


class MomentumSignal(BaseSignal):
    name = "momentum_signal"

    def __init__(self, total: int = 252, skip: int = 21, method: str = "rank"):
        self.total, self.skip, self.method = total, skip, method

    def compute(self, df: DataFrame) -> DataFrame:
        df, c = self.source(df, f"ret_{self.total}d_skip{self.skip}d", lambda d: skip_return(price_column(d), self.total, self.skip))
        return self.finish(df, to_signal(c, self.method))


class MeanReversionSignal(BaseSignal):
    name = "mean_reversion_signal"

    def __init__(self, window: int = 20, threshold: float | None = None, method: str = "rank"):
        self.window, self.threshold, self.method = window, threshold, method

    def compute(self, df: DataFrame) -> DataFrame:
        df, c = self.source(df, f"zscore_price_{self.window}", lambda d: price_zscore(price_column(d), self.window))
        raw = -F.col(c)
        df = df.withColumn("__raw", F.when(F.abs(raw) >= self.threshold, raw) if self.threshold else raw)
        return self.finish(df, to_signal("__raw", self.method))


class VolatilitySignal(BaseSignal):
    name = "volatility_signal"

    def __init__(self, window: int = 60, method: str = "rank"):
        self.window, self.method = window, method

    def compute(self, df: DataFrame) -> DataFrame:
        name = f"realized_vol_{self.window}"
        if name not in df.columns:
            df, _ = _daily(df)
        df, c = self.source(df, name, lambda d: realized_volatility("ret_1d", self.window))
        return self.finish(df.withColumn("__raw", -F.col(c)), to_signal("__raw", self.method))


class AbnormalVolumeSignal(BaseSignal):
    name = "abnormal_volume_signal"

    def __init__(self, window: int = 20, threshold: float | None = None, method: str = "rank"):
        self.window, self.threshold, self.method = window, threshold, method

    def compute(self, df: DataFrame) -> DataFrame:
        df, _ = _daily(df)
        volume = next((v for v in ("volume_split_adjusted", "volume") if v in df.columns), None)
        if volume is None and "relative_volume" not in df.columns:
            raise KeyError("no volume column")
        df, c = self.source(df, "relative_volume", lambda d: relative_volume(volume, self.window))
        v = F.col(c)
        raw = F.when(v.isNotNull(), F.signum("ret_1d") * F.ln(F.greatest(v, F.lit(1e-4))))
        if self.threshold and self.threshold > 1:
            raw = F.when(v >= self.threshold, raw).otherwise(F.when(raw.isNotNull(), F.lit(0.0)))
        return self.finish(df.withColumn("__raw", raw), to_signal("__raw", self.method))


class CombinedSignal(BaseSignal):
    """Weighted sum of the four, NULL if any is, ranked again."""

    name = "combined_signal"

    def __init__(self, weights: dict[str, float] | None = None, parts: list[BaseSignal] | None = None):
        self.parts = parts or [MomentumSignal(), MeanReversionSignal(), VolatilitySignal(), AbnormalVolumeSignal()]
        self.weights = weights or {p.name: 1.0 / len(self.parts) for p in self.parts}

    def compute(self, df: DataFrame) -> DataFrame:
        own = df.columns
        for p in self.parts:
            if p.name not in df.columns:
                df = p.compute(df)
        total = sum((F.col(k) * F.lit(float(w)) for k, w in self.weights.items()), F.lit(0.0))
        # rounded, so that sums that differ in their last bits are ties on every engine
        df = df.withColumn("__raw", F.round(total, 12))
        return self.finish(df, to_signal("__raw")).select(*dict.fromkeys([*own, *(p.name for p in self.parts), self.name]))


SIGNALS = {
    "momentum": MomentumSignal, "momentum_12_1": MomentumSignal, "h1": MomentumSignal,
    "mean_reversion": MeanReversionSignal, "mean_reversion_zscore": MeanReversionSignal, "h2": MeanReversionSignal,
    "volatility": VolatilitySignal, "low_volatility": VolatilitySignal, "low_vol": VolatilitySignal, "h3": VolatilitySignal,
    "abnormal_volume": AbnormalVolumeSignal, "volume": AbnormalVolumeSignal, "volume_signal": AbnormalVolumeSignal, "h4": AbnormalVolumeSignal,
    "combined": CombinedSignal, "combined_signal": CombinedSignal,
}


def get_signal(name: str, **options) -> BaseSignal:
    if name.lower() not in SIGNALS:
        raise ValueError(f"unknown signal {name!r}; there are {sorted(SIGNALS)}")
    return SIGNALS[name.lower()](**options)
