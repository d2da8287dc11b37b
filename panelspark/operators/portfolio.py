"""Target weights from signals, and their projection on exposure limits."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import ratio

TOLERANCE = 1e-6


def project(weights: np.ndarray, max_position: float = 0.10, max_gross: float = 1.0, max_net: float = 0.20) -> np.ndarray:
    """The nearest weights (least squares) with |w| <= max_position, sum |w| <= max_gross and |sum w| <= max_net.

    The plain form of constrained(), for one cross-section. By the optimality conditions they have the form clip(soft(w - a, m), +-max_position): m shrinks to the gross limit,
    and a moves the sum to the net limit. Both are found by bisection, m within a.
    """
    w = np.asarray(weights, float)

    def shrunk(a: float) -> np.ndarray:
        x = w - a

        def at(m: float) -> np.ndarray:
            return np.clip(np.sign(x) * np.maximum(np.abs(x) - m, 0.0), -max_position, max_position)

        if np.abs(at(0.0)).sum() <= max_gross:
            return at(0.0)
        low, high = 0.0, float(np.abs(x).max())
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if np.abs(at(mid)).sum() > max_gross else (low, mid)
        return at(high)

    out = shrunk(0.0)
    if abs(out.sum()) <= max_net:
        return out
    side = np.sign(out.sum())
    low, high = 0.0, float(np.abs(w).max() + max_position)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if side * shrunk(side * mid).sum() > max_net else (low, mid)
    return shrunk(side * high)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def level(values: Column, cap: float, target: Column) -> Column:
    """The t with sum(min(max(y - t, 0), cap)) = target over values y, exactly: the sum is a broken line in t, which bends
    at each y and y - cap, and is followed from its right end, where it is 0, with its height and slope. Its right end for
    a target of 0 or less, its left one for more than it reaches."""
    bends = F.concat(F.transform(values, lambda y: F.struct(y.alias("at"), F.lit(1).alias("bend"))), F.transform(values, lambda y: F.struct((y - F.lit(cap)).alias("at"), F.lit(-1).alias("bend"))))
    begin = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0.0).alias("height"), F.lit(0).alias("slope"), F.lit(None).cast("double").alias("t"))

    def on(s: Column, x: Column) -> Column:
        height = s["height"] + s["slope"] * (F.coalesce(s["at"], x["at"]) - x["at"])
        hit = s["t"].isNull() & (height >= target)
        t = F.when(hit, F.when(s["slope"] > 0, s["at"] - F.try_divide(target - s["height"], s["slope"].cast("double"))).otherwise(x["at"])).otherwise(s["t"])
        return F.struct(x["at"].alias("at"), height.alias("height"), (s["slope"] + x["bend"]).alias("slope"), t.alias("t"))

    return F.aggregate(F.sort_array(bends, asc=False), begin, on, lambda s: F.coalesce(s["t"], s["at"]))


def with_projection(days: DataFrame, max_position: float, max_gross: float, max_net: float) -> DataFrame:
    """days (__x, an array of weights without nulls; __held, with nulls) with __new: __held moved to the nearest weights
    within the limits; null where __x is. The nearest have the form clip(soft(w - a, m), +-max_position), and there are four
    cases: no limit on sums binds; gross alone does (a = 0); net alone does (m = 0); or both, when the sums of long and of
    short weights are known, and so each side has a level of its own (a + m and m - a). Each is one level()."""
    c, gross, net = (F.lit(float(x)) for x in (max_position, max_gross, max_net))
    col = F.col
    clip = lambda x: F.greatest(F.least(x, c), -c)
    part = lambda x: F.least(F.greatest(x, F.lit(0.0)), c)
    soft = lambda x: F.signum(x) * part(F.abs(x) - col("__m"))
    both = col("__beyond") & ~col("__alone")
    steps = {
        "__clip": F.transform("__x", clip),
        "__m": F.when(_total(F.transform("__clip", F.abs)) > gross, F.greatest(level(F.transform("__x", F.abs), max_position, gross), F.lit(0.0))).otherwise(0.0),
        "__sum": _total(F.transform("__x", soft)),
        "__side": F.signum("__sum"),
        "__beyond": F.abs("__sum") > net + 1e-15,
        "__a": F.when(col("__beyond") & (col("__side") * _total(col("__clip")) > net), level(F.transform("__x", lambda x: x + c), 2.0 * max_position, col("__side") * net + F.size("__x") * c)),
        "__alone": F.coalesce(_total(F.transform("__x", lambda x: F.abs(clip(x - col("__a"))))) <= gross + 1e-12, F.lit(False)),
        "__up": F.when(both, level(col("__x"), max_position, (gross + col("__side") * net) / 2.0)),
        "__down": F.when(both, level(F.transform("__x", F.negative), max_position, (gross - col("__side") * net) / 2.0)),
    }
    for name, column in steps.items():
        days = days.withColumn(name, column)
    new = lambda x: F.when(~col("__beyond"), soft(x)).when(col("__alone"), clip(x - col("__a"))).otherwise(part(x - col("__up")) - part(-x - col("__down")))
    return days.withColumn("__new", F.when(col("__x").isNotNull(), F.transform("__held", lambda x: F.when(x.isNotNull(), new(x)))))


def constrained(df: DataFrame, max_position: float = 0.10, max_gross: float = 1.0, max_net: float = 0.20, weight: str = "target_weight", keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """df with weights within the limits, the nearest to those given. A date's rows are gathered (a cross-section of
    tickers); its weights are moved only if they break a limit. All of it stays in the JVM."""
    held = F.transform("__rows", lambda r: r[weight].cast("double"))
    size = F.transform("__has", F.abs)
    ok = (F.coalesce(F.array_max(size), F.lit(0.0)) <= max_position + TOLERANCE) & (_total(size) <= max_gross + TOLERANCE) & (F.abs(_total(F.col("__has"))) <= max_net + TOLERANCE)
    days = df.groupBy(*keys).agg(F.collect_list(F.struct(*df.columns)).alias("__rows"))
    days = days.select("__rows", held.alias("__held")).withColumn("__has", F.filter("__held", lambda w: w.isNotNull()))
    days = with_projection(days.withColumn("__x", F.when(~ok, F.col("__has"))), max_position, max_gross, max_net)
    rows = days.select(F.posexplode("__rows").alias("__k", "__r"), F.coalesce("__new", "__held").alias("__w")).select("__r", F.get("__w", F.col("__k")).alias("__to"))
    return rows.select(*(F.col("__to").cast(df.schema[c].dataType).alias(c) if c == weight else F.col("__r")[c].alias(c) for c in df.columns))


class BasePortfolioConstructor(ABC):
    """construct(df, signal) adds target_weight."""

    name = "portfolio"

    def __init__(self, max_position: float = 0.10, max_gross: float = 1.0, max_net: float = 0.20, least: int = 5):
        self.max_position, self.max_gross, self.max_net, self.least = max_position, max_gross, max_net, least

    @abstractmethod
    def raw(self, df: DataFrame, signal: str) -> DataFrame: ...

    def construct(self, df: DataFrame, signal: str, constrain: bool = True) -> DataFrame:
        out = self.raw(df, signal)
        return constrained(out, self.max_position, self.max_gross, self.max_net) if constrain else out


class EqualWeightLongShort(BasePortfolioConstructor):
    """Half long and half short in the top and bottom fifth; with ten or more names legs are as wide as the position
    limit needs. All zero with fewer than least names, or where all signals are equal."""

    name = "equal_weight"

    def __init__(self, quantile: float = 0.20, **limits):
        super().__init__(**limits)
        self.quantile = quantile

    def raw(self, df: DataFrame, signal: str) -> DataFrame:
        s = F.col(signal)
        w = Window.partitionBy("date", s.isNull())
        n = F.count("*").over(w)
        top, bottom = F.row_number().over(w.orderBy(s.desc(), "ticker")), F.row_number().over(w.orderBy(s.asc(), F.desc("ticker")))
        k = F.greatest(F.lit(1), F.floor(n * F.lit(self.quantile)))
        k = F.when(n >= 10, F.greatest(k, F.lit(int(np.ceil(0.5 / self.max_position))))).otherwise(k)
        k = F.least(k, F.floor(n / 2))
        df = df.withColumns({"__n": n, "__k": k.cast("int"), "__top": top, "__bottom": bottom, "__flat": F.min(s).over(w) == F.max(s).over(w)})
        leg = F.lit(0.5) / F.col("__k")
        weight = F.when((F.col("__n") < self.least) | F.col("__flat"), F.lit(0.0)).when(F.col("__top") <= F.col("__k"), leg).when(F.col("__bottom") <= F.col("__k"), -leg).otherwise(0.0)
        return df.withColumn("target_weight", F.when(s.isNotNull(), weight)).drop("__n", "__k", "__top", "__bottom", "__flat")


class SignalWeightedLongShort(BasePortfolioConstructor):
    """Demeaned signals over their absolute sum."""

    name = "signal_weighted"

    def raw(self, df: DataFrame, signal: str) -> DataFrame:
        w = Window.partitionBy("date")
        s = F.col(signal)
        df = df.withColumn("__d", s - F.avg(s).over(w)).withColumn("__g", F.sum(F.abs("__d")).over(w)).withColumn("__n", F.count(s).over(w))
        flat = (F.col("__n") < self.least) | (F.col("__g") < 1e-12)
        return df.withColumn("target_weight", F.when(s.isNotNull(), F.when(flat, F.lit(0.0)).otherwise(ratio("__d", "__g")))).drop("__d", "__g", "__n")


class InverseVolatilitySignalWeighted(BasePortfolioConstructor):
    """Demeaned signals over floored volatility, demeaned again and scaled to the gross limit. Volatility is that of
    the lookback, else of 20 sessions, else 1."""

    name = "inverse_volatility_signal_weighted"

    def __init__(self, lookback: int = 60, floor: float = 0.05, **limits):
        super().__init__(**limits)
        self.lookback, self.floor = lookback, floor

    def raw(self, df: DataFrame, signal: str) -> DataFrame:
        w = Window.partitionBy("date")
        own = df.columns
        vol = next((F.col(c) for c in (f"realized_vol_{self.lookback}", "realized_vol_20") if c in own), F.lit(1.0))
        df = df.withColumn("__s", F.when(vol.isNotNull() & (vol >= 0), F.col(signal)))
        df = df.withColumns({"__d": F.col("__s") - F.avg("__s").over(w), "__n": F.count("__s").over(w)})
        df = df.withColumn("__r", F.col("__d") / F.greatest(vol, F.lit(self.floor)))
        df = df.withColumns({"__l1": F.sum(F.abs("__r")).over(w), "__e": F.col("__r") - F.avg("__r").over(w)})
        df = df.withColumn("__g", F.sum(F.abs("__e")).over(w))
        flat = (F.col("__n") < self.least) | (F.col("__l1") < 1e-12) | (F.col("__g") < 1e-12)
        weight = F.when(flat, F.lit(0.0)).otherwise(ratio("__e", "__g") * self.max_gross)
        return df.withColumn("target_weight", F.when(F.col("__s").isNotNull(), weight)).select(*own, "target_weight")


CONSTRUCTORS = {
    "equal_weight": EqualWeightLongShort, "equal_weight_long_short": EqualWeightLongShort, "quantile": EqualWeightLongShort,
    "signal_weighted": SignalWeightedLongShort, "signal_weight": SignalWeightedLongShort,
    "volatility_scaled": InverseVolatilitySignalWeighted, "vol_scaled": InverseVolatilitySignalWeighted,
    "inverse_volatility": InverseVolatilitySignalWeighted, "inverse_volatility_signal_weighted": InverseVolatilitySignalWeighted,
}


def get_portfolio_constructor(name: str, **options) -> BasePortfolioConstructor:
    if name.lower() not in CONSTRUCTORS:
        raise ValueError(f"unknown constructor {name!r}; there are {sorted(CONSTRUCTORS)}")
    return CONSTRUCTORS[name.lower()](**options)
