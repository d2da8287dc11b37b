"""Information coefficients, HAC inference, quintile spreads and multiple testing.

Daily work is distributed; what is left, one number a date, is a series of a few thousand rows. Series operators take
keys (such as signal or run_id), so that many series are worked on in one plan.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import average_rank, correlation, ratio
from panelspark.functions.dist import normal_two_sided, t_two_sided

YEAR = 252


def daily_ic(df: DataFrame, signal: str, target: str, method: str = "spearman", least: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, ic, n): correlation of signal and target over each date's complete pairs; NULL for fewer than
    least, 0 if a side is constant. Ranks are taken within the complete pairs."""
    by = [*keys, "date"]
    pairs = df.where(F.col(signal).isNotNull() & F.col(target).isNotNull()).select(*by, F.col(signal).alias("x"), F.col(target).alias("y"))
    if method == "spearman":
        pairs = pairs.withColumns({"x": average_rank("x", *by), "y": average_rank("y", *by)})
    elif method != "pearson":
        raise ValueError(f"method is spearman or pearson, not {method!r}")
    n = F.count("*")
    return pairs.groupBy(*by).agg(F.when(n >= least, F.coalesce(correlation("x", "y"), F.lit(0.0))).alias("ic"), n.alias("n"))


def hac_lag(n: int) -> int:
    return max(1, math.floor(4.0 * (n / 100.0) ** (2.0 / 9.0)))


def hac_variance(series: DataFrame, value: str, lags: int, order: str = "date", keys: Sequence[str] = (), more: Sequence[Column] = (), carried: Sequence[str] = ()) -> DataFrame:
    """(keys, n, mean, std, hac_se, more) with Bartlett weights up to lags valid rows (at most n - 1). Autocovariances
    are over n; their weighted sum is held at 1e-14 or more. A series without valid rows has n 0 and NULLs. more: other
    aggregates, of the value v or of carried columns."""
    x = series.select(*keys, order, *carried, F.col(value).cast("double").alias("v"))
    own = Window.partitionBy(*keys, F.col("v").isNull())
    x = x.withColumn("e", F.col("v") - F.avg("v").over(own))
    w = own.orderBy(order)
    x = x.withColumns({f"l{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)})
    n = F.count("v")
    used = F.least(F.lit(lags), n - 1)
    omega = F.sum(F.col("e") * F.col("e")) / F.greatest(n, F.lit(1))
    for k in range(1, lags + 1):
        share = F.when(F.lit(k) <= used, 1.0 - F.lit(float(k)) / (used + 1.0)).otherwise(0.0)
        omega = omega + 2.0 * share * F.coalesce(F.sum(F.col("e") * F.col(f"l{k}")), F.lit(0.0)) / F.greatest(n, F.lit(1))
    se = F.when(n > 1, F.sqrt(F.greatest(omega, F.lit(1e-14)) / n))
    return x.groupBy(*keys).agg(n.alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), se.alias("hac_se"), *more)


def ic_statistics(ic: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, mean_ic, std_ic, ic_ir, naive_t, hac_se, hac_t, hit_rate) of daily ic rows; lag = horizon. In one
    aggregate; a series without ICs has n 0 and NULLs."""
    base = hac_variance(ic, "ic", max(1, horizon), keys=keys, more=[F.avg((F.col("v") > 0).cast("double")).alias("hit_rate")])
    root = F.sqrt(F.col("n").cast("double"))
    return base.select(*keys, "n", F.col("mean").alias("mean_ic"), F.col("std").alias("std_ic"), ratio("mean", "std").alias("ic_ir"), ratio(F.col("mean") * root, "std").alias("naive_t"), "hac_se", ratio("mean", "hac_se").alias("hac_t"), "hit_rate")


def ic_summary(ic: DataFrame, horizon: int) -> dict[str, float]:
    """One series' statistics with p-values: Student's t for the naive one, normal for HAC."""
    r = ic_statistics(ic, horizon).first()
    out = {k: math.nan if v is None else v for k, v in r.asDict().items()}
    out["naive_p"] = t_two_sided(r["naive_t"], r["n"] - 1) if r["naive_t"] is not None else math.nan
    out["hac_p"] = normal_two_sided(r["hac_t"]) if r["hac_t"] is not None else math.nan
    return out


def hac_t_test(series: DataFrame, value: str, lags: int | None = None, order: str = "date") -> tuple[float, float]:
    """(t, p) by Student's t with n - 1 degrees; (0, 1) without variation or rows."""
    n = series.where(F.col(value).isNotNull()).count()
    r = hac_variance(series, value, lags or hac_lag(n), order).first()
    if not r or r["n"] <= 1 or not r["hac_se"] or r["hac_se"] <= 1e-12:
        return 0.0, 1.0
    t = r["mean"] / r["hac_se"]
    return t, t_two_sided(t, r["n"] - 1)


def quantile_bins(df: DataFrame, signal: str, bins: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Adds bin 1..bins by the signal's place on the date; equal values in order of their tickers."""
    by = [*keys, "date"]
    w = Window.partitionBy(*by)
    r = F.row_number().over(w.orderBy(signal, "ticker"))
    n = F.count("*").over(w)
    return df.withColumn("bin", F.greatest(F.lit(1), F.ceil(F.try_divide((r - 1) * F.lit(bins), (n - 1)).cast("double"))).cast("int"))


def quantile_spread(df: DataFrame, signal: str, target: str, bins: int = 5, least: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, spread, q1..qn): mean target of each bin and the last one's less the first one's."""
    by = [*keys, "date"]
    pairs = df.where(F.col(signal).isNotNull() & F.col(target).isNotNull()).select(*by, "ticker", signal, F.col(target).alias("y"))
    pairs = pairs.withColumn("n", F.count("*").over(Window.partitionBy(*by))).where(F.col("n") >= max(least, bins))
    binned = quantile_bins(pairs, signal, bins, keys)
    means = {f"q{k}": F.avg(F.when(F.col("bin") == k, F.col("y"))) for k in range(1, bins + 1)}
    out = binned.groupBy(*by).agg(*(c.alias(k) for k, c in means.items()))
    return out.withColumn("spread", F.col(f"q{bins}") - F.col("q1"))


def spread_summary(spreads: DataFrame, lags: int = 5) -> dict[str, float]:
    n = spreads.where("spread is not null").count()
    r = spreads.agg(F.avg("spread").alias("spread_mean"), *(F.avg(c).alias(f"{c}_mean") for c in spreads.columns if c.startswith("q"))).first()
    t, p = hac_t_test(spreads, "spread", lags) if n > 5 else (0.0, 1.0)
    return {**(r.asDict() if r else {}), "n": n, "t": t, "p": p}


def bonferroni(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Adds p_bonferroni and reject_bonferroni. Families of tests are small: one window."""
    m = F.count(p).over(Window.partitionBy(F.lit(0)))
    adjusted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p) * m))
    return tests.withColumn("p_bonferroni", adjusted).withColumn("reject_bonferroni", F.col("p_bonferroni") < alpha)


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", alpha: float = 0.05, name: str = "hypothesis") -> DataFrame:
    """Adds q_bh and reject_bh."""
    one = Window.partitionBy(F.lit(0))
    ranked = tests.withColumn("__r", F.row_number().over(one.orderBy(p, name))).withColumn("__m", F.count(p).over(one))
    raw = F.col(p) * F.col("__m") / F.col("__r")
    after = one.orderBy("__r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = ranked.withColumn("q_bh", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min(raw).over(after))))
    return out.withColumn("reject_bh", F.col("q_bh") < alpha).drop("__r", "__m")


@dataclass(frozen=True)
class Hypothesis:
    """direction: the sign of the IC that is predicted; test: the one that counts."""

    id: str
    signal: str
    horizon: int
    direction: str = "positive"
    params: dict = field(default_factory=dict)
    test: str = "hac_ic_t_test"

    @property
    def target(self) -> str:
        return f"fwd_ret_{self.horizon}d"

    def as_predicted(self, mean_ic: float) -> bool:
        return mean_ic > 0 if self.direction == "positive" else mean_ic < 0


#: The confirmatory family.
CONFIRMATORY = (
    Hypothesis("H1_MOMENTUM", "momentum_12_1", 20, params={"lookback_days": 252, "skip_days": 21}),
    Hypothesis("H2_MEAN_REVERSION", "mean_reversion_zscore", 5, params={"lookback_days": 20, "threshold": None}),
    Hypothesis("H3_LOW_VOLATILITY", "low_vol", 20, params={"lookback_days": 60}),
    Hypothesis("H4_ABNORMAL_VOLUME", "abnormal_volume", 5, params={"volume_lookback": 20, "direction_horizon": 1}),
)


@dataclass(frozen=True)
class Registry:
    hypotheses: tuple[Hypothesis, ...] = CONFIRMATORY

    def get(self, name: str) -> Hypothesis:
        """By id, by the id up to its first underscore, or by the signal's name."""
        for h in self.hypotheses:
            if name in (h.id, h.id.partition("_")[0], h.signal):
                return h
        raise KeyError(f"no hypothesis {name!r}")

    @property
    def family_size(self) -> int:
        return len(self.hypotheses)

    def target_column(self, id: str, df: DataFrame) -> str:
        name = self.get(id).target
        if name not in df.columns:
            raise KeyError(f"{id} needs {name}")
        return name

    def evaluate(self, id: str, df: DataFrame, signal: str) -> tuple[DataFrame, dict[str, float]]:
        ic = daily_ic(df, signal, self.target_column(id, df))
        return ic, ic_summary(ic, self.get(id).horizon)

    def hash(self) -> str:
        return hashlib.sha256(json.dumps([asdict(h) for h in self.hypotheses], sort_keys=True).encode()).hexdigest()


def adjust_family(spark: SparkSession, p_values: dict[str, float], alpha: float = 0.05) -> DataFrame:
    """(hypothesis, p_value, adjusted ones and verdicts) of exactly the confirmatory family's size."""
    if len(p_values) != Registry().family_size:
        raise ValueError(f"the family has {Registry().family_size} tests, not {len(p_values)}")
    tests = spark.createDataFrame([(k, float(v)) for k, v in p_values.items()], "hypothesis string, p_value double")
    return benjamini_hochberg(bonferroni(tests, alpha=alpha), alpha=alpha)
