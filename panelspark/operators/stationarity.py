"""Unit-root and stationarity tests: of any number of series, a plan for all, and of one series, in numpy.

adf_tests() takes lagged cross-products of each series in one grouped aggregate; a matrix a series then goes to a sweep
operator, which gives the residual of each lag order on its way to the next, so that choosing lags by AIC refits nothing.
kpss_tests() is columns alone: the long-run variance with Bartlett weights over l lags is the mean square of sums over l + 1
neighbours, differences of running sums, so that one join looks up what no fixed number of lag columns could.
A series is a group (a value a session); what leaves it for Python is a matrix of (lags + 3) x (lags + 3) numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.dist import normal_cdf
from panelspark.sources.tables import written

#: MacKinnon (1994) response surface for the constant-only case: bounds, and polynomials below and above.
ADF_MAX, ADF_MIN, ADF_STAR = 2.74, -18.83, -1.61
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
#: Kwiatkowski et al. (1992), table 1: statistics at 10, 5, 2.5 and 1 percent.
KPSS_LEVELS = (0.10, 0.05, 0.025, 0.01)
KPSS_TABLE = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    return beta, rest, float(rest @ rest)


def adf_p_value(tau: float) -> float:
    if math.isnan(tau):
        return math.nan
    if tau > ADF_MAX:
        return 1.0
    if tau < ADF_MIN:
        return 0.0
    surface = ADF_SMALL if tau <= ADF_STAR else ADF_LARGE
    return normal_cdf(sum(c * tau**k for k, c in enumerate(surface)))


def sweep(m: np.ndarray, k: int) -> None:
    """Sweeps pivot k of a matrix of cross-products in place: rows swept hold the regression on them."""
    pivot = m[k, k]
    if abs(pivot) < 1e-300:
        return
    row, column = m[k, :].copy(), m[:, k].copy()
    m -= np.outer(column, row) / pivot
    m[k, :], m[:, k] = row / pivot, -column / pivot
    m[k, k] = 1.0 / pivot


def _ordered(series: DataFrame, value: str, keys: tuple[str, ...], order: str) -> tuple[DataFrame, Window]:
    """(keys, __x, __n, __mean, __t): a series' values but nulls, from place 0; and its window by place."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row a session
    rows = series.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("__order"), F.col(value).cast("double").alias("__x"))
    flat = F.min("__x").over(by) == F.max("__x").over(by)
    rows = rows.withColumns({"__n": F.count("*").over(by), "__mean": F.avg("__x").over(by), "__flat": flat, "__t": F.row_number().over(by.orderBy("__order")) - 1})
    return rows.drop("__order"), by.orderBy("__t")


def most_lags(n: int) -> int:
    return max(0, min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2))


def adf_from_products(first: np.ndarray, head: np.ndarray, n: int, most: int, fixed: bool) -> tuple[float, int, int]:
    """(statistic, lags, rows). first: products of (1, level, difference, lagged differences) over the rows from most on;
    head: those columns of the rows before."""
    place = [0, 1, *range(3, 3 + most), 2]  # constant, level, lags; the difference last
    lags = most
    if not fixed:
        m, size, best = first[np.ix_(place, place)].copy(), n - 1 - most, math.inf
        sweep(m, 0)
        sweep(m, 1)
        for k in range(most + 1):
            if k:
                sweep(m, 1 + k)
            aic = size * (math.log(2 * math.pi) + math.log(max(m[-1, -1], 1e-300) / size) + 1) + 2 * (k + 2)
            if aic < best:
                lags, best = k, aic
    place = [0, 1, *range(3, 3 + lags), 2]
    rows = head[lags:most][:, place]
    m = first[np.ix_(place, place)] + rows.T @ rows
    for k in range(lags + 2):
        sweep(m, k)
    size = n - 1 - lags
    variance = m[-1, -1] / (size - lags - 2) * m[1, 1] if size > lags + 2 else math.nan
    return (float(m[1, -1] / math.sqrt(variance)) if variance > 0 else math.nan), lags, size


def adf_tests(series: DataFrame, value: str, keys: tuple[str, ...] = (), order: str = "date", lags: int | None = None) -> DataFrame:
    """(keys, statistic, p_value, lags, n, stationary) of each key's series, nulls left out: augmented Dickey-Fuller with a
    constant. lags: fixed, or by AIC on a common sample, as in adf_test(). Short and constant series give NULL."""
    rows, one = _ordered(series, value, keys, order)
    rows = written(rows)
    longest = rows.agg(F.max("__n")).first()[0] or 0
    most = most_lags(longest) if lags is None else lags
    x = F.col("__x") - F.col("__mean")
    rows = rows.withColumns({"__level": x, "__d": F.lead("__x").over(one) - F.col("__x")})
    columns = [F.lit(1.0), F.col("__level"), F.col("__d"), *(F.coalesce(F.lag("__d", k).over(one), F.lit(0.0)) for k in range(1, most + 1))]
    rows = rows.withColumns({f"__c{k}": c for k, c in enumerate(columns)}).where("__t < __n - 1")
    own = F.least(F.greatest(F.least(F.ceil(12.0 * F.pow(F.col("__n") / 100.0, 0.25)), F.floor(F.col("__n") / 2) - 2), F.lit(0)), F.lit(most)) if lags is None else F.lit(lags)
    rows = rows.withColumn("__most", own.cast("int"))
    names = [f"__c{k}" for k in range(most + 3)]
    late = F.col("__t") >= F.col("__most")
    products = F.array(*(F.sum(F.when(late, F.col(a) * F.col(b))) for i, a in enumerate(names) for b in names[i:]))
    head = F.array_sort(F.collect_list(F.when(~late, F.struct("__t", F.array(*names)))))
    found = rows.groupBy(*keys).agg(F.max("__n").alias("__n"), F.max("__most").alias("__most"), F.max("__flat").alias("__flat"), products.alias("__products"), head.alias("__head")).where("__n is not null")
    upper = np.triu_indices(most + 3)
    kinds = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for n, own_most, flat, given, head in zip(f["__n"], f["__most"], f["__flat"], f["__products"], f["__head"]):
                if n < 10 or flat or n - 1 - own_most <= own_most + 2:
                    out.append((math.nan, math.nan, 0, int(n), False))
                    continue
                m = np.zeros((most + 3, most + 3))
                m[upper] = np.array(given, float)
                m = m + np.triu(m, 1).T
                early = np.array([list(h["col2"]) for h in head], float).reshape(-1, most + 3)
                tau, chosen, size = adf_from_products(m, early, int(n), int(own_most), lags is not None)
                p = adf_p_value(tau)
                out.append((tau, p, chosen, size, p < 0.05))
            yield pd.concat([f[list(keys)].reset_index(drop=True), pd.DataFrame(out, columns=["statistic", "p_value", "lags", "n", "stationary"])], axis=1)

    return found.mapInPandas(run, f"{kinds + ', ' if keys else ''}statistic double, p_value double, lags int, n int, stationary boolean")


def interpolated(c: Column, at: tuple[float, ...], values: tuple[float, ...]) -> Column:
    """The line through (at, values), flat beyond its ends."""
    out = F.lit(values[-1])
    for (a, b), (v, w) in reversed(list(zip(zip(at, at[1:]), zip(values, values[1:])))):
        out = F.when(c < b, F.lit(v) + (c - a) * ((w - v) / (b - a))).otherwise(out)
    return F.when(c <= at[0], F.lit(values[0])).otherwise(out)


def kpss_tests(series: DataFrame, value: str, keys: tuple[str, ...] = (), order: str = "date", regression: str = "c") -> DataFrame:
    """(keys, statistic, p_value, lags, n, stationary) of each key's series, nulls left out: KPSS around a level (c) or a
    trend (ct), lags as in kpss_test(). Short and constant series give NULL."""
    rows, one = _ordered(series, value, keys, order)
    every = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fitted = F.col("__mean")
    if regression == "ct":
        slope = F.coalesce(F.try_divide(F.covar_pop("__t", "__x").over(every), F.var_pop("__t").over(every)), F.lit(0.0))
        fitted = fitted + slope * (F.col("__t") - (F.col("__n") - 1) / 2.0)
    rows = rows.withColumn("__e", F.col("__x") - fitted)
    rows = written(rows.withColumn("__s", F.sum("__e").over(one.rowsBetween(Window.unboundedPreceding, 0))))
    longest = rows.agg(F.max("__n")).first()[0] or 0
    most = int(longest ** (2.0 / 9.0)) if longest else 0
    cover = F.floor(F.pow(F.col("__n").cast("double"), 2.0 / 9.0) + 1e-12)
    auto = rows.withColumns({f"__p{k}": F.when(cover >= k, F.col("__e") * F.lag("__e", k).over(one)) for k in range(1, most + 1)})
    gamma = [F.coalesce(F.sum(f"__p{k}"), F.lit(0.0)) * 2.0 / F.max("__n") for k in range(1, most + 1)]
    s0 = sum(gamma, F.sum(F.col("__e") * F.col("__e")) / F.max("__n"))
    s1 = sum((g * k for k, g in enumerate(gamma, 1)), F.lit(0.0))
    kpss = auto.groupBy(*keys).agg(F.max("__n").alias("__n"), F.max("__flat").alias("__flat"), s0.alias("__s0"), s1.alias("__s1"), F.sum(F.col("__s") * F.col("__s")).alias("__ss")).where("__n is not null")
    rate = 1.1447 * F.pow(F.pow(F.col("__s1") / F.col("__s0"), 2), 1.0 / 3.0) * F.pow(F.col("__n").cast("double"), 1.0 / 3.0)
    kpss = kpss.withColumn("__l", F.when((F.col("__s0") != 0) & ~F.col("__flat"), F.least(F.col("__n") - 1, F.floor(rate))).otherwise(0).cast("int"))
    kpss = written(kpss)
    # sums over l + 1 neighbours, those that reach over an end included: the running sum at t (the last one, beyond the end)
    # less that l + 1 places before (0 before the begin)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    ends = rows.alias("r").join(kpss.select(*keys, "__l").alias("k"), [*same("r", "k")] or F.lit(True)).select(*(F.col(f"r.{k}").alias(k) for k in keys), "__t", "__s", "__n", "__l")
    last = F.col("__t") == F.col("__n") - 1
    reach = F.when(last, F.sequence(F.lit(0), F.col("__l"))).otherwise(F.array(F.lit(0)))
    ends = ends.withColumn("__more", F.explode(reach)).withColumn("__before", F.col("__t") + F.col("__more") - F.col("__l") - 1)
    earlier = rows.select(*keys, F.col("__t").alias("__before"), F.col("__s").alias("__from"))
    sums = ends.alias("e").join(earlier.alias("f"), [*same("e", "f"), F.col("e.__before") == F.col("f.__before")], "left")
    sums = sums.select(*(F.col(f"e.{k}").alias(k) for k in keys), "__l", (F.col("__s") - F.coalesce("__from", F.lit(0.0))).alias("__w"))
    spread = sums.groupBy(*keys).agg((F.sum(F.col("__w") * F.col("__w")) / (F.max("__l") + 1)).alias("__v"))
    out = kpss.alias("k").join(spread.alias("v"), same("k", "v") or F.lit(True)).select(*(F.col(f"k.{k}").alias(k) for k in keys), "__n", "__flat", "__l", "__ss", "__v")
    ok = (F.col("__n") >= 10) & ~F.col("__flat")
    out = out.withColumn("statistic", F.when(ok, F.col("__ss") / F.col("__n") / F.col("__v")))
    out = out.withColumn("p_value", F.when(ok, interpolated(F.col("statistic"), KPSS_TABLE[regression], KPSS_LEVELS)))
    return out.select(*keys, "statistic", "p_value", F.when(ok, F.col("__l")).otherwise(0).alias("lags"), F.col("__n").cast("int").alias("n"), F.when(ok, F.col("p_value") >= 0.05).otherwise(F.col("__n") >= 10).alias("stationary"))


def adf_test(values, max_lag: int | None = None) -> dict:
    """Augmented Dickey-Fuller with a constant; lags by AIC on a common sample."""
    x = np.asarray(values, float)
    x = x[~np.isnan(x)]
    n = len(x)
    if n < 10 or np.ptp(x) == 0:
        return {"statistic": math.nan, "p_value": math.nan, "lags": 0, "n": n, "stationary": False}
    most = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2) if max_lag is None else max_lag
    d = np.diff(x)

    def design(lags: int, drop: int):
        rows = np.arange(drop, len(d))
        cols = [x[rows], *(d[rows - k] for k in range(1, lags + 1)), np.ones(len(rows))]
        return d[rows], np.column_stack(cols)

    def aic(lags: int) -> float:
        y, z = design(lags, most)
        m = len(y)
        return m * (math.log(2 * math.pi) + math.log(max(_ols(y, z)[2], 1e-300) / m) + 1) + 2 * z.shape[1]

    lags = min(range(most + 1), key=aic)
    y, z = design(lags, lags)
    beta, _, sse = _ols(y, z)
    cov = sse / (len(y) - z.shape[1]) * np.linalg.pinv(z.T @ z)
    tau = float(beta[0] / math.sqrt(cov[0, 0]))
    p = adf_p_value(tau)
    return {"statistic": tau, "p_value": p, "lags": lags, "n": len(y), "stationary": p < 0.05}


def kpss_test(values, regression: str = "c") -> dict:
    """KPSS around a level (c) or a trend (ct); lags chosen from the data (Hobijn et al., 1998)."""
    x = np.asarray(values, float)
    x = x[~np.isnan(x)]
    n = len(x)
    if n < 10 or np.ptp(x) == 0:
        return {"statistic": math.nan, "p_value": math.nan, "lags": 0, "n": n, "stationary": n >= 10}
    z = np.ones((n, 1)) if regression == "c" else np.column_stack([np.ones(n), np.arange(1.0, n + 1)])
    e = _ols(x, z)[1]
    cover = int(n ** (2.0 / 9.0))
    s0 = s1 = 0.0
    s0 = float(e @ e) / n
    for k in range(1, cover + 1):
        product = 2.0 * float(e[k:] @ e[:-k]) / n
        s0 += product
        s1 += k * product
    lags = min(n - 1, int(1.1447 * abs((s1 / s0) ** 2) ** (1.0 / 3.0) * n ** (1.0 / 3.0))) if s0 else 0
    var = float(e @ e) + 2.0 * sum(float(e[k:] @ e[:-k]) * (1.0 - k / (lags + 1.0)) for k in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / (var / n))
    p = float(np.interp(stat, KPSS_TABLE[regression], KPSS_LEVELS))
    return {"statistic": stat, "p_value": p, "lags": lags, "n": n, "stationary": p >= 0.05}
