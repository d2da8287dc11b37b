"""Return models: linear ones from sums in one aggregate, boosted trees by Spark ML, and their comparison by IC."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import cross_sectional_rank
from .inference import daily_ic, hac_variance
from panelspark.functions.dist import t_two_sided

FEATURES = ("ret_252d_skip21d", "zscore_price_20", "realized_vol_60", "relative_volume")


def moments(df: DataFrame, features: list[str], target: str) -> tuple[float, np.ndarray, np.ndarray, float, float]:
    """n, means of (features, target), and their centred cross products over n: a d x d result, in two aggregates."""
    cols = [*features, target]
    head = df.agg(F.count("*"), *(F.avg(c) for c in cols)).first()
    n, means = head[0], np.array([m or 0.0 for m in head[1:]], float)
    e = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, means)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*(F.sum(e[i] * e[j]) for i, j in pairs)).first()
    cross = np.zeros((len(cols),) * 2)
    for (i, j), v in zip(pairs, row):
        cross[i, j] = cross[j, i] = v or 0.0
    return n, means, cross / max(n, 1)


class BaseModel(ABC):
    @abstractmethod
    def fit(self, df: DataFrame, features: list[str], target: str) -> BaseModel: ...

    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame: ...


class LinearModel(BaseModel):
    """Least squares on features scaled by their population deviation. penalty l2: |y - Xb|^2 + alpha |b|^2;
    l1: |y - Xb|^2 / (2 n) + alpha |b|_1, by coordinate descent on the cross products."""

    def __init__(self, penalty: str | None = None, alpha: float = 0.0):
        self.penalty, self.alpha = penalty, alpha

    def fit(self, df: DataFrame, features: list[str], target: str) -> LinearModel:
        n, means, cross = moments(df, features, target)
        if not n:  # nothing is known, and predictions are NULL
            self.features, self.coefficients, self.intercept = list(features), np.full(len(features), np.nan), math.nan
            return self
        sd = np.sqrt(np.diag(cross)[:-1])
        sd = np.where(sd > 0, sd, 1.0)
        a, b = cross[:-1, :-1] / np.outer(sd, sd), cross[:-1, -1] / sd
        if self.penalty == "l1":
            beta = np.zeros(len(b))
            for _ in range(1000):
                before = beta.copy()
                for k in range(len(b)):
                    if a[k, k] > 0:
                        r = b[k] - a[k] @ beta + a[k, k] * beta[k]
                        beta[k] = np.sign(r) * max(abs(r) - self.alpha, 0.0) / a[k, k]
                if np.abs(beta - before).max() < 1e-12:
                    break
        else:
            ridge = self.alpha / max(n, 1) if self.penalty == "l2" else 0.0
            beta = np.linalg.lstsq(a + ridge * np.eye(len(b)), b, rcond=None)[0]
        self.features, self.coefficients = list(features), beta / sd
        self.intercept = float(means[-1] - self.coefficients @ means[:-1])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if math.isnan(self.intercept):
            return df.withColumn("prediction", F.lit(None).cast("double"))
        out = F.lit(self.intercept)
        for c, w in zip(self.features, self.coefficients):
            out = out + F.col(c) * F.lit(float(w))
        return df.withColumn("prediction", out)


class BoostedTrees(BaseModel):
    """100 trees of depth 3, learning rate 0.05, 0.8 of rows and features each. Not numerically equal to other libraries'."""

    def __init__(self, seed: int = 42, trees: int = 100, depth: int = 3, rate: float = 0.05, share: float = 0.8):
        self.options = {"seed": seed, "maxIter": trees, "maxDepth": depth, "stepSize": rate, "subsamplingRate": share, "featureSubsetStrategy": str(share)}

    def fit(self, df: DataFrame, features: list[str], target: str) -> BoostedTrees:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        if df.isEmpty():  # as for linear models
            self.model = None
            return self
        trees = GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="prediction", **self.options)
        self.model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__x"), trees]).fit(df)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return df.withColumn("prediction", F.lit(None).cast("double"))
        return self.model.transform(df).drop("__x")


MODELS = {"ols": lambda: LinearModel(), "ridge": lambda: LinearModel("l2", 1.0), "lasso": lambda: LinearModel("l1", 0.001), "xgboost": BoostedTrees, "gbt": BoostedTrees}


def get_model(name: str) -> BaseModel:
    if name.lower() not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {sorted(MODELS)}")
    return MODELS[name.lower()]()


def train_and_predict(df: DataFrame, model: str, train_end: str, test_start: str, test_end: str, target: str = "fwd_ret_20d", features: tuple[str, ...] = FEATURES, strict: bool = True, embargo: int = 0) -> DataFrame:
    """The test rows with prediction and ml_signal (ranked to [-1, 1] on each date). strict: missing feature columns
    raise, and rows without a prediction are NULL; otherwise they are dropped, and 0. embargo: sessions before
    train_end that are kept out, so that targets do not reach into the test."""
    have = [c for c in features if c in df.columns]
    if strict and len(have) < len(features):
        raise KeyError(f"missing features: {sorted(set(features) - set(have))}")
    cut = F.lit(train_end).cast("date")
    train = df.where(F.col("date") <= cut).dropna(subset=[*have, target])
    if embargo:
        last = df.where(F.col("date") <= cut).agg(F.max("session_idx")).first()[0]
        train = train.where(F.col("session_idx") <= (last or 0) - embargo)
    fitted = get_model(model).fit(train, have, target)
    test = df.where(F.col("date").between(F.lit(test_start).cast("date"), F.lit(test_end).cast("date")))
    usable = test.dropna(subset=have if strict else [*have, target])
    scored = fitted.predict(usable).select("date", "ticker", "prediction")
    out = test.join(scored, ["date", "ticker"], "left")
    n = F.count("prediction").over(Window.partitionBy("date"))
    ranked = F.when(F.col("prediction").isNotNull(), F.when(n < 2, F.lit(0.0)).otherwise(2.0 * cross_sectional_rank("prediction") - 1.0))
    return out.withColumn("ml_signal", ranked if strict else F.coalesce(ranked, F.lit(0.0)))


def compare_with_baseline(df: DataFrame, signal: str, baseline: str, target: str, lags: int = 20) -> dict[str, float]:
    """Mean ICs, and the HAC t and p (Student) of their daily difference."""
    a = daily_ic(df, signal, target).select("date", F.col("ic").alias("a"))
    b = daily_ic(df, baseline, target).select("date", F.col("ic").alias("b"))
    both = a.join(b, "date").where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    # one pass: means ride along with the difference's variance
    r = hac_variance(both, "d", lags, carried=("a", "b"), more=[F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b")]).first()
    t = r["mean"] / r["hac_se"] if r["n"] > 1 and r["hac_se"] > 1e-12 else 0.0
    return {"mean_ic": r["mean_a"], "baseline_ic": r["mean_b"], "delta_ic": r["mean"], "t": t, "p": t_two_sided(t, r["n"] - 1) if t else 1.0, "n": r["n"]}
