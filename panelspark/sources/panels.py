"""Sources and sinks of OHLCV panels, the universe, and the panel made of the driver's line items."""

from __future__ import annotations

import hashlib
import json
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import half_up, nan_to_null

from .tables import application_folder, cached, file_state

PANEL_KEYS = ("date", "ticker")
OHLCV = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume long, volume_split_adjusted double"
#: Canonical names of tickers that changed, and ids that no provider may deliver.
TICKER_ALIASES = {"BRK-B": "BRK.B", "META": "FB", "BNY": "BK", "RTX": "UTX"}
BLOCKED_TICKERS = ("APC", "DOW", "EMC", "FOXA", "MON", "RTN", "WAG")


def with_session_idx(df: DataFrame) -> DataFrame:
    """Adds session_idx, the place of the row's date among all dates. Dates are few: they are numbered by themselves."""
    dates = df.select("date").distinct()
    numbered = dates.withColumn("session_idx", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))
    return df.join(numbered, "date")


def load_ohlcv(spark: SparkSession, path: str) -> DataFrame:
    """A panel of a Parquet table; raises if a key column is missing."""
    df = spark.read.parquet(path)
    missing = [c for c in PANEL_KEYS if c not in df.columns]
    if missing:
        raise ValueError(f"missing key columns: {missing}")
    return nan_to_null(df.withColumn("date", F.col("date").cast("date")))


def load_universe(spark: SparkSession, path: str, ticker_col: str = "ticker") -> list[str]:
    """Sorted distinct upper-case tickers of a CSV file; raises if there is none. A universe is a few hundred names."""
    df = spark.read.csv(path, header=True)
    if ticker_col not in df.columns:
        raise KeyError(f"no column {ticker_col} in {path}")
    names = [r[0] for r in df.select(F.upper(F.trim(F.col(ticker_col)))).where(F.length(F.trim(F.col(ticker_col))) > 0).distinct().collect()]
    if not names:
        raise ValueError(f"no tickers in {path}")
    return sorted(names)


def load_metadata(spark: SparkSession, path: str) -> dict:
    row = spark.read.json(path, multiLine=True).first()
    return row.asDict(recursive=True) if row else {}


def canonical_ticker(c: Column) -> Column:
    out = F.upper(F.trim(c))
    for given, canonical in TICKER_ALIASES.items():
        out = F.when(F.upper(F.trim(c)) == given, F.lit(canonical)).otherwise(out)
    return out


def provider_ticker(c: Column) -> Column:
    """The name a provider knows a canonical ticker by."""
    out = F.replace(F.upper(F.trim(c)), F.lit("."), F.lit("-"))
    for given, canonical in TICKER_ALIASES.items():
        out = F.when(F.upper(F.trim(c)) == canonical, F.lit(given)).otherwise(out)
    return out


def ingest(raw: DataFrame, requested: list[str], start: str, late_days: int = 7, most_failures: float = 0.10) -> DataFrame:
    """A provider's rows made a panel: canonical and unblocked tickers, dates without time zone, split-adjusted volume;
    series that begin over late_days after start are left out; raises if too many of the requested ones are missing."""
    df = nan_to_null(raw.withColumn("ticker", canonical_ticker(F.col("ticker"))).withColumn("date", F.col("date").cast("date")))
    df = df.where(~F.col("ticker").isin(*BLOCKED_TICKERS))
    first = df.groupBy("ticker").agg(F.min("date").alias("first"))
    timely = first.where(F.col("first") <= F.date_add(F.lit(start).cast("date"), late_days)).select("ticker")
    wanted = sorted(set(requested) - set(BLOCKED_TICKERS))
    found = timely.where(F.col("ticker").isin(*wanted)).count() if wanted else 0
    if wanted and (len(wanted) - found) / len(wanted) > most_failures:
        raise RuntimeError(f"{len(wanted) - found} of {len(wanted)} series failed")
    return df.join(timely, "ticker", "left_semi")


def synthetic_ohlcv(spark: SparkSession, tickers: list[str], sessions: list[date], seed: int = 42, missing: float = 0.002, terminations: dict[str, date] | None = None) -> DataFrame:
    """A one-factor geometric random walk for each ticker, distributed: each ticker has its own random stream, made of
    the seed and its name, and the market's is the seed's. The first ticker splits two for one halfway."""
    ends = terminations or {}
    days = np.array(sessions, dtype="datetime64[D]")
    order = {t: k for k, t in enumerate(tickers)}

    def make(frames):
        import pandas as pd

        n = len(days)
        market = np.random.default_rng(seed).normal(0.0003, 0.01, n)
        for names in frames:
            for t in names["ticker"]:
                rng = np.random.default_rng([seed, int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")])
                sigma = rng.uniform(0.01, 0.02)
                steps = rng.uniform(0.7, 1.3) * market + rng.normal(0.0, sigma, n)
                steps[:1] = 0.0
                close = rng.uniform(30.0, 120.0) * np.exp(np.cumsum(steps))
                spread = np.abs(rng.normal(0.004, sigma / 2, (2, n)))
                opened = np.concatenate([close[:1], close[:-1]]) * (1 + rng.normal(0, sigma * 0.2, n))
                high = np.maximum(close * (1 + spread[0]), np.maximum(opened, close) * 1.001)
                low = np.minimum(close * (1 - spread[1]), np.minimum(opened, close) * 0.999)
                volume = rng.lognormal(np.log(rng.uniform(2e6, 1e7)), 0.4, n).astype("int64")
                factor = np.where((np.arange(n) < n // 2) & (order[t] == 0) & (n > 100), 2.0, 1.0)
                volume = (volume / factor).astype("int64")
                keep = rng.uniform(size=n) >= missing
                if t in ends:
                    keep &= days <= np.datetime64(ends[t])
                yield pd.DataFrame({"date": days.astype("datetime64[ns]"), "ticker": t, "open": opened * factor, "high": high * factor, "low": low * factor, "close": close * factor, "adj_close": close, "volume": volume, "volume_split_adjusted": volume * factor}).assign(date=lambda d: d["date"].dt.date)[keep]

    names = spark.createDataFrame([(t,) for t in tickers], "ticker string").repartition(max(1, min(len(tickers), 64)))
    return names.mapInPandas(make, OHLCV)


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of line items by brand: the price is the mean unit price, rounded; volume is the quantity. Bars are
    written once an application and state of the tables, whatever number of queries is built on them."""
    paths = f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet"

    def bars() -> DataFrame:
        items = spark.read.parquet(paths[0]).select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
        parts = spark.read.parquet(paths[1]).select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        week = F.date_trunc("week", "l_shipdate").cast("date").alias("date")
        return items.join(parts, "l_partkey").groupBy(week, "ticker").agg(
            half_up(F.avg(unit), 4).alias("adj_close"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").cast("double").alias("volume"),
        )

    return with_session_idx(cached(spark, f"{application_folder(spark)}/bars", file_state(spark, *paths), bars))


def file_key(path: str) -> str:
    """The first 16 hex digits of a file's SHA-256, as a cache key."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()[:16]


def write_panel(df: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Parquet, clustered by ticker, and metadata as JSON lines beside it."""
    df.repartition("ticker").sortWithinPartitions(*PANEL_KEYS).write.mode("overwrite").parquet(path)
    if metadata is not None:
        write_metadata(df.sparkSession, path, metadata)


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")
