"""Cleaning and quality checks of OHLCV panels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import nan_to_null, ratio
from panelspark.sources.tables import written

PRICES = ("open", "high", "low", "close")


def on_sessions(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Only rows whose date is a session."""
    return df.join(sessions.select("date"), "date", "left_semi")


def activity(df: DataFrame, price: str = "adj_close") -> DataFrame:
    """(ticker, first_active, last_active): dates with a price and volume."""
    active = F.when(F.col(price).isNotNull() & (F.col("volume") > 0), F.col("date"))
    return df.groupBy("ticker").agg(F.min(active).alias("first_active"), F.max(active).alias("last_active"))


def split_adjusted_volume(df: DataFrame) -> DataFrame:
    """volume_split_adjusted: kept where the column has values, else volume times the splits after the row."""
    has = "volume_split_adjusted" in df.columns
    if has and df.where(F.col("volume_split_adjusted").isNotNull()).limit(1).count():
        return df
    if "split_factor" in df.columns:
        s = F.col("split_factor")
        later = Window.partitionBy("ticker").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
        factor = F.coalesce(F.product(F.when(s > 0, s).otherwise(F.lit(1.0))).over(later), F.lit(1.0))
    else:
        factor = F.lit(1.0)
    return df.withColumn("volume_split_adjusted", F.col("volume").cast("double") * factor)


def densified(df: DataFrame, sessions: DataFrame, last_active: DataFrame) -> DataFrame:
    """A row for each session up to a ticker's last active one; values are NULL where there was none. The spine is made
    by exploding each ticker's own sessions, so that it needs no cross join; sessions are a row a day."""
    every = sessions.agg(F.array_sort(F.collect_list("date")).alias("days"))
    days = F.split(F.lit(",".join(map(str, every.first()["days"]))), ",").cast("array<date>")  # folded to one constant
    spine = last_active.select("ticker", F.explode(F.filter(days, lambda d: d <= F.col("last_active"))).alias("date"))
    return spine.join(df, ["date", "ticker"], "left")


CHECKS = ("non_positive_price", "low_above_high", "open_above_high", "close_above_high")
#: Rows that a report shows of each check.
SHOWN = 20
LARGE_MOVE = 0.5


def issues() -> Column:
    """The checks that a bar fails."""
    low, high = F.col("low"), F.col("high")
    bad = (F.least(*PRICES) <= 0, low > high, F.col("open") > high, F.col("close") > high)
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in zip(CHECKS, bad, strict=True))))


def structural_errors(df: DataFrame, most: int | None = SHOWN) -> DataFrame:
    """(date, ticker, issue) of bars that cannot be, at most so many a check (None: all)."""
    found = df.select("date", "ticker", F.explode(issues()).alias("issue"))
    if most is None:
        return found
    n = F.row_number().over(Window.partitionBy("issue").orderBy("date", "ticker"))
    return found.withColumn("n", n).where(F.col("n") <= most).drop("n")


def move(price: str = "adj_close") -> Column:
    """The change to the last row of the ticker."""
    before = F.lag(price).over(Window.partitionBy("ticker").orderBy("date"))
    return ratio(F.col(price) - before, before)


def large_moves(df: DataFrame, limit: float = LARGE_MOVE, price: str = "adj_close") -> DataFrame:
    """(date, ticker, move) where the change to the last row is larger; a report, not an error."""
    return df.select("date", "ticker", move(price).alias("move")).where(F.abs("move") > limit)


def missing_shares(df: DataFrame, price: str = "adj_close") -> DataFrame:
    """(ticker, missing): the share of all dates on which a ticker has no bar. The number of dates is one number."""
    n = df.agg(F.countDistinct("date")).first()[0]
    return df.groupBy("ticker").agg(F.when(F.lit(n) > 0, (F.lit(n) - F.count(price)) / F.lit(max(n, 1))).alias("missing"))


@dataclass(frozen=True)
class QualityReport:
    """is_clean: no structural errors. observed: metrics that were taken while the panel was written; without them, counts
    are taken when asked for."""

    structural: DataFrame
    moves: DataFrame
    missing: DataFrame
    terminated: dict[str, str]
    observed: dict[str, int] | None = None

    def counts(self) -> dict[str, int]:
        if self.observed is not None:
            shown = sum(min(self.observed[k], SHOWN) for k in CHECKS)
            return {"structural_errors": shown, "large_moves": self.observed["large_moves"], "terminated": len(self.terminated)}
        return {"structural_errors": self.structural.count(), "large_moves": self.moves.count(), "terminated": len(self.terminated)}

    @property
    def is_clean(self) -> bool:
        if self.observed is not None:
            return not any(self.observed[k] for k in CHECKS)
        return not self.structural.limit(1).count()


def write_observed(panel: DataFrame, write: Callable[[DataFrame], DataFrame], sessions: DataFrame, tickers: list[str], terminated: dict[str, str] | None = None, price: str = "adj_close") -> tuple[DataFrame, QualityReport]:
    """(what write(panel) returns, its report). The report's counts, and each ticker's bars (of a few hundred), are observed
    while the panel's rows pass on their way to the table, so that it costs no scan; errors and moves are listed from the table."""
    seen = Observation("quality")
    rows = panel.withColumns({"__issues": issues(), "__move": move(price)})
    metrics = [F.count_if(F.array_contains("__issues", k)).alias(k) for k in CHECKS]
    metrics += [F.count("*").alias("rows"), F.count_if(F.abs("__move") > LARGE_MOVE).alias("large_moves"), F.max("date").alias("last")]
    metrics += [F.count(F.when(F.col("ticker") == t, F.col(price))).alias(f"bars of {t}") for t in tickers]
    out = write(rows.observe(seen, *metrics).select(*panel.columns))
    found = dict(seen.get)
    days = sessions.where(F.col("date") <= F.lit(found["last"])).count() if found["last"] else 0
    shares = [(t, (days - found[f"bars of {t}"]) / days) for t in tickers] if days else []
    missing = panel.sparkSession.createDataFrame(shares, "ticker string, missing double")
    return out, QualityReport(structural_errors(out), large_moves(out, price=price), missing, terminated or {}, {k: v for k, v in found.items() if k != "last"})


def validate(df: DataFrame, terminated: dict[str, str] | None = None) -> QualityReport:
    return QualityReport(structural_errors(df), large_moves(df), missing_shares(df), terminated or {})


def _cleaned(raw: DataFrame, sessions: DataFrame, late_days: int) -> tuple[DataFrame, list[str], dict[str, str]]:
    df = on_sessions(nan_to_null(raw), sessions)
    bounds = sessions.agg(F.min("date"), F.max("date")).first()
    # a row a ticker (a universe is a few hundred names), written: the raw rows are read once for it
    kept = written(activity(df)).where(F.col("first_active") <= F.date_add(F.lit(bounds[0]), late_days))
    found = kept.orderBy("ticker").collect()
    if not found:
        raise ValueError("no valid data")
    ended = {r["ticker"]: str(r["last_active"]) for r in found if r["last_active"] < bounds[1]}
    return densified(split_adjusted_volume(df), sessions, kept), [r["ticker"] for r in found], ended


def clean(raw: DataFrame, sessions: DataFrame, late_days: int = 7) -> tuple[DataFrame, QualityReport]:
    """The clean panel and its report: session rows, dense up to each ticker's end, split-adjusted volume, nothing
    filled. Tickers that become active over late_days after the first session are left out."""
    dense, _, ended = _cleaned(raw, sessions, late_days)
    return dense, validate(dense, ended)


def clean_to(raw: DataFrame, sessions: DataFrame, write: Callable[[DataFrame], DataFrame], late_days: int = 7) -> tuple[DataFrame, QualityReport]:
    """clean(), written by write (which returns the table), with the report observed on the way."""
    dense, tickers, ended = _cleaned(raw, sessions, late_days)
    return write_observed(dense, write, sessions, tickers, ended)
