"""The queries of the panel operators over the driver's tables, and their SQL.

The panel is weekly bars of line items by brand. Doubles are rounded alike in both.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import half_up, rounded
from panelspark.operators import execution, features, inference, learning, metrics, portfolio, quality, regimes, resampling, reshape, signals, stationarity, validation
from panelspark.sources import calendar
from panelspark.sources.panels import BLOCKED_TICKERS, canonical_ticker, lineitem_panel, provider_ticker, synthetic_ohlcv
from panelspark.sources.provider import download, write_provider_files
from panelspark.sources.tables import shared_folder

from . import ledger_sql, projection_sql, resampling_sql
from .research import horizon_profile

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PANEL = """WITH bars AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS ticker, round(avg(l_extendedprice / l_quantity), 4) AS adj_close,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, CAST(sum(l_quantity) AS DOUBLE) AS volume
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
days AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS session_idx FROM (SELECT DISTINCT date FROM bars)),
panel AS (SELECT bars.*, session_idx FROM bars JOIN days USING (date))"""


def spelled(sql: str) -> str:
    """round(x, d) as floor(x * 10^d + 1/2) / 10^d, as functions.columns.half_up() has it."""
    while (m := re.search(r"\bround\(", sql)) is not None:
        depth, k = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner, _, digits = sql[m.end() : k - 1].rpartition(",")
        sql = f"{sql[: m.start()]}(floor(CAST({inner} AS DOUBLE) * 1e{digits.strip()} + 0.5) / 1e{digits.strip()}){sql[k:]}"
    return sql


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = spelled(sql)
        return f

    return register


def frame(a: int, b: int) -> str:
    side = lambda k: "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"
    return f"(PARTITION BY ticker ORDER BY session_idx RANGE BETWEEN {side(a)} AND {side(b)})"


def at(c: str, k: int) -> str:
    return f"first({c}) OVER {frame(k, k)}"


def roll(agg: str, c: str, a: int, b: int) -> str:
    of = f"{agg}({c}) OVER {frame(a, b)}"
    if agg == "stddev_samp":
        of = f"CASE WHEN max({c}) OVER {frame(a, b)} = min({c}) OVER {frame(a, b)} THEN 0.0 ELSE {of} END"
    return f"CASE WHEN count({c}) OVER {frame(a, b)} = {b - a + 1} THEN {of} END"


def change(c: str, old: str) -> str:
    return f"({c} - {old}) / nullif({old}, 0)"


def rank_of(c: str, by: str = "date") -> str:
    r = f"(rank() OVER (PARTITION BY {by}, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0)"
    return f"CASE WHEN {c} IS NOT NULL THEN CAST({r} AS DOUBLE) END"


def cs_rank(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY date) >= 2 THEN ({rank_of(c)} - 1) / (count({c}) OVER (PARTITION BY date) - 1) END"


def out(columns: str, *rounded_columns: str, digits: int = 6) -> str:
    return ", ".join([columns, *(f"round({c}, {digits}) + 0.0 AS {c}" for c in rounded_columns)])


# Sources and calendar


@query("panel_bars", PANEL + " SELECT date, ticker, session_idx, adj_close, high, low, volume FROM panel")
def panel_bars(spark, sf):
    return lineitem_panel(spark, sf).select("date", "ticker", "session_idx", "adj_close", "high", "low", "volume")


HOLIDAYS = """WITH y AS (SELECT CAST(range AS INTEGER) AS y FROM range(2014, 2025)),
nth AS (SELECT y, m, w, n, make_date(y, m, 1) AS d FROM y, (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (11, 4, 4)) v(m, w, n)),
moving AS (SELECT d + CAST((w - isodow(d) + 7) % 7 + 7 * (n - 1) AS INTEGER) AS date FROM nth),
memorial AS (SELECT last_day(make_date(y, 5, 1)) - CAST((isodow(last_day(make_date(y, 5, 1))) - 1) AS INTEGER) AS date FROM y),
fixed AS (SELECT make_date(y, m, d) AS date, m = 1 AS new_year FROM y, (VALUES (1, 1), (7, 4), (12, 25), (6, 19)) v(m, d) WHERE m <> 6 OR y >= 2022),
observed AS (SELECT CASE isodow(date) WHEN 6 THEN date - 1 WHEN 7 THEN date + 1 ELSE date END AS date FROM fixed WHERE NOT (new_year AND isodow(date) = 6)),
listed AS (SELECT CAST(unnest(['2014-04-18','2015-04-03','2016-03-25','2017-04-14','2018-03-30','2019-04-19','2020-04-10','2021-04-02','2022-04-15','2023-04-07','2024-03-29','2018-12-05']) AS DATE) AS date),
closed AS (SELECT date FROM moving UNION SELECT date FROM memorial UNION SELECT date FROM observed UNION SELECT date FROM listed),
sessions AS (SELECT CAST(d AS DATE) AS date FROM range(DATE '2014-01-01', DATE '2025-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT date FROM closed))"""


@query("calendar_sessions", HOLIDAYS + " SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS session_idx FROM sessions")
def calendar_sessions(spark, sf):
    return calendar.trading_sessions(spark, "2014-01-01", "2024-12-31")


@query("calendar_closed", HOLIDAYS + " SELECT CAST(d AS DATE) AS date FROM range(DATE '2014-01-01', DATE '2025-01-01', INTERVAL 1 DAY) t(d) WHERE CAST(d AS DATE) NOT IN (SELECT date FROM sessions)")
def calendar_closed(spark, sf):
    return calendar.closed_dates(spark, "2014-01-01", "2024-12-31")


@query("ticker_mapping", "SELECT DISTINCT upper(trim(p_brand)) AS ticker FROM part")
def ticker_mapping(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(canonical_ticker(F.col("p_brand")).alias("ticker")).distinct()


#: Brands stand for tickers that were renamed, one that a provider writes otherwise, and one that no provider may deliver.
GIVEN = {"Brand#1": " brk-b", "Brand#2": "META", "Brand#3": "bny ", "Brand#4": "RTX", "Brand#5": "EMC"}


@query("ticker_aliases", "WITH g AS (SELECT DISTINCT upper(trim(CASE p_brand " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GIVEN.items()) + " ELSE p_brand END)) AS t FROM part), c AS (SELECT CASE t WHEN 'BRK-B' THEN 'BRK.B' WHEN 'META' THEN 'FB' WHEN 'BNY' THEN 'BK' WHEN 'RTX' THEN 'UTX' ELSE t END AS ticker FROM g WHERE t <> 'EMC') SELECT ticker, CASE ticker WHEN 'BRK.B' THEN 'BRK-B' WHEN 'FB' THEN 'META' WHEN 'BK' THEN 'BNY' WHEN 'UTX' THEN 'RTX' ELSE replace(ticker, '.', '-') END AS provider FROM c")
def ticker_aliases(spark, sf):
    given = F.col("p_brand")
    for k, v in GIVEN.items():
        given = F.when(F.col("p_brand") == k, v).otherwise(given)
    names = spark.read.parquet(f"{sf}/part.parquet").select(canonical_ticker(given).alias("ticker")).distinct()
    return names.where(~F.col("ticker").isin(*BLOCKED_TICKERS)).select("ticker", provider_ticker(F.col("ticker")).alias("provider"))


#: The brands of the driver's tables.
BRANDS = sorted(f"Brand#{k}" for k in range(1, 26))


@query("panel_wide", PANEL + " SELECT date, " + ", ".join(f"max(adj_close) FILTER (ticker = '{b}') AS \"{b}\"" for b in BRANDS) + " FROM panel GROUP BY date")
def panel_wide(spark, sf):
    return reshape.wide(lineitem_panel(spark, sf), "adj_close", BRANDS)


@query("panel_stacked", PANEL + " SELECT date, ticker, adj_close FROM panel WHERE adj_close IS NOT NULL")
def panel_stacked(spark, sf):
    return reshape.stacked(reshape.wide(lineitem_panel(spark, sf), "adj_close", BRANDS), "adj_close")


@query("panel_aligned", PANEL + " SELECT coalesce(a.date, b.date) AS date, coalesce(a.ticker, b.ticker) AS ticker, a.volume, b.volume AS volume_right, b.adj_close FROM (SELECT * FROM panel WHERE session_idx % 3 <> 0) a FULL JOIN (SELECT * FROM panel WHERE session_idx % 2 = 0) b ON a.date = b.date AND a.ticker = b.ticker")
def panel_aligned(spark, sf):
    df = lineitem_panel(spark, sf)
    return reshape.aligned(df.where("session_idx % 3 <> 0").select("date", "ticker", "volume"), df.where("session_idx % 2 = 0").select("date", "ticker", "volume", "adj_close"))


#: The frozen universe (sp100_20140101), and its members that end early.
UNIVERSE = """AAPL ABBV ABT ACN AEP AIG ALL AMGN AMZN APA APC AXP BA BAC BAX BK BMY BRK.B C CAT CL CMCSA COF COP COST CSCO CVS CVX DD DIS DOW DVN EBAY EMC
EMR EXC F FB FCX FDX FOXA GD GE GILD GM GOOG GS HAL HD HON HPQ IBM INTC JNJ JPM KO LLY LMT LOW MA MCD MDLZ MDT MET MMM MO MON MRK MS MSFT NKE NOV NSC ORCL
OXY PEP PFE PG PM QCOM RTN SBUX SLB SO SPG T TGT TWX TXN UNH UNP UPS USB UTX V VZ WAG WFC WMT XOM""".split()
TERMINATIONS = {"EMC": date(2016, 9, 7), "MON": date(2018, 6, 7), "TWX": date(2018, 6, 14)}


@query("synthetic_panel")
def synthetic_panel(spark, sf):
    days = [r["date"] for r in calendar.trading_sessions(spark, "2014-01-01", "2024-12-31").orderBy("date").collect()]
    return synthetic_ohlcv(spark, UNIVERSE, days, terminations=TERMINATIONS)


PROVIDED = """, given AS (SELECT upper(ticker) AS ticker, date, adj_close, volume FROM bars WHERE NOT (ticker LIKE '%3' AND date < DATE '1998-01-01') AND date <= DATE '2001-06-30'),
first AS (SELECT ticker, min(date) AS first FROM given GROUP BY ticker),
failed AS (SELECT t AS ticker, CASE WHEN t = 'BRAND#7' THEN 'unreadable' WHEN first IS NULL THEN 'no file' ELSE 'begins on ' || first END AS failure FROM (SELECT 'BRAND#' || range AS t FROM range(1, 27)) LEFT JOIN first ON t = ticker WHERE t = 'BRAND#7' OR first IS NULL OR first > DATE '1995-03-03'),
good AS (SELECT *, CASE WHEN date < DATE '1998-06-01' AND count(*) FILTER (date = DATE '1998-06-01') OVER (PARTITION BY ticker) > 0 THEN 2.0 ELSE 1.0 END AS f FROM given ANTI JOIN failed USING (ticker))
SELECT ticker, count(*) AS n, min(date) AS first, max(date) AS last, round(avg(adj_close), 6) AS mean_price, sum(volume * f) AS shares, NULL AS failure FROM good GROUP BY ticker UNION ALL SELECT ticker, 0, NULL, NULL, NULL, NULL, failure FROM failed"""


@query("provider_ingest", PANEL + PROVIDED)
def provider_ingest(spark, sf):
    """Bars by brand as a provider delivers them: some brands late, one unreadable, one never. Split two for one in June 1998."""
    bars = lineitem_panel(spark, sf).where(~(F.col("ticker").endswith("3") & (F.col("date") < "1998-01-01")))
    price, volume = F.col("adj_close"), F.when(F.col("ticker") == "Brand#7", F.concat(F.lit("v"), "volume")).otherwise(F.col("volume").cast("string"))
    folder = shared_folder(spark)
    write_provider_files(bars.select("date", "ticker", price.alias("open"), "high", "low", price.alias("close"), "adj_close", volume.alias("volume"), F.when(F.col("date") == "1998-06-01", 2.0).otherwise(0.0).alias("split_factor")), folder)
    rows, failures = download(spark, folder, [f"Brand#{k}" for k in range(1, 27)], "1995-01-02", "2001-06-30", 60, most_failures=0.9)
    found = quality.split_adjusted_volume(rows).groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), half_up(F.avg("adj_close")).alias("mean_price"), F.sum("volume_split_adjusted").alias("shares"))
    why = F.when(F.col("failure").startswith("begins on ") | (F.col("failure") == "no file"), F.col("failure")).otherwise("unreadable")
    return found.unionByName(failures.select("ticker", F.lit(0).cast("long").alias("n"), why.alias("failure")), allowMissingColumns=True)


# Quality


@query("structural_errors", PANEL + """, x AS (SELECT date, ticker, 2 * low AS open, high, CASE WHEN volume < 40 THEN -low ELSE low END AS low, adj_close AS close FROM panel)
SELECT date, ticker, 'non_positive_price' AS issue FROM x WHERE least(open, high, low, close) <= 0 UNION ALL SELECT date, ticker, 'low_above_high' FROM x WHERE low > high
UNION ALL SELECT date, ticker, 'open_above_high' FROM x WHERE open > high UNION ALL SELECT date, ticker, 'close_above_high' FROM x WHERE close > high""")  # fmt: skip
def structural(spark, sf):
    df = lineitem_panel(spark, sf).select("date", "ticker", (2 * F.col("low")).alias("open"), "high", F.when(F.col("volume") < 40, -F.col("low")).otherwise(F.col("low")).alias("low"), F.col("adj_close").alias("close"))
    return quality.structural_errors(df, most=None)


@query("large_moves", PANEL + ", r AS (SELECT date, ticker, (adj_close - lag(adj_close) OVER w) / nullif(lag(adj_close) OVER w, 0) AS move FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT " + out("date, ticker", "move") + " FROM r WHERE abs(move) > 0.15")
def moves(spark, sf):
    return rounded(quality.large_moves(lineitem_panel(spark, sf), 0.15))


@query("missing_shares", PANEL + ", n AS (SELECT count(DISTINCT date) AS n FROM panel) SELECT ticker, round((max(n) - count(adj_close)) / CAST(max(n) AS DOUBLE), 6) + 0.0 AS missing FROM panel, n GROUP BY ticker")
def missing(spark, sf):
    return rounded(quality.missing_shares(lineitem_panel(spark, sf)))


@query("ticker_activity", PANEL + " SELECT ticker, min(date) FILTER (adj_close IS NOT NULL AND volume > 0) AS first_active, max(date) FILTER (adj_close IS NOT NULL AND volume > 0) AS last_active FROM panel GROUP BY ticker")
def ticker_activity(spark, sf):
    return quality.activity(lineitem_panel(spark, sf))


@query("densified_panel", PANEL + ", l AS (SELECT ticker, max(date) AS last FROM panel WHERE volume > 0 GROUP BY ticker) SELECT d.date, l.ticker, p.adj_close, p.volume FROM days d JOIN l ON d.date <= l.last LEFT JOIN panel p ON p.date = d.date AND p.ticker = l.ticker")
def densified_panel(spark, sf):
    df = lineitem_panel(spark, sf)
    return quality.densified(df, df.select("date").distinct(), quality.activity(df)).select("date", "ticker", "adj_close", "volume")


@query("split_volume", PANEL + ", s AS (SELECT *, CASE WHEN session_idx % 50 = 7 THEN 2.0 ELSE 1.0 END AS f FROM panel) SELECT date, ticker, volume * pow(2.0, coalesce(sum((f = 2.0)::INT) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS volume_split_adjusted FROM s")
def split_volume(spark, sf):
    df = lineitem_panel(spark, sf).withColumn("split_factor", F.when(F.col("session_idx") % 50 == 7, 2.0).otherwise(1.0))
    return quality.split_adjusted_volume(df).select("date", "ticker", "volume_split_adjusted")


# Features

RETURNS = {f"ret_{p}d": change("adj_close", at("adj_close", -p)) for p in (1, 5, 20, 60, 252)} | {"log_ret_1d": f"ln(adj_close / nullif({at('adj_close', -1)}, 0))", "ret_252d_skip21d": change(at("adj_close", -21), at("adj_close", -252))} | {f"fwd_ret_{h}d": change(at("adj_close", h), "adj_close") for h in (1, 5, 20)}


@query("returns", PANEL + ", r AS (SELECT date, ticker, " + ", ".join(f"{v} AS {k}" for k, v in RETURNS.items()) + " FROM panel) SELECT " + out("date, ticker", *RETURNS) + " FROM r")
def returns(spark, sf):
    return rounded(features.compute_features(lineitem_panel(spark, sf)).select("date", "ticker", *RETURNS))


ROLLING = {
    "sma_20": roll("avg", "adj_close", -19, 0), "sma_60": roll("avg", "adj_close", -59, 0), "rolling_std_price_20": roll("stddev_samp", "adj_close", -19, 0),
    "rolling_std_ret_20": roll("stddev_samp", "ret_1d", -19, 0), "rolling_std_ret_60": roll("stddev_samp", "ret_1d", -59, 0),
    "realized_vol_20": f"({roll('stddev_samp', 'ret_1d', -19, 0)}) * sqrt(252.0)", "realized_vol_60": f"({roll('stddev_samp', 'ret_1d', -59, 0)}) * sqrt(252.0)",
    "zscore_price_20": f"(adj_close - ({roll('avg', 'adj_close', -19, 0)})) / nullif(({roll('stddev_samp', 'adj_close', -19, 0)}), 0)",
    "volume_sma_20": roll("avg", "volume", -19, 0), "relative_volume": f"volume / nullif(({roll('avg', 'volume', -20, -1)}), 0)",
    "volume_zscore_20": f"(volume - ({roll('avg', 'volume', -20, -1)})) / nullif(({roll('stddev_samp', 'volume', -20, -1)}), 0)",
}
BASE = PANEL + f", b AS (SELECT *, {RETURNS['ret_1d']} AS ret_1d, {RETURNS['ret_20d']} AS ret_20d, {RETURNS['ret_252d_skip21d']} AS ret_252d_skip21d, {RETURNS['fwd_ret_1d']} AS fwd_ret_1d, {RETURNS['fwd_ret_5d']} AS fwd_ret_5d FROM panel), f0 AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in ROLLING.items()) + " FROM b), f AS (SELECT *, realized_vol_20 / nullif(realized_vol_60, 0) AS vol_ratio FROM f0)"


ROLLED = {"rolling_std_price_20": 4}


@query("rolling_features", BASE + " SELECT date, ticker, " + ", ".join(f"round({c}, {ROLLED.get(c, 6)}) AS {c}" for c in (*ROLLING, "vol_ratio")) + " FROM f")
def rolling_features(spark, sf):
    return rounded(features.compute_features(lineitem_panel(spark, sf)).select("date", "ticker", *ROLLING, "vol_ratio"), **ROLLED)


RANKED = {"rank_ret_20d": "ret_20d", "rank_ret_252d_skip21d": "ret_252d_skip21d", "rank_vol_20": "realized_vol_20"}


@query("cross_sectional_ranks", BASE + ", r AS (SELECT date, ticker, " + ", ".join(f"{cs_rank(v)} AS {k}" for k, v in RANKED.items()) + " FROM f) SELECT " + out("date, ticker", *RANKED) + " FROM r")
def cross_sectional_ranks(spark, sf):
    return rounded(features.compute_features(lineitem_panel(spark, sf)).select("date", "ticker", *RANKED))


@query("cross_sectional_zscores", BASE + ", r AS (SELECT date, ticker, CASE WHEN count(ret_20d) OVER d < 2 THEN NULL WHEN min(ret_20d) OVER d = max(ret_20d) OVER d THEN 0.0 ELSE (ret_20d - avg(ret_20d) OVER d) / stddev_samp(ret_20d) OVER d END AS z FROM f WINDOW d AS (PARTITION BY date)) SELECT " + out("date, ticker", "z") + " FROM r")
def cross_sectional_zscores(spark, sf):
    df = features.compute_features(lineitem_panel(spark, sf))
    return rounded(df.select("date", "ticker", features.cross_sectional_zscore("ret_20d").alias("z")))


@query("lagged_features", BASE + " SELECT date, ticker, round(lag(ret_1d, 1) OVER w, 6) + 0.0 AS ret_1d, round(lag(sma_20, 1) OVER w, 6) + 0.0 AS sma_20 FROM f WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def lagged_features(spark, sf):
    return rounded(features.compute_features(lineitem_panel(spark, sf), lag=1).select("date", "ticker", "ret_1d", "sma_20"))


@query("average_daily_volume", PANEL + f" SELECT date, ticker, round(avg(volume) OVER {frame(-19, 0)}, 6) + 0.0 AS adv FROM panel")
def adv(spark, sf):
    return rounded(lineitem_panel(spark, sf).select("date", "ticker", features.average_daily_volume("volume").alias("adv")))


# Signals

SIGNAL_SQL = BASE + f""", s0 AS (SELECT date, session_idx, ticker, adj_close, realized_vol_20, realized_vol_60, fwd_ret_1d, fwd_ret_5d, ret_1d, ret_252d_skip21d AS m, -zscore_price_20 AS r, -realized_vol_60 AS v,
 CASE WHEN relative_volume IS NOT NULL THEN sign(ret_1d) * ln(greatest(relative_volume, 1e-4)) END AS q FROM f),
s1 AS (SELECT *, 2 * ({cs_rank('m')}) - 1 AS momentum_signal, 2 * ({cs_rank('r')}) - 1 AS mean_reversion_signal, 2 * ({cs_rank('v')}) - 1 AS volatility_signal, 2 * ({cs_rank('q')}) - 1 AS abnormal_volume_signal FROM s0),
s2 AS (SELECT *, round(0.25 * momentum_signal + 0.25 * mean_reversion_signal + 0.25 * volatility_signal + 0.25 * abnormal_volume_signal, 12) AS c FROM s1),
s AS (SELECT *, 2 * ({cs_rank('c')}) - 1 AS combined_signal FROM s2)"""
SIGNALS = ("momentum_signal", "mean_reversion_signal", "volatility_signal", "abnormal_volume_signal", "combined_signal")


def _signals(spark, sf):
    return signals.CombinedSignal().compute(features.compute_features(lineitem_panel(spark, sf)))


@query("signals", SIGNAL_SQL + " SELECT " + out("date, ticker", *SIGNALS) + " FROM s")
def all_signals(spark, sf):
    return rounded(_signals(spark, sf).select("date", "ticker", *SIGNALS))


@query("signal_zscore_momentum", SIGNAL_SQL + " SELECT date, ticker, round(CASE WHEN count(m) OVER d < 2 THEN NULL WHEN min(m) OVER d = max(m) OVER d THEN 0.0 WHEN m IS NULL THEN NULL ELSE greatest(-1.0, least(1.0, (m - avg(m) OVER d) / stddev_samp(m) OVER d / 3.0)) END, 6) + 0.0 AS momentum_signal FROM s WINDOW d AS (PARTITION BY date)")
def zscore_momentum(spark, sf):
    return rounded(signals.MomentumSignal(method="zscore").compute(features.compute_features(lineitem_panel(spark, sf))).select("date", "ticker", "momentum_signal"))


@query("signal_thresholds", SIGNAL_SQL + f""", h0 AS (SELECT date, ticker, CASE WHEN abs(r) >= 1.0 THEN r END AS a, b.relative_volume, CASE WHEN q IS NULL THEN NULL WHEN b.relative_volume >= 1.2 THEN q ELSE 0.0 END AS b FROM s JOIN (SELECT date, ticker, relative_volume FROM f) b USING (date, ticker)), h1 AS (SELECT date, ticker, 2 * ({cs_rank('a')}) - 1 AS mean_reversion_signal, 2 * ({cs_rank('b')}) - 1 AS abnormal_volume_signal FROM h0) SELECT """ + out("date, ticker", "mean_reversion_signal", "abnormal_volume_signal") + " FROM h1")
def signal_thresholds(spark, sf):
    df = signals.MeanReversionSignal(threshold=1.0).compute(features.compute_features(lineitem_panel(spark, sf)))
    return rounded(signals.AbnormalVolumeSignal(threshold=1.2).compute(df).select("date", "ticker", "mean_reversion_signal", "abnormal_volume_signal"))


# Inference

IC_SQL = SIGNAL_SQL + f""", p AS (SELECT date, mean_reversion_signal AS x0, fwd_ret_1d AS y0 FROM s WHERE mean_reversion_signal IS NOT NULL AND fwd_ret_1d IS NOT NULL),
pr AS (SELECT date, {rank_of('x0')} AS x, {rank_of('y0')} AS y FROM p),
ic AS (SELECT date, CASE WHEN count(*) >= 5 THEN CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN 0.0 ELSE covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END END AS ic, count(*) AS n FROM pr GROUP BY date)"""


def _ic(spark, sf, method="spearman"):
    return inference.daily_ic(_signals(spark, sf), "mean_reversion_signal", "fwd_ret_1d", method)


@query("daily_ic", IC_SQL + " SELECT " + out("date, n", "ic") + " FROM ic")
def daily_ic(spark, sf):
    return rounded(_ic(spark, sf).select("date", "n", "ic"))


@query("daily_ic_pearson", IC_SQL.replace(f"{rank_of('x0')} AS x", "x0 AS x").replace(f"{rank_of('y0')} AS y", "y0 AS y") + " SELECT " + out("date, n", "ic") + " FROM ic")
def daily_ic_pearson(spark, sf):
    return rounded(_ic(spark, sf, "pearson").select("date", "n", "ic"))


def hac_sql(source: str, value: str, lags: int) -> str:
    ls = ", ".join(f"lag(e, {k}) OVER (ORDER BY date) AS l{k}" for k in range(1, lags + 1))
    omega = "sum(e * e) / count(*)" + "".join(f" + 2 * (CASE WHEN {k} <= least({lags}, count(*) - 1) THEN 1 - {k} / (least({lags}, count(*) - 1) + 1.0) ELSE 0 END) * coalesce(sum(e * l{k}), 0) / count(*)" for k in range(1, lags + 1))
    return f", h0 AS (SELECT date, CAST({value} AS DOUBLE) AS v, {value} - avg({value}) OVER () AS e FROM {source} WHERE {value} IS NOT NULL), h1 AS (SELECT *, {ls} FROM h0), h AS (SELECT count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, sqrt(greatest(CAST({omega} AS DOUBLE), 1e-14) / nullif(count(*), 0)) AS hac_se FROM h1)"


@query("ic_summary", IC_SQL + hac_sql("ic", "ic", 5) + ", g AS (SELECT avg((ic > 0)::INT) AS hit_rate FROM ic WHERE ic IS NOT NULL) SELECT n, round(mean, 6) AS mean_ic, round(std, 6) AS std_ic, round(mean / std, 6) AS ic_ir, round(mean * sqrt(n) / std, 5) AS naive_t, round(hac_se, 6) AS hac_se, round(mean / hac_se, 5) AS hac_t, round(hit_rate, 6) AS hit_rate FROM h, g")
def ic_summary(spark, sf):
    x = inference.ic_statistics(_ic(spark, sf), 5)
    return x.select("n", *(half_up(c, 5 if c.endswith("_t") else 6).alias(c) for c in x.columns if c != "n"))


@query("hac_standard_error", IC_SQL + hac_sql("ic", "ic", 8) + " SELECT n, round(mean, 6) AS mean, round(std, 6) AS std, round(hac_se, 6) AS hac_se FROM h")
def hac(spark, sf):
    return rounded(inference.hac_variance(_ic(spark, sf), "ic", 8))


QUINTILE = SIGNAL_SQL + """, q0 AS (SELECT date, ticker, mean_reversion_signal AS x, fwd_ret_1d AS y, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY mean_reversion_signal, ticker) AS r FROM s WHERE mean_reversion_signal IS NOT NULL AND fwd_ret_1d IS NOT NULL),
q1 AS (SELECT *, greatest(1, CAST(ceil((r - 1) * 5 / CAST(n - 1 AS DOUBLE)) AS INTEGER)) AS bin FROM q0 WHERE n >= 5),
q AS (SELECT date, """ + ", ".join(f"avg(y) FILTER (bin = {k}) AS q{k}" for k in range(1, 6)) + " FROM q1 GROUP BY date)"  # fmt: skip


@query("quintile_spread", QUINTILE + " SELECT date, " + ", ".join(f"round(q{k}, 6) + 0.0 AS q{k}" for k in range(1, 6)) + ", round(q5 - q1, 6) + 0.0 AS spread FROM q")
def quintile_spread(spark, sf):
    return rounded(inference.quantile_spread(_signals(spark, sf), "mean_reversion_signal", "fwd_ret_1d"))


TESTS = "WITH t AS (SELECT 'T' || c_mktsegment AS hypothesis, round(least(1.0, avg(abs(c_acctbal)) / 1e5), 6) AS p_value FROM customer GROUP BY 1), m AS (SELECT *, count(p_value) OVER () AS m, row_number() OVER (ORDER BY p_value, hypothesis) AS r FROM t)"


def _tests(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").groupBy(F.concat(F.lit("T"), "c_mktsegment").alias("hypothesis")).agg(F.round(F.least(F.lit(1.0), F.avg(F.abs("c_acctbal")) / 1e5), 6).alias("p_value"))


@query("bonferroni", TESTS + " SELECT hypothesis, p_value, round(least(1.0, p_value * m), 6) AS p_bonferroni, least(1.0, p_value * m) < 0.25 AS reject_bonferroni FROM m")
def bonferroni(spark, sf):
    return rounded(inference.bonferroni(_tests(spark, sf), alpha=0.25))


@query("benjamini_hochberg", TESTS + ", b AS (SELECT *, least(1.0, min(p_value * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM m) SELECT hypothesis, p_value, round(q, 6) AS q_bh, q < 0.05 AS reject_bh FROM b")
def benjamini_hochberg(spark, sf):
    return rounded(inference.benjamini_hochberg(_tests(spark, sf)))


def profile_sql(names, horizons) -> str:
    return SIGNAL_SQL + ", z AS (" + " UNION ALL ".join(f"SELECT '{sig}' AS signal, {h} AS horizon, date, {sig} AS x0, {change(at('adj_close', h), 'adj_close')} AS y0 FROM s" for sig in names for h in horizons) + f"), zp AS (SELECT * FROM z WHERE x0 IS NOT NULL AND y0 IS NOT NULL), zr AS (SELECT signal, horizon, date, {rank_of('x0', 'signal, horizon, date')} AS x, {rank_of('y0', 'signal, horizon, date')} AS y FROM zp), zi AS (SELECT signal, horizon, date, CASE WHEN count(*) >= 5 THEN CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN 0.0 ELSE covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END END AS ic FROM zr GROUP BY ALL) SELECT signal, horizon, count(ic) AS n, round(avg(ic), 6) + 0.0 AS mean_ic FROM zi GROUP BY ALL"


@query("horizon_profile", profile_sql(("mean_reversion_signal", "abnormal_volume_signal"), (1, 5, 20)))
def profile(spark, sf, names=("mean_reversion_signal", "abnormal_volume_signal"), horizons=(1, 5, 20)):
    ics = horizon_profile(_signals(spark, sf), list(names), horizons=horizons)
    return rounded(ics.groupBy("signal", "horizon").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic")))


@query("horizon_profile_all", profile_sql(SIGNALS[:4], (1, 5, 10, 20, 40, 60)))
def profile_all(spark, sf):
    """All four signals and six horizons; horizon_profile has those of its SQL."""
    return profile(spark, sf, SIGNALS[:4], (1, 5, 10, 20, 40, 60))


@query("permutation_test", IC_SQL + f", pt AS (SELECT date, ticker, mean_reversion_signal AS x0, fwd_ret_1d AS y0 FROM s WHERE mean_reversion_signal IS NOT NULL AND fwd_ret_1d IS NOT NULL), prt AS (SELECT date, ticker, {rank_of('x0')} AS x, {rank_of('y0')} AS y FROM pt)" + resampling_sql.permutations("prt", 1000) + " SELECT replicate, round(ic, 6) + 0.0 AS ic FROM pp")
def permutation(spark, sf):
    return rounded(resampling.permutation_ics(_signals(spark, sf), "mean_reversion_signal", "fwd_ret_1d", draws="hash"))


@query("bootstrap_mean", IC_SQL + resampling_sql.replicates("(SELECT 0 AS one, * FROM ic)", "ic", "one", 10_000, 0.2) + " SELECT replicate, round(mean, 6) + 0.0 AS mean FROM bb")
def bootstrap(spark, sf):
    return rounded(resampling.bootstrap_replicates(_ic(spark, sf), "ic", replicates=10_000, block=5).select("replicate", "mean"))


@query("bootstrap_interval", IC_SQL + resampling_sql.replicates("(SELECT 0 AS one, * FROM ic)", "ic", "one", 10_000, 0.2) + " SELECT round(quantile_cont(mean, 0.025), 6) + 0.0 AS mean_low, round(quantile_cont(mean, 0.975), 6) + 0.0 AS mean_high FROM bb")
def bootstrap_interval(spark, sf):
    return rounded(resampling.bootstrap_intervals(resampling.bootstrap_replicates(_ic(spark, sf), "ic", replicates=10_000, block=5)))


@query("null_simulation")
def null_simulation(spark, sf):
    return resampling.null_simulation(spark)


@query("stationarity_tests")
def stationarity_tests(spark, sf):
    ic = _ic(spark, sf)
    tests = {"adf": stationarity.adf_tests, "kpss": stationarity.kpss_tests}
    return functools.reduce(DataFrame.unionByName, (f(ic, "ic").select(F.lit(k).alias("test"), "statistic", "p_value", "stationary") for k, f in tests.items()))


#: Products of what is away from its mean: level x, lagged difference l, difference y.
ADF_SQL = ", v AS (SELECT ticker, date, ret AS x, lead(ret) OVER w - ret AS y, ret - lag(ret) OVER w AS l FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date)), c AS (SELECT ticker, x - avg(x) OVER t AS x, y - avg(y) OVER t AS y, l - avg(l) OVER t AS l FROM v WHERE y IS NOT NULL AND l IS NOT NULL WINDOW t AS (PARTITION BY ticker)), z AS (SELECT ticker, count(*) AS n, sum(x * x) AS xx, sum(x * l) AS xl, sum(l * l) AS ll, sum(x * y) AS xy, sum(l * y) AS ly, sum(y * y) AS yy FROM c GROUP BY ticker), b AS (SELECT *, (xy * ll - ly * xl) / (xx * ll - xl * xl) AS b, (ly * xx - xy * xl) / (xx * ll - xl * xl) AS g FROM z) SELECT ticker, CAST(n AS INTEGER) AS n, round(b / sqrt((yy - b * xy - g * ly) / (n - 3) * ll / (xx * ll - xl * xl)), 5) + 0.0 AS statistic FROM b"
RETS_SQL = PANEL + f", rets AS (SELECT ticker, date, ret FROM (SELECT ticker, date, {change('adj_close', at('adj_close', -1))} AS ret FROM panel) WHERE ret IS NOT NULL), enough AS (SELECT ticker FROM rets GROUP BY ticker HAVING count(*) >= 30)"


def _returns(spark, sf):
    df = lineitem_panel(spark, sf).select("ticker", "date", "session_idx", features.simple_return("adj_close", 1).alias("ret"))
    return df.withColumn("n", F.count("ret").over(Window.partitionBy("ticker"))).where("n >= 30").drop("n")


@query("adf_by_ticker", RETS_SQL.replace("WHERE ret IS NOT NULL)", "WHERE ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY ticker) >= 30)") + ADF_SQL)
def adf_by_ticker(spark, sf):
    """Augmented Dickey-Fuller with one lagged difference, of each brand's returns."""
    return rounded(stationarity.adf_tests(_returns(spark, sf), "ret", ("ticker",), lags=1).select("ticker", "n", "statistic"), 5)


KPSS_SQL = """, e AS (SELECT ticker, row_number() OVER o AS t, ret - avg(ret) OVER k AS e, count(*) OVER k AS n FROM rets JOIN enough USING (ticker) WINDOW k AS (PARTITION BY ticker), o AS (PARTITION BY ticker ORDER BY date)),
g AS (SELECT a.ticker, b.t - a.t AS k, sum(a.e * b.e) AS g, max(a.n) AS n FROM e a JOIN e b ON a.ticker = b.ticker AND a.t <= b.t GROUP BY ALL),
s AS (SELECT ticker, n, sum(CASE WHEN k = 0 THEN g ELSE 2 * g END) FILTER (k <= floor(pow(n, 2.0 / 9.0) + 1e-12)) / n AS s0, sum(2 * k * g) FILTER (k <= floor(pow(n, 2.0 / 9.0) + 1e-12)) / n AS s1 FROM g GROUP BY ticker, n),
l AS (SELECT *, least(n - 1, floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3.0) * pow(n, 1.0 / 3.0))) AS l FROM s),
v AS (SELECT l.ticker, l.n, l.l, sum(CASE WHEN k = 0 THEN g ELSE 2 * g * (1 - k / (l.l + 1)) END) FILTER (k <= l.l) AS v FROM l JOIN g USING (ticker) GROUP BY l.ticker, l.n, l.l),
p AS (SELECT ticker, sum(s * s) AS ss FROM (SELECT ticker, sum(e) OVER (PARTITION BY ticker ORDER BY t) AS s FROM e) GROUP BY ticker),
k AS (SELECT ticker, CAST(l AS INTEGER) AS lags, CAST(n AS INTEGER) AS n, ss / n / v AS stat FROM v JOIN p USING (ticker)),
q AS (SELECT *, CASE WHEN stat <= 0.347 THEN 0.10 WHEN stat < 0.463 THEN 0.10 + (stat - 0.347) * (0.05 - 0.10) / (0.463 - 0.347) WHEN stat < 0.574 THEN 0.05 + (stat - 0.463) * (0.025 - 0.05) / (0.574 - 0.463) WHEN stat < 0.739 THEN 0.025 + (stat - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END AS p FROM k)
SELECT ticker, lags, n, round(stat, 6) + 0.0 AS statistic, round(p, 6) + 0.0 AS p_value, p >= 0.05 AS stationary FROM q"""


@query("kpss_by_ticker", RETS_SQL + KPSS_SQL)
def kpss_by_ticker(spark, sf):
    """KPSS around a level, of each brand's returns."""
    return rounded(stationarity.kpss_tests(_returns(spark, sf), "ret", ("ticker",)))


# Portfolios and execution

EQUAL = SIGNAL_SQL + """, e AS (SELECT date, ticker, adj_close, mean_reversion_signal AS x, count(*) OVER d AS n, row_number() OVER (d ORDER BY mean_reversion_signal DESC, ticker) AS top, row_number() OVER (d ORDER BY mean_reversion_signal, ticker DESC) AS bottom, min(mean_reversion_signal) OVER d = max(mean_reversion_signal) OVER d AS flat
 FROM s WINDOW d AS (PARTITION BY date, mean_reversion_signal IS NULL)), ek AS (SELECT *, least(CASE WHEN n >= 10 THEN greatest(greatest(1, CAST(floor(n * 0.2) AS INTEGER)), 5) ELSE greatest(1, CAST(floor(n * 0.2) AS INTEGER)) END, n // 2) AS k FROM e),
ew AS (SELECT date, ticker, CASE WHEN x IS NULL THEN NULL WHEN n < 5 OR flat THEN 0.0 WHEN top <= k THEN 0.5 / k WHEN bottom <= k THEN -0.5 / k ELSE 0.0 END AS target_weight FROM ek)"""  # fmt: skip


@query("weights_equal", EQUAL + " SELECT date, ticker, round(CAST(target_weight AS DOUBLE), 6) + 0.0 AS target_weight FROM ew")
def weights_equal(spark, sf):
    return rounded(portfolio.EqualWeightLongShort().construct(_signals(spark, sf), "mean_reversion_signal", constrain=False).select("date", "ticker", "target_weight"))


@query("weights_signal", SIGNAL_SQL + ", w0 AS (SELECT date, ticker, combined_signal AS x, combined_signal - avg(combined_signal) OVER d AS e, count(combined_signal) OVER d AS n FROM s WINDOW d AS (PARTITION BY date)), w1 AS (SELECT *, sum(abs(e)) OVER (PARTITION BY date) AS g FROM w0) SELECT date, ticker, round(CASE WHEN x IS NOT NULL THEN CASE WHEN n < 5 OR g < 1e-12 THEN 0.0 ELSE e / g END END, 6) + 0.0 AS target_weight FROM w1")
def weights_signal(spark, sf):
    return rounded(portfolio.SignalWeightedLongShort().construct(_signals(spark, sf), "combined_signal", constrain=False).select("date", "ticker", "target_weight"))


@query("weights_inverse_volatility", SIGNAL_SQL + ", w0 AS (SELECT date, ticker, realized_vol_60 AS vol, CASE WHEN realized_vol_60 >= 0 THEN mean_reversion_signal END AS x FROM s), w1 AS (SELECT *, (x - avg(x) OVER d) / greatest(vol, 0.05) AS r, count(x) OVER d AS n FROM w0 WINDOW d AS (PARTITION BY date)), w2 AS (SELECT *, CASE WHEN x IS NOT NULL THEN r - avg(r) OVER d END AS e, sum(abs(r)) OVER d AS l FROM w1 WINDOW d AS (PARTITION BY date)), w3 AS (SELECT *, sum(abs(e)) OVER (PARTITION BY date) AS g FROM w2) SELECT date, ticker, round(CASE WHEN x IS NOT NULL THEN CASE WHEN n < 5 OR l < 1e-12 OR g < 1e-12 THEN 0.0 ELSE e / g END END, 6) + 0.0 AS target_weight FROM w3")
def weights_inverse_volatility(spark, sf):
    return rounded(portfolio.InverseVolatilitySignalWeighted().construct(_signals(spark, sf), "mean_reversion_signal", constrain=False).select("date", "ticker", "target_weight"))


def _weights(spark, sf):
    return portfolio.SignalWeightedLongShort().construct(_signals(spark, sf), "mean_reversion_signal").select("date", "ticker", "adj_close", "target_weight")


#: No raw weight reaches the limit of 0.10 here, and ranks are symmetric: clipping at 0.05 leaves sums of zero, and is the projection.
WEIGHTS_SQL = SIGNAL_SQL + """, x0 AS (SELECT date, ticker, adj_close, mean_reversion_signal AS x, mean_reversion_signal - avg(mean_reversion_signal) OVER d AS e, count(mean_reversion_signal) OVER d AS n FROM s WINDOW d AS (PARTITION BY date)), x1 AS (SELECT *, sum(abs(e)) OVER (PARTITION BY date) AS g FROM x0),
ws AS (SELECT date, ticker, adj_close, CASE WHEN x IS NOT NULL THEN CASE WHEN n < 5 OR g < 1e-12 THEN 0.0 ELSE e / g END END AS target_weight FROM x1)"""


@query("weights_projected", WEIGHTS_SQL + " SELECT date, ticker, round(CASE WHEN target_weight IS NOT NULL THEN least(0.05, greatest(-0.05, target_weight)) END, 6) + 0.0 AS target_weight FROM ws")
def weights_projected(spark, sf):
    return rounded(portfolio.SignalWeightedLongShort(max_position=0.05).construct(_signals(spark, sf), "mean_reversion_signal").select("date", "ticker", "target_weight"))


#: Weights that are neither neutral nor small, so that all limits bind on most dates, and each case of them on some.
LIMITED = SIGNAL_SQL + ", rw AS (SELECT date, ticker, 0.15 * mean_reversion_signal + 0.08 * sin(session_idx) AS w FROM s)"
LIMITS = {"max_position": 0.08, "max_gross": 0.6, "max_net": 0.1}


@query("weights_limited", LIMITED + projection_sql.projected("rw", *LIMITS.values()) + " SELECT date, ticker, round(target_weight, 6) + 0.0 AS target_weight FROM px")
def weights_limited(spark, sf):
    raw = _signals(spark, sf).where("mean_reversion_signal is not null").select("date", "ticker", (F.lit(0.15) * F.col("mean_reversion_signal") + F.lit(0.08) * F.sin("session_idx")).alias("target_weight"))
    return rounded(portfolio.constrained(raw, **LIMITS))


@query("limits_that_bind", LIMITED + projection_sql.projected("rw", *LIMITS.values()) + ", e AS (SELECT date, max(abs(target_weight)) AS top, sum(abs(target_weight)) AS gross, abs(sum(target_weight)) AS net FROM px GROUP BY date) SELECT top > 0.08 - 1e-7 AS position, gross > 0.6 - 1e-7 AS gross, net > 0.1 - 1e-7 AS net, count(*) AS dates FROM e GROUP BY ALL")
def limits_that_bind(spark, sf):
    """On how many dates which limits bind."""
    raw = _signals(spark, sf).where("mean_reversion_signal is not null").select("date", "ticker", (F.lit(0.15) * F.col("mean_reversion_signal") + F.lit(0.08) * F.sin("session_idx")).alias("w"))
    days = portfolio.constrained(raw, **LIMITS, weight="w").groupBy("date").agg(F.max(F.abs("w")).alias("top"), F.sum(F.abs("w")).alias("gross"), F.abs(F.sum("w")).alias("net"))
    return days.groupBy((F.col("top") > 0.08 - 1e-7).alias("position"), (F.col("gross") > 0.6 - 1e-7).alias("gross"), (F.col("net") > 0.1 - 1e-7).alias("net")).agg(F.count("*").alias("dates"))


@query("cost_fills", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({v}, 5) AS {k}" for k, v in {"fill_price": "CASE WHEN l_returnflag = 'R' THEN greatest((l_extendedprice / l_quantity) * (1 - 0.001), 0.01) ELSE (l_extendedprice / l_quantity) * (1 + 0.001) END", "commission": "(l_extendedprice / l_quantity) * l_quantity * 0.0005", "spread_cost": "(l_extendedprice / l_quantity) * l_quantity * 0.0005", "slippage_cost": "(l_extendedprice / l_quantity) * l_quantity * 0.0005"}.items()) + " FROM lineitem")
def cost_fills(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    cost = execution.CostModel().columns(F.when(F.col("l_returnflag") == "R", -1).otherwise(1), F.col("l_quantity"), price)
    return rounded(items.select("l_orderkey", "l_linenumber", *(c.alias(k) for k, c in cost.items())), 5)


def runs_sql(rows: str) -> str:
    return (WEIGHTS_SQL + ledger_sql.ledger(rows)).replace("WITH bars", "WITH RECURSIVE bars", 1) + ledger_sql.snapshots()


MONEY = ("equity", "cash", "holdings_value", "commission", "slippage_cost", "spread_cost", "total_cost")
SHARES = ("gross_exposure", "net_exposure", "cash_ratio", "daily_return", "turnover")


def _rounded_metrics(df):
    return rounded(df, 5, total_cost_usd=1, cost_drag_bps=2)


@query("backtest_ledger", runs_sql(ledger_sql.costed("ws")) + " SELECT run_id, " + out("date", *MONEY, digits=2) + ", " + out("", *SHARES, digits=6)[2:] + " FROM sn")
def backtest_ledger(spark, sf):
    return rounded(execution.run_backtests(_weights(spark, sf)).snapshots, 6, **dict.fromkeys(MONEY, 2))


@query("backtest_fills", runs_sql(ledger_sql.costed("ws")) + ledger_sql.fills() + " SELECT run_id, " + out("date, ticker, direction", "quantity", "reference_price", "fill_price", "commission", "spread_cost", "slippage_cost", digits=2) + ", round(target_weight, 6) + 0.0 AS target_weight FROM fl")
def backtest_fills(spark, sf):
    return rounded(execution.run_backtests(_weights(spark, sf)).fills, 2, target_weight=6)


@query("backtest_metrics", runs_sql(ledger_sql.costed("ws")) + ledger_sql.metrics() + f" SELECT {ledger_sql.rounded_metrics()} FROM pm")
def backtest_metrics(spark, sf):
    return _rounded_metrics(metrics.performance(execution.run_backtests(_weights(spark, sf)).snapshots))


REGIMES = {k: (m.commission_bps, m.spread_bps, m.slippage_bps) for k, m in execution.COST_REGIMES.items()}
GROSS = ", sg AS (SELECT * EXCLUDE (gross_return), split_part(run_id, '/', 2) AS cost, max(daily_return) FILTER (run_id LIKE '%/zero') OVER (PARTITION BY date) AS gross_return FROM sn)"


@query("cost_sensitivity", runs_sql(ledger_sql.costed("ws", costs=REGIMES)) + GROSS + ledger_sql.metrics("sg", "cost") + f" SELECT {ledger_sql.rounded_metrics('cost')} FROM pm")
def cost_sensitivity(spark, sf):
    return _rounded_metrics(validation.cost_sensitivity(_weights(spark, sf)))


DROPPED = ", ".join(f"('{k}', {out_})" for k, out_ in validation.dropped_tickers(BRANDS).items())


@query("asset_drop_stability", runs_sql(ledger_sql.costed(f"(SELECT ws.*, run FROM ws JOIN (VALUES {DROPPED}) j(run, left_out) ON NOT list_contains(left_out, ticker))", "run")) + ledger_sql.metrics() + f" SELECT {ledger_sql.rounded_metrics()} FROM pm")
def asset_drop(spark, sf):
    return _rounded_metrics(validation.asset_drop_stability(_weights(spark, sf)))


@query("subperiods", runs_sql(ledger_sql.costed("ws", "CASE WHEN date < DATE '1999-01-01' THEN 'pre' ELSE 'post' END")) + ledger_sql.metrics() + f" SELECT {ledger_sql.rounded_metrics()} FROM pm")
def subperiods(spark, sf):
    return _rounded_metrics(validation.subperiods(_weights(spark, sf), "1999-01-01"))


def _windows():
    return tuple(validation.WalkForwardWindow(k, "1995-01-01", f"{1996 + k}-12-31", f"{1997 + k}-01-01", f"{1997 + k}-12-31", k == 3) for k in (1, 2, 3))


PARTS = ", ".join(f"('w{w.id}/is', DATE '{w.train_start}', DATE '{w.train_end}'), ('w{w.id}/oos', DATE '{w.test_start}', DATE '{w.test_end}')" for w in _windows())
WINDOWED = runs_sql(ledger_sql.costed(f"(SELECT ws.*, run FROM ws JOIN (VALUES {PARTS}) j(run, a, b) ON date BETWEEN a AND b)", "run"))


@query("walk_forward", WINDOWED + ledger_sql.metrics() + f" SELECT {ledger_sql.rounded_metrics()} FROM pm")
def walk_forward(spark, sf):
    return _rounded_metrics(validation.walk_forward(_weights(spark, sf), _windows()).metrics)


MOMENTS = ", b0 AS (SELECT run_id, daily_return AS r, avg(daily_return) OVER (PARTITION BY run_id) AS a FROM sn), mo AS (SELECT run_id, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std, coalesce(avg(pow(r - a, 3)) / nullif(pow(avg(pow(r - a, 2)), 1.5), 0), 0) AS skew, coalesce(avg(pow(r - a, 4)) / nullif(pow(avg(pow(r - a, 2)), 2), 0), 3) AS kurtosis FROM b0 GROUP BY run_id)"


@query("sharpe_probabilities", WINDOWED + MOMENTS + f" SELECT run_id, round({ledger_sql.sharpe_probability(0.0)}, 6) + 0.0 AS psr, round({ledger_sql.sharpe_probability(metrics.expected_best_sharpe(10))}, 6) + 0.0 AS dsr FROM mo")
def sharpe(spark, sf):
    return rounded(validation.walk_forward(_weights(spark, sf), _windows(), trials=10).probabilities)


# Metrics and regimes over the market proxy

MARKET = PANEL + ", mr AS (SELECT date, ticker, (adj_close - lag(adj_close) OVER w) / nullif(lag(adj_close) OVER w, 0) AS r FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)), mm AS (SELECT date, avg(r) AS market_return FROM mr GROUP BY date), mk AS (SELECT *, 100 * product(1 + coalesce(market_return, 0)) OVER (ORDER BY date) AS market_price FROM mm)"


@query("market_proxy", MARKET + " SELECT date, round(market_return, 6) + 0.0 AS market_return, round(ln(market_price), 6) AS log_price FROM mk")
def market(spark, sf):
    m = regimes.market_proxy(lineitem_panel(spark, sf))
    return m.select("date", half_up("market_return").alias("market_return"), half_up(F.ln("market_price")).alias("log_price"))


def _run(spark, sf):
    """A hundredth of the market's changes, compounded: bars of noise change by half a day by day."""
    m = regimes.market_proxy(lineitem_panel(spark, sf)).withColumn("daily_return", F.col("market_return") / 100.0)
    grown = F.product(1.0 + F.coalesce("daily_return", F.lit(0.0))).over(Window.partitionBy(F.lit(0)).orderBy("date"))
    return m.select(F.lit("market").alias("run_id"), "date", "daily_return", grown.alias("equity"))


SMALL = MARKET.replace("avg(r) AS market_return", "avg(r) / 100.0 AS market_return").replace("100 * product", "product")


@query("drawdowns", SMALL + ", dd AS (SELECT date, market_price / max(market_price) OVER (ORDER BY date) - 1 AS drawdown FROM mk) SELECT date, round(drawdown, 6) + 0.0 AS drawdown FROM dd")
def drawdown(spark, sf):
    return rounded(metrics.drawdowns(_run(spark, sf)).select("date", "drawdown"))


@query("performance_metrics", SMALL + """, x AS (SELECT date, market_return AS r, market_price AS e FROM mk WHERE market_return IS NOT NULL), dd AS (SELECT *, e / max(e) OVER (ORDER BY date) - 1 AS f FROM x), isl AS (SELECT *, sum((f >= 0)::INT) OVER (ORDER BY date) AS i FROM dd),
runs AS (SELECT i, min(f) AS low, count(*) FILTER (f < 0) AS days FROM isl GROUP BY i), rr AS (SELECT min(low) AS mdd, max(days) AS dur FROM runs),
b AS (SELECT count(*) AS t, avg(r) AS m, stddev_samp(r) AS sd, arg_min(e, date) AS e0, arg_max(e, date) AS e1, sqrt(avg(r * r) FILTER (r < 0)) * sqrt(252.0) AS down, avg((r > 0)::INT) AS hit, sum(r) FILTER (r > 0) AS g, -sum(r) FILTER (r < 0) AS l FROM x),
c AS (SELECT *, pow(e1 / e0, 252.0 / t) - 1 AS cagr FROM b, rr)
SELECT 'market' AS run_id, round(cagr, 5) + 0.0 AS cagr, round(m * 252, 5) + 0.0 AS annualized_return, round(sd * sqrt(252.0), 5) + 0.0 AS annualized_volatility, round(m / sd * sqrt(252.0), 5) + 0.0 AS sharpe_ratio, round(m * 252 / down, 5) + 0.0 AS sortino_ratio, round(mdd, 5) + 0.0 AS max_drawdown, dur AS max_drawdown_duration_days,
round(cagr / abs(mdd), 5) + 0.0 AS calmar_ratio, round(hit, 5) + 0.0 AS daily_hit_rate, round(g / l, 5) + 0.0 AS profit_factor, 0e0 AS average_daily_turnover, 0e0 AS annualized_turnover, 0e0 AS total_cost_usd, 0e0 AS cost_drag_bps, t AS total_trading_days FROM c""")
def performance_metrics(spark, sf):
    return rounded(metrics.performance(_run(spark, sf)), 5)


@query("return_moments", SMALL + ", x AS (SELECT market_return AS r, avg(market_return) OVER () AS m FROM mk WHERE market_return IS NOT NULL) SELECT 'market' AS run_id, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5), 5) + 0.0 AS skew, round(avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2), 5) AS kurtosis FROM x")
def moments(spark, sf):
    x = metrics.return_moments(_run(spark, sf))
    return x.select("run_id", "n", half_up("mean").alias("mean"), half_up("std").alias("std"), half_up("skew", 5).alias("skew"), half_up("kurtosis", 5).alias("kurtosis"))


def back(n: int) -> str:
    return f"(ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


VOL_REGIME = MARKET + f", v AS (SELECT *, CASE WHEN count(market_return) OVER {back(20)} >= 10 THEN stddev_samp(market_return) OVER {back(20)} * sqrt(252.0) END AS vol FROM mk), vq AS (SELECT *, quantile_cont(vol, 0.4) OVER () AS lo, quantile_cont(vol, 0.6) OVER () AS hi FROM v), vr AS (SELECT date, market_return, CASE WHEN vol IS NULL THEN NULL WHEN vol <= lo THEN 'LOW_VOL' WHEN vol > hi THEN 'HIGH_VOL' ELSE 'NORMAL_VOL' END AS regime FROM vq)"


@query("volatility_regime", VOL_REGIME + " SELECT date, regime FROM vr")
def volatility_regime(spark, sf):
    return regimes.volatility_regime(regimes.market_proxy(lineitem_panel(spark, sf))).select("date", "regime")


@query("trend_regime", MARKET + f", t AS (SELECT date, CASE WHEN count(market_price) OVER {back(50)} >= 25 THEN avg(market_price) OVER {back(50)} END AS f, CASE WHEN count(market_price) OVER {back(200)} >= 100 THEN avg(market_price) OVER {back(200)} END AS s FROM mk) SELECT date, CASE WHEN f <= s THEN 'BEAR_TREND' WHEN f IS NOT NULL AND s IS NOT NULL THEN 'BULL_TREND' END AS regime FROM t")
def trend_regime(spark, sf):
    return regimes.trend_regime(regimes.market_proxy(lineitem_panel(spark, sf))).select("date", "regime")


@query("composite_regime", MARKET + f""", v AS (SELECT *, CASE WHEN count(market_return) OVER {back(20)} >= 20 THEN stddev_samp(market_return) OVER {back(20)} * sqrt(252.0) END AS vol FROM mk),
q AS (SELECT *, CASE WHEN count(vol) OVER {back(252)} >= 60 THEN quantile_cont(vol, 0.25) OVER {back(252)} END AS q1, CASE WHEN count(vol) OVER {back(252)} >= 60 THEN quantile_cont(vol, 0.75) OVER {back(252)} END AS q3, CASE WHEN count(market_return) OVER {back(60)} >= 60 THEN product(1 + market_return) OVER {back(60)} - 1 END AS g FROM v),
k AS (SELECT date, CASE WHEN vol IS NOT NULL THEN CASE WHEN vol < q1 THEN 'low' WHEN vol > q3 THEN 'high' ELSE 'medium' END END AS vol_regime, CASE WHEN g > 0 THEN 'trending' WHEN g IS NOT NULL THEN 'non_trending' END AS trend_regime FROM q) SELECT *, vol_regime || '_' || trend_regime AS regime_composite FROM k""")
def composite_regime(spark, sf):
    return regimes.composite_regime(regimes.market_proxy(lineitem_panel(spark, sf))).select("date", "vol_regime", "trend_regime", "regime_composite")


@query("regime_performance", VOL_REGIME + " SELECT regime, count(*) AS total_trading_days, round(avg(market_return) * 252, 5) + 0.0 AS annualized_return, round(stddev_samp(market_return) * sqrt(252.0), 5) AS annualized_volatility FROM vr WHERE regime IS NOT NULL AND market_return IS NOT NULL GROUP BY regime HAVING count(*) >= 5")
def regime_performance(spark, sf):
    m = regimes.market_proxy(lineitem_panel(spark, sf))
    out = regimes.performance_by_regime(m.select("date", F.col("market_return").alias("daily_return")), regimes.volatility_regime(m))
    return rounded(out.select("regime", "total_trading_days", "annualized_return", "annualized_volatility"), 5)


@query("extreme_days_removed", MARKET + ", x AS (SELECT market_return AS r, row_number() OVER (ORDER BY market_return DESC, date) AS b, row_number() OVER (ORDER BY market_return, date) AS w FROM mk WHERE market_return IS NOT NULL) SELECT count(*) AS total_trading_days, round(avg(r) * 252, 5) + 0.0 AS annualized_return FROM x WHERE b > 5 AND w > 5")
def extreme_days(spark, sf):
    m = regimes.market_proxy(lineitem_panel(spark, sf)).select("date", F.col("market_return").alias("daily_return"))
    return rounded(validation.extreme_days_removed(m).select("total_trading_days", "annualized_return"), 5)


# Learning


def _split(spark, sf):
    return "1998-12-31", "1999-01-01", "2000-12-31"


@query("ols_univariate", BASE + " SELECT round(regr_slope(fwd_ret_1d, zscore_price_20), 6) AS slope, round(regr_intercept(fwd_ret_1d, zscore_price_20), 6) AS intercept FROM f WHERE fwd_ret_1d IS NOT NULL AND zscore_price_20 IS NOT NULL")
def ols_univariate(spark, sf):
    df = features.compute_features(lineitem_panel(spark, sf)).dropna(subset=["zscore_price_20", "fwd_ret_1d"])
    m = learning.LinearModel().fit(df, ["zscore_price_20"], "fwd_ret_1d")
    return spark.createDataFrame([tuple(None if math.isnan(x) else math.floor(float(x) * 1e6 + 0.5) / 1e6 for x in (m.coefficients[0], m.intercept))], "slope double, intercept double")


ML_FEATURES = ("ret_20d", "zscore_price_20", "realized_vol_60", "relative_volume")


def _learned(model):
    def run(spark, sf):
        df = features.compute_features(lineitem_panel(spark, sf))
        got = learning.train_and_predict(df, model, *_split(spark, sf), target="fwd_ret_5d", features=ML_FEATURES).select("date", "ticker", "prediction", "ml_signal")
        return got if model == "xgboost" else rounded(got)

    return run


def learned_sql(**penalty: float) -> str:
    """Fitted on dates up to the first of _split()."""
    a, b, c = _split(None, None)
    train = f"(SELECT * FROM f WHERE date <= DATE '{a}')"
    model = ledger_sql.linear_model(train, ML_FEATURES, "fwd_ret_5d", **penalty)
    tested = f", t0 AS (SELECT date, ticker, CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in ML_FEATURES)} THEN {ledger_sql.prediction(ML_FEATURES)} END AS prediction FROM f, lm WHERE date BETWEEN DATE '{b}' AND DATE '{c}'), t1 AS (SELECT *, count(prediction) OVER (PARTITION BY date) AS n, {rank_of('prediction')} AS r FROM t0)"
    sql = BASE + model + tested + " SELECT date, ticker, round(prediction, 6) + 0.0 AS prediction, round(CASE WHEN prediction IS NOT NULL THEN CASE WHEN n < 2 THEN 0 ELSE 2 * (r - 1) / (n - 1) - 1 END END, 6) + 0.0 AS ml_signal FROM t1"
    return sql.replace("WITH bars", "WITH RECURSIVE bars", 1)


for _name, _penalty in {"ols": {}, "ridge": {"ridge": 1.0}, "lasso": {"lasso": 0.001}}.items():
    query(f"ml_{_name}", learned_sql(**_penalty))(_learned(_name))
query("ml_xgboost")(_learned("xgboost"))


def two_ics_sql(source: str, a: str, b: str, target: str, lags: int) -> str:
    """dh: mean ICs of columns a and b of source, and the HAC t of their daily difference."""
    one = lambda x, name: f""", {name}0 AS (SELECT date, {x} AS x0, {target} AS y0 FROM {source} WHERE {x} IS NOT NULL AND {target} IS NOT NULL), {name}1 AS (SELECT date, {rank_of("x0")} AS x, {rank_of("y0")} AS y FROM {name}0),
 {name} AS (SELECT date, CASE WHEN count(*) >= 5 THEN CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN 0.0 ELSE covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END END AS ic FROM {name}1 GROUP BY date)"""  # noqa: E731
    both = ", dd AS (SELECT date, ia.ic AS a, ib.ic AS b, ia.ic - ib.ic AS d FROM ia JOIN ib USING (date) WHERE ia.ic IS NOT NULL AND ib.ic IS NOT NULL)"
    return one(a, "ia") + one(b, "ib") + both + hac_sql("dd", "d", lags) + ", dm AS (SELECT avg(a) AS mean_ic, avg(b) AS baseline_ic FROM dd)"


def _ml_signals(spark, sf):
    df = _signals(spark, sf)
    return learning.train_and_predict(df, "ridge", *_split(spark, sf), target="fwd_ret_5d", features=ML_FEATURES)


ML_BOTH = SIGNAL_SQL + ledger_sql.linear_model(f"(SELECT * FROM f WHERE date <= DATE '{_split(None, None)[0]}')", ML_FEATURES, "fwd_ret_5d", ridge=1.0) + f", u0 AS (SELECT f.date, f.ticker, s.mean_reversion_signal, f.fwd_ret_5d, {ledger_sql.prediction(tuple(f'f.{x}' for x in ML_FEATURES))} AS ml FROM f JOIN s USING (date, ticker), lm WHERE f.date BETWEEN DATE '{_split(None, None)[1]}' AND DATE '{_split(None, None)[2]}')"


@query("ml_comparison", ML_BOTH + two_ics_sql("u0", "ml", "mean_reversion_signal", "fwd_ret_5d", 5) + " SELECT h.n, round(mean_ic, 6) + 0.0 AS mean_ic, round(baseline_ic, 6) + 0.0 AS baseline_ic, round(mean, 6) + 0.0 AS delta_ic, round(CASE WHEN hac_se > 1e-12 THEN mean / hac_se ELSE 0 END, 5) + 0.0 AS t FROM h, dm")
def ml_comparison(spark, sf):
    got = learning.compare_with_baseline(_ml_signals(spark, sf), "ml_signal", "mean_reversion_signal", "fwd_ret_5d", 5)
    return rounded(spark.createDataFrame([tuple(got[k] for k in ("n", "mean_ic", "baseline_ic", "delta_ic", "t"))], "n long, mean_ic double, baseline_ic double, delta_ic double, t double"), t=5)


INTERVALS = ", iv AS (SELECT key, n, quantile_cont(sharpe, 0.025) AS s0, quantile_cont(sharpe, 0.975) AS s1, quantile_cont(cagr, 0.025) AS c0, quantile_cont(cagr, 0.975) AS c1 FROM bb GROUP BY ALL), ir AS (SELECT key, n, 'sharpe' AS metric, s0 AS low, s1 AS high FROM iv UNION ALL SELECT key, n, 'cagr', c0, c1 FROM iv), im AS (SELECT key, metric, round(CASE WHEN n >= 10 THEN low ELSE 0 END, 6) + 0.0 AS low, round(CASE WHEN n >= 10 THEN high ELSE 0 END, 6) + 0.0 AS high FROM ir)"


@query("pnl_bootstrap", runs_sql(ledger_sql.costed("ws")) + resampling_sql.replicates("sn", "daily_return", "run_id", 1000, 0.1) + INTERVALS + " SELECT metric, low, high FROM im")
def pnl_bootstrap(spark, sf):
    """Confidence intervals of the Sharpe ratio and CAGR of the backtest's daily returns."""
    return rounded(validation.pnl_intervals(execution.run_backtests(_weights(spark, sf)).snapshots).drop("run_id"))


@query("pnl_bootstrap_costs", runs_sql(ledger_sql.costed("ws", costs=REGIMES)) + resampling_sql.replicates("sn", "daily_return", "run_id", 1000, 0.1) + INTERVALS + ", " + "il AS (SELECT key, metric, CASE WHEN metric = 'cagr' THEN CASE WHEN low > -1 THEN ln(1 + low) END ELSE low END AS low, CASE WHEN metric = 'cagr' THEN CASE WHEN high > -1 THEN ln(1 + high) END ELSE high END AS high FROM ir) SELECT split_part(key, '/', 2) AS cost, CASE metric WHEN 'cagr' THEN 'log_growth' ELSE metric END AS metric, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high FROM il")
def pnl_bootstrap_costs(spark, sf):
    """The same of a run under each cost regime, 1000 replicates each, in one plan; growth as ln(1 + CAGR), as it may be
    large here."""
    runs = execution.run_backtests(_weights(spark, sf), "adj_close", execution.COST_REGIMES).snapshots
    log = lambda c: F.when(F.col("metric") == "cagr", F.when(F.col(c) > -1, F.log1p(c))).otherwise(F.col(c)).alias(c)
    name = F.when(F.col("metric") == "cagr", "log_growth").otherwise(F.col("metric")).alias("metric")
    return rounded(validation.pnl_intervals(runs).select(F.substring_index("run_id", "/", -1).alias("cost"), name, log("low"), log("high")))


@query("integrity_audit", runs_sql(ledger_sql.costed("ws")) + ledger_sql.fills() + """, ff AS (SELECT min(date) AS first FROM sn), v AS (SELECT run_id, date, 'trade_on_first_session' AS problem FROM fl, ff WHERE date <= first UNION ALL SELECT run_id, date, 'trade_after_termination' FROM fl WHERE ticker = 'Brand#1' AND date > DATE '1998-06-16'
 UNION ALL SELECT run_id, date, 'blocked_ticker' FROM fl WHERE ticker IN ('Brand#2', 'Brand#3') UNION ALL SELECT run_id, date, 'gross_exposure' FROM sn WHERE gross_exposure > 1.1 UNION ALL SELECT run_id, date, 'net_exposure' FROM sn WHERE abs(net_exposure) > 0.2 UNION ALL SELECT run_id, date, 'books' FROM sn WHERE abs(equity - cash - holdings_value) > 1e-4) SELECT * FROM v""")
def integrity_audit(spark, sf):
    result = execution.run_backtests(_weights(spark, sf))
    return validation.integrity_violations(result, 1.1, {"Brand#1": date(1998, 6, 15)}, ("Brand#2", "Brand#3"), 0.2)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Daily rank IC of one-session reversal against the next session's return."""
    df = lineitem_panel(spark, sf)
    df = df.withColumns({"reversal": -features.simple_return("adj_close", 1), "fwd_ret_1d": features.forward_return("adj_close", 1)})
    return rounded(inference.daily_ic(df, "reversal", "fwd_ret_1d").select("date", "n", "ic"))


query("reversal_ic", PANEL + f", b AS (SELECT date, -({RETURNS['ret_1d']}) AS x0, {RETURNS['fwd_ret_1d']} AS y0 FROM panel), p AS (SELECT * FROM b WHERE x0 IS NOT NULL AND y0 IS NOT NULL), pr AS (SELECT date, {rank_of('x0')} AS x, {rank_of('y0')} AS y FROM p), ic AS (SELECT date, CASE WHEN count(*) >= 5 THEN CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN 0.0 ELSE covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END END AS ic, count(*) AS n FROM pr GROUP BY date) SELECT date, n, round(ic, 6) + 0.0 AS ic FROM ic")(flagship)
