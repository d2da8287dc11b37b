"""Sources and sinks: what is loaded, refused, mapped and written."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelspark.plans.research import backtest, ingest_panel
from panelspark.sources import config, panels, tables
from panelspark.sources.calendar import trading_sessions

BARS = "date string, ticker string, open double, high double, low double, close double, adj_close double, volume long, split_factor double"


def test_load_ohlcv(spark, tmp_path):
    spark.createDataFrame([("2020-01-02", "A", float("nan"))], "date string, ticker string, adj_close double").write.parquet(f"{tmp_path}/p")
    row = panels.load_ohlcv(spark, f"{tmp_path}/p").first()
    assert row["date"] == date(2020, 1, 2) and row["adj_close"] is None
    spark.createDataFrame([("A",)], "ticker string").write.parquet(f"{tmp_path}/q")
    with pytest.raises(ValueError, match="date"):
        panels.load_ohlcv(spark, f"{tmp_path}/q")


def test_load_universe(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,name\n msft ,M\nAAPL,A\naapl,A\n,none\n")
    assert panels.load_universe(spark, f"{tmp_path}/u.csv") == ["AAPL", "MSFT"]
    (tmp_path / "e.csv").write_text("ticker,name\n")
    with pytest.raises(ValueError):
        panels.load_universe(spark, f"{tmp_path}/e.csv")
    with pytest.raises(KeyError):
        panels.load_universe(spark, f"{tmp_path}/u.csv", "symbol")
    (tmp_path / "m.json").write_text('{"name": "x",\n "n": 2}')
    assert panels.load_metadata(spark, f"{tmp_path}/m.json") == {"name": "x", "n": 2}


def test_ticker_names(spark):
    df = spark.createDataFrame([(" brk-b",), ("META",), ("RTX",), ("aapl",)], "t string")
    got = df.select(panels.canonical_ticker(F.col("t")).alias("c")).select("c", panels.provider_ticker(F.col("c")).alias("p")).collect()
    assert [(r["c"], r["p"]) for r in got] == [("BRK.B", "BRK-B"), ("FB", "META"), ("UTX", "RTX"), ("AAPL", "AAPL")]


def bars(spark, tickers, days):
    return spark.createDataFrame([(str(d), t, 10.0, 11.0, 9.0, 10.0 + i, 10.0 + i, 100, 1.0) for t in tickers for i, d in enumerate(days)], BARS)


def test_ingest(spark):
    days = [date(2020, 1, d) for d in (2, 3, 6, 7, 20)]
    raw = bars(spark, ["aapl", "META", "EMC"], days).unionByName(bars(spark, ["LATE"], days[4:]))
    got = {r["ticker"] for r in panels.ingest(raw, ["AAPL", "FB"], "2020-01-02").select("ticker").distinct().collect()}
    assert got == {"AAPL", "FB"}  # EMC is blocked, LATE begins too late
    with pytest.raises(RuntimeError, match="1 of 3"):
        panels.ingest(raw, ["AAPL", "FB", "LATE"], "2020-01-02")
    assert panels.ingest(raw, ["AAPL", "FB", "EMC"], "2020-01-02").count() == 10  # a blocked one is no failure


def test_write_panel(spark, tmp_path):
    df = bars(spark, ["B", "A"], [date(2020, 1, 3), date(2020, 1, 2)])
    panels.write_panel(df, f"{tmp_path}/panel", {"b": 1, "a": date(2020, 1, 2)})
    got = panels.load_ohlcv(spark, f"{tmp_path}/panel")
    assert got.count() == 4 and got.columns == df.columns
    assert json.loads(spark.read.text(f"{tmp_path}/panel.meta").first()[0]) == {"a": "2020-01-02", "b": 1}
    (tmp_path / "f").write_bytes(b"abc")
    assert panels.file_key(f"{tmp_path}/f") == "ba7816bf8f01cfea"


def test_ingest_panel_and_backtest(spark, tmp_path):
    days = [r["date"] for r in trading_sessions(spark, "2014-01-01", "2014-12-31").orderBy("date").collect()]
    raw = panels.synthetic_ohlcv(spark, [f"S{k}" for k in range(8)], days).withColumn("split_factor", F.lit(1.0)).drop("volume_split_adjusted")
    report = ingest_panel(spark, raw, [f"S{k}" for k in range(8)], "2014-01-01", "2014-12-31", f"{tmp_path}/panel")
    assert report is not None and panels.load_ohlcv(spark, f"{tmp_path}/panel").count() > 1900
    c = config.from_dict({"signal": {"name": "mean_reversion_zscore", "params": {"lookback": 20, "threshold": None}}, "portfolio": {"method": "equal_weight"}, "data": {"panel": f"{tmp_path}/panel"}})
    result, metrics = backtest(spark, c)
    row = metrics.first()
    assert row["total_trading_days"] == len(days) and row["total_cost_usd"] > 0
    assert result.snapshots.orderBy("date").first()["equity"] == 1e6


def test_synthetic_ohlcv(spark):
    days = [date(2020, 1, d) for d in range(1, 31)]
    make = lambda names: panels.synthetic_ohlcv(spark, names, days, missing=0.0, terminations={"B": days[9]})
    rows = make(["A", "B"]).collect()
    assert sorted(rows) == sorted(make(["A", "B"]).repartition(3).collect())
    assert sum(r["ticker"] == "B" for r in rows) == 10
    assert all(r["low"] <= min(r["open"], r["close"]) and max(r["open"], r["close"]) <= r["high"] and r["low"] > 0 for r in rows)


def test_shared_tables(spark):
    scratch = tables.Scratch(spark)
    kept, gone = tables.written(spark.range(3)), scratch.written(spark.range(2))
    assert kept.count() == 3 and gone.count() == 2
    scratch.remove()
    assert kept.count() == 3
    with pytest.raises(Exception, match="[Nn]o such file|does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        spark.read.parquet(scratch.folder).count()


def test_cached_tables(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(4)

    assert tables.cached(spark, str(tmp_path), "k", make).count() == 4 == tables.cached(spark, str(tmp_path), "k", make).count()
    assert len(made) == 1
    (tmp_path / "k" / "_SUCCESS").unlink()  # as a lost writer leaves it
    assert tables.cached(spark, str(tmp_path), "k", make).count() == 4 and len(made) == 2
