"""Queries of the reference's own operators do the whole job: its counts of draws, signals, horizons, tickers and dates."""

import os
from datetime import date

import duckdb
import pytest

from panelspark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"  # at the smallest size no signal has the history it needs
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@tables
@pytest.mark.parametrize(("name", "rows"), [("permutation_test", 1001), ("bootstrap_mean", 10_000), ("null_simulation", 100)])
def test_draws(spark, name, rows):
    assert QUERIES[name](spark, SF).count() == rows


def test_null_simulation_has_the_reference_dates_and_tickers(spark):
    from panelspark.operators import resampling

    theirs = {r["signal"]: r["mean_ic"] for r in resampling.null_simulation(spark, 500, 50, 100).collect()}
    assert {r["signal"]: r["mean_ic"] for r in QUERIES["null_simulation"](spark, SF).collect()} == theirs


def test_synthetic_panel(spark):
    df = QUERIES["synthetic_panel"](spark, SF)
    last = {r["ticker"]: r["d"] for r in df.groupBy("ticker").agg({"date": "max"}).withColumnRenamed("max(date)", "d").collect()}
    assert len(last) == 100 and max(last.values()).year == 2024
    assert last["EMC"] <= date(2016, 9, 7) and last["MON"] <= date(2018, 6, 7) and last["TWX"] <= date(2018, 6, 14)


@tables
def test_horizon_profile_all(spark):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = sorted(con.execute(f"SELECT signal, horizon, n, mean_ic FROM ({ORACLE_SQL['horizon_profile_all']})").fetchall(), key=repr)
    ours = sorted((tuple(r) for r in QUERIES["horizon_profile_all"](spark, SF).select("signal", "horizon", "n", "mean_ic").collect()), key=repr)
    assert len({r[:2] for r in ours}) == 24 and [r[:3] for r in ours] == [r[:3] for r in theirs]
    assert all(a[3] == b[3] or a[3] == pytest.approx(b[3], abs=2e-6) for a, b in zip(ours, theirs))
