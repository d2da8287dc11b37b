"""Progress of long tests, the report that is observed while a panel is written, and panels kept by what they are made of."""

import os
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.progress import watched
from panelspark.operators import quality, resampling
from panelspark.plans.research import ingest_panel, provided_panel
from panelspark.sources import panels, provider, tables
from panelspark.sources.calendar import trading_sessions

DAYS = [date(2020, 1, 1) + timedelta(days=k) for k in range(60)]


def test_progress_of_a_permutation_test(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(DAYS[d], f"T{i}", float(r.normal()), float(r.normal())) for d in range(40) for i in range(8)], "date date, ticker string, s double, y double")
    seen = []
    plain = resampling.permutation_test(df, "s", "y", 200)
    assert resampling.permutation_test(df, "s", "y", 200, progress=lambda done, total: seen.append((done, total))) == plain
    done = [d for d, _ in seen]
    assert seen[-1] == (200, 200) and all(t == 200 for _, t in seen) and done == sorted(set(done))


def test_progress_of_bootstraps(spark):
    seen = []
    x = np.random.default_rng(0).normal(0.5, 1, 80)
    want = resampling.bootstrap_mean_ci(x, 900, block=5, batch=300)
    assert resampling.bootstrap_mean_ci(x, 900, block=5, batch=300, progress=lambda *a: seen.append(a)) == want and seen == [(300, 900), (600, 900), (900, 900)]
    rows = spark.createDataFrame([(DAYS[0] + timedelta(days=k), float(v)) for k, v in enumerate(x)], "date date, ic double")
    seen.clear()
    mean, low, high = resampling.bootstrap_interval(rows, "ic", 2000, block=5, progress=lambda *a: seen.append(a))
    assert mean == pytest.approx(x.mean()) and (low, high) == pytest.approx(want[1:], abs=0.08) and seen[-1] == (2000, 2000)
    assert resampling.bootstrap_interval(rows.limit(3), "ic")[1] == resampling.bootstrap_interval(rows.limit(3), "ic")[0]
    assert np.isnan(resampling.bootstrap_interval(rows.where("false"), "ic")[0])


def test_progress_grows_while_tasks_end(spark):
    seen = []
    slow = spark.range(0, 16, 1, 16).select(F.udf(lambda k: __import__("time").sleep(0.4) or int(k), "long")("id").alias("k"))
    with watched(spark, 1000, lambda *a: seen.append(a), every=0.05):
        assert slow.count() == 16 and slow.agg(F.sum("k")).first()[0] == 120
    assert len(seen) > 2 and seen[-1] == (1000, 1000) and all(0 < d < 1000 for d, _ in seen[:-1])
    with pytest.raises(ValueError, match="stop"):
        with watched(spark, 10, lambda *a: (_ for _ in ()).throw(ValueError("stop")), every=0.05):
            slow.agg(F.sum("k")).first()
    with pytest.raises(ZeroDivisionError):
        with watched(spark, 10, seen.append):
            1 / 0
    with watched(spark, 10, None):
        pass
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def raw(spark):
    r = np.random.default_rng(2)
    days = [x["date"] for x in trading_sessions(spark, "2020-01-01", "2020-06-30").orderBy("date").collect()]
    rows = []
    for k in range(6):
        for i, d in enumerate(days[: 60 if k == 4 else None]):
            if r.random() < 0.05:
                continue
            p = float(10 + r.normal()) * (3.0 if r.random() < 0.03 else 1.0)
            rows.append((d, f"S{k}", p, p - 1 if r.random() < 0.3 else p + 1, p - 0.5, -p if r.random() < 0.02 else p, p, 100, 1.0))
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, adj_close double, volume long, split_factor double")


def test_the_observed_report_is_that_of_validate(spark, tmp_path):
    df = raw(spark)
    report = ingest_panel(spark, df, [f"S{k}" for k in range(6)], "2020-01-01", "2020-06-30", f"{tmp_path}/panel")
    panel = panels.load_ohlcv(spark, f"{tmp_path}/panel")
    clean, want = quality.clean(panels.ingest(df, [f"S{k}" for k in range(6)], "2020-01-01"), trading_sessions(spark, "2020-01-01", "2020-06-30"))
    assert sorted(map(repr, panel.collect())) == sorted(map(repr, clean.select(*panel.columns).collect()))
    assert report.counts() == want.counts() and report.is_clean == want.is_clean is False and report.terminated == want.terminated != {}
    for name in ("structural", "moves", "missing"):
        key = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
        assert key(getattr(report, name).collect()) == key(getattr(want, name).collect()), name
    assert report.observed["rows"] == panel.count() and report.observed["open_above_high"] > 20


def test_the_report_costs_no_scan(spark, tmp_path):
    raw(spark).write.parquet(f"{tmp_path}/raw")
    df = spark.read.parquet(f"{tmp_path}/raw")
    tickers = [f"S{k}" for k in range(6)]

    def write(rows):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and plan.count("CollectMetrics quality") == 1
        rows.write.parquet(f"{tmp_path}/out")
        return spark.read.parquet(f"{tmp_path}/out")

    days = trading_sessions(spark, "2020-01-01", "2020-06-30")
    _, report = quality.write_observed(df, write, days, tickers)
    assert report.counts()["large_moves"] > 0 and not report.is_clean and report.missing.count() == 6
    os.rename(f"{tmp_path}/raw", f"{tmp_path}/gone")  # nothing reads the raw rows again
    assert report.structural.count() and report.moves.count()


def test_panels_are_kept_by_what_they_are_made_of(spark, tmp_path):
    bars = raw(spark)
    folder, cache, tickers = f"{tmp_path}/files", f"{tmp_path}/cache", [f"S{k}" for k in range(6)]
    provider.write_provider_files(bars, folder)
    get = lambda **o: provided_panel(spark, folder, tickers, "2020-01-01", "2020-06-30", cache, **o)
    first, key = get()
    marks = lambda: {k: os.stat(f"{cache}/{k}/_SUCCESS").st_mtime_ns for k in os.listdir(cache)}
    made = marks()
    again, same = get()
    assert same == key and marks() == made and sorted(map(repr, again.collect())) == sorted(map(repr, first.collect()))
    assert get(late_days=8)[1] != key and len(marks()) == 2
    provider.write_provider_files(bars.where("ticker <> 'S0' or date < '2020-05-01'"), folder)
    changed, other = get()
    assert other != key and len(marks()) == 3 and changed.where("ticker = 'S0'").count() < first.where("ticker = 'S0'").count()


def test_bars_are_written_once(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables")
    a, b = panels.lineitem_panel(spark, sf), panels.lineitem_panel(spark, sf)
    assert set(a.inputFiles()) == set(b.inputFiles()) and a.count() == b.count() > 0
    assert tables.file_state(spark, f"{sf}/part.parquet") != tables.file_state(spark, f"{sf}/lineitem.parquet")
