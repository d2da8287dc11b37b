"""The provider's files as a data source: what is read, what fails, and that failures end nothing."""

from datetime import date

import pytest

from panelspark.operators.quality import split_adjusted_volume
from panelspark.sources import provider

HEAD = "Date,Open,High,Low,Close,Adj Close,Volume,Dividends,Stock Splits\n"


def files(folder):
    day = lambda d, p="10.0", v="100", s="0.0": f"2020-01-{d:02d} 00:00:00-05:00,{p},11,9,{p},{p},{v},0.0,{s}\n"
    good = HEAD + "".join(day(d) for d in (2, 3, 6, 7))
    (folder / "AAPL.csv").write_text(good)
    (folder / "META.csv").write_text(HEAD + day(2) + day(3, s="2.0") + day(6, v="") + "2020-01-07,,,,,,5,0,0\n" + day(8))
    (folder / "BRK-B.csv").write_text(good.replace(",Dividends,Stock Splits", "").replace(",0.0,0.0\n", "\n"))
    (folder / "LATE.csv").write_text(HEAD + day(20))
    (folder / "BAD.csv").write_text("Date,Open\nnot,a,table\n")
    (folder / "WORDS.csv").write_text(HEAD + "2020-01-02,ten,11,9,10,10,100,0,0\n")
    (folder / "LESS.csv").write_text("Date,Open\n2020-01-02,1.0\n")
    (folder / "EMPTY.csv").write_text(HEAD)
    (folder / "EMC.csv").write_text(good)
    (folder / "_SUCCESS").write_text("")
    (folder / "ticker=MS%20FT").mkdir()
    (folder / "ticker=MS%20FT" / "part-0.csv").write_text(HEAD + day(2))
    (folder / "ticker=MS%20FT" / "part-1.csv").write_text(HEAD + day(3))


def test_read(spark, tmp_path):
    files(tmp_path)
    df = provider.read_provider(spark, str(tmp_path), start="2020-01-01", end="2020-01-07")
    assert df.rdd.getNumPartitions() == 10  # one a series
    rows = df.collect()
    failed = {r["ticker"]: r["failure"] for r in rows if r["failure"]}
    assert sorted(failed) == ["BAD", "EMC", "EMPTY", "LATE", "LESS", "WORDS"]
    assert failed["EMC"] == "blocked" and failed["EMPTY"] == "no prices" and failed["LATE"] == "no prices" and failed["LESS"].startswith("missing columns: High")
    assert all(r["date"] is None for r in rows if r["failure"])
    got = {}
    for r in rows:
        if not r["failure"]:
            got.setdefault(r["ticker"], []).append(r)
    assert {k: len(v) for k, v in got.items()} == {"AAPL": 4, "FB": 3, "BRK.B": 4, "MS FT": 2}
    assert [(r["date"], r["volume"], r["split_factor"]) for r in got["FB"]] == [(date(2020, 1, 2), 100, 1.0), (date(2020, 1, 3), 100, 2.0), (date(2020, 1, 6), 0, 1.0)]
    assert {r["split_factor"] for r in got["BRK.B"]} == {1.0} and got["BRK.B"][0]["adj_close"] == 10.0
    late = provider.read_provider(spark, str(tmp_path), ["late", "nobody"], "2020-01-01", "2020-01-31").collect()
    assert {r["ticker"]: r["failure"] for r in late} == {"LATE": "begins on 2020-01-20", "NOBODY": "no file"}


def test_only_wanted_files_are_opened(spark, tmp_path):
    files(tmp_path)
    df = provider.read_provider(spark, str(tmp_path), ["META", "brk.b"])
    assert df.rdd.getNumPartitions() == 2 and {r["ticker"] for r in df.collect()} == {"FB", "BRK.B"}
    assert provider.read_provider(spark, str(tmp_path), []).count() == 0


def test_download(spark, tmp_path):
    files(tmp_path)
    rows, failures = provider.download(spark, str(tmp_path), ["AAPL", "FB", "LATE"], "2020-01-01", "2020-01-31", most_failures=0.4)
    assert [tuple(r) for r in failures.collect()] == [("LATE", "begins on 2020-01-20")]
    volume = {(r["ticker"], r["date"].day): r["volume_split_adjusted"] for r in split_adjusted_volume(rows).collect()}
    assert volume["FB", 2] == 200.0 and volume["FB", 3] == 100.0 and volume["AAPL", 2] == 100.0
    with pytest.raises(RuntimeError, match=r"1 of 3 series failed: LATE \(begins"):
        provider.download(spark, str(tmp_path), ["AAPL", "FB", "LATE"], "2020-01-01", "2020-01-31")
    with pytest.raises(RuntimeError, match="1 of 1"):
        provider.download(spark, str(tmp_path), ["LATE"], "2020-01-01", "2020-01-31", most_failures=1.0)


def test_what_is_written_can_be_read(spark, tmp_path):
    bars = [(date(2020, 1, d), t, 1.5 + d, 2.5 + d, 0.1 + d, 1.0 / d, 1.0 / 3 + d, 100 * d, 1.0) for t in ("A", "B#1") for d in (2, 3)]
    df = spark.createDataFrame(bars, "date date, ticker string, open double, high double, low double, close double, adj_close double, volume long, split_factor double")
    provider.write_provider_files(df, f"{tmp_path}/out")
    got = provider.read_provider(spark, f"{tmp_path}/out").drop("failure")
    assert sorted(map(tuple, got.collect())) == sorted(bars)


def test_names():
    for t in ("BRK.B", "FB", "BK", "UTX", "AAPL"):
        assert provider.canonical_name(provider.provider_name(t)) == t
    assert provider.series_of("/x/ticker=A%2FB/part-0.csv") == "A/B" and provider.series_of("/x/_a.csv") is None and provider.series_of("/x/a.txt") is None


def test_a_folder_is_needed(spark):
    with pytest.raises(Exception, match="missing|path"):
        spark.dataSource.register(provider.ProviderSource)
        spark.read.format(provider.FORMAT).load().count()
