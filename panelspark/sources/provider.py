"""A data source over a provider's files: spark.read.format("provider_ohlcv").load(folder).

A series is a CSV file `<TICKER>.csv`, or a folder `ticker=<TICKER>` of such files, with the columns Date, Open, High,
Low, Close, Volume and, if the provider gives them, Adj Close and Stock Splits. Each series is a partition of the scan, read
where its task runs, through any file system that pyarrow knows (local, HDFS, S3). What fails does not end the scan: a
series that cannot be read, holds no prices or begins too late is a row with a failure and no date.

Options: tickers (comma-separated canonical names: only these are read, and those without a file fail), start and end
(dates, both included), late_days (7: a series whose first date is later than start by more than this fails).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .panels import BLOCKED_TICKERS, TICKER_ALIASES
from .tables import written

FORMAT = "provider_ohlcv"
SCHEMA = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume long, split_factor double, failure string"
PRICES = {"Open": "open", "High": "high", "Low": "low", "Close": "close"}
_ARROW = pa.schema([("date", pa.date32()), ("ticker", pa.string()), *((c, pa.float64()) for c in (*PRICES.values(), "adj_close")), ("volume", pa.int64()), ("split_factor", pa.float64()), ("failure", pa.string())])


def canonical_name(given: str) -> str:
    name = given.strip().upper()
    return TICKER_ALIASES.get(name, name)


def provider_name(ticker: str) -> str:
    name = ticker.strip().upper()
    return next((k for k, v in TICKER_ALIASES.items() if v == name), name.replace(".", "-"))


def series_of(path: str) -> str | None:
    """The provider's name of the series a file belongs to; None for other files."""
    folder, _, file = path.rpartition("/")
    if not file.endswith(".csv") or file.startswith((".", "_")):
        return None
    key, _, value = folder.rpartition("/")[2].partition("=")
    return unquote(value) if key == "ticker" and value else file[: -len(".csv")]


@dataclass
class Series(InputPartition):
    ticker: str
    paths: tuple[str, ...]


class ProviderReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options.get("path")
        if not self.uri:
            raise ValueError("the folder of the provider's files is missing")
        if "://" not in self.uri:
            self.uri = "file:///" + self.uri.removeprefix("file:").lstrip("/")
        self.tickers = sorted({canonical_name(t) for t in options["tickers"].split(",") if t.strip()}) if "tickers" in options else None
        day = lambda name: date.fromisoformat(options[name]) if name in options else None
        self.start, self.end, self.late = day("start"), day("end"), int(options.get("late_days", 7))

    def partitions(self) -> list[Series]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        found: dict[str, list[str]] = {}
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            name = series_of(info.path) if info.is_file else None
            if name:
                found.setdefault(canonical_name(name), []).append(info.path)
        wanted = self.tickers if self.tickers is not None else sorted(found)
        return [Series(t, tuple(sorted(found.get(t, ())))) for t in wanted]

    def read(self, partition: Series | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition of a scan that has none
            return
        try:
            rows = self.series(partition)
        except (pa.ArrowException, OSError, ValueError, KeyError) as error:
            rows = " ".join(str(error).split())[:200] or type(error).__name__
        if isinstance(rows, str):
            row = dict.fromkeys(_ARROW.names) | {"ticker": partition.ticker, "failure": rows}
            rows = pa.Table.from_pylist([row], _ARROW)
        yield from rows.to_batches()

    def series(self, partition: Series) -> pa.Table | str:
        if partition.ticker in BLOCKED_TICKERS:
            return "blocked"
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        # a date may carry a time and its zone: the day is that of the exchange's clock
        kinds = {"Date": pa.string(), "Volume": pa.float64(), "Adj Close": pa.float64(), "Stock Splits": pa.float64()} | dict.fromkeys(PRICES, pa.float64())
        parts = []
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                parts.append(pacsv.read_csv(f, convert_options=pacsv.ConvertOptions(column_types=kinds, strings_can_be_null=True)))
        if not parts:
            return "no file"
        given = pa.concat_tables(parts, promote_options="default")
        missing = [c for c in ("Date", *PRICES, "Volume") if c not in given.column_names]
        if missing:
            return f"missing columns: {', '.join(missing)}"
        frame = given.to_pandas()
        frame["Date"] = [date.fromisoformat(str(d)[:10]) for d in frame["Date"]]
        frame = frame.dropna(how="all", subset=list(PRICES))
        inside = [(self.start is None or d >= self.start) and (self.end is None or d <= self.end) for d in frame["Date"]]
        frame = frame[np.array(inside, bool)].sort_values("Date", kind="stable")
        if not frame["Close"].notna().any():
            return "no prices"
        if self.start and frame["Date"].iloc[0] > self.start + timedelta(days=self.late):
            return f"begins on {frame['Date'].iloc[0]}"
        n = len(frame)
        splits = frame["Stock Splits"].fillna(0.0) if "Stock Splits" in frame else None
        column = lambda c: pa.array(frame[c], pa.float64(), from_pandas=True)
        return pa.Table.from_arrays(
            [
                pa.array(frame["Date"], pa.date32()), pa.array([partition.ticker] * n, pa.string()), *(column(c) for c in PRICES), column("Adj Close" if "Adj Close" in frame else "Close"),
                pa.array(frame["Volume"].fillna(0.0).astype("int64")), pa.array([1.0] * n if splits is None else splits.where(splits > 0, 1.0)), pa.nulls(n, pa.string()),
            ],
            schema=_ARROW,
        )


class ProviderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProviderReader:
        return ProviderReader(self.options)


def read_provider(spark: SparkSession, folder: str, tickers: list[str] | None = None, start: str | None = None, end: str | None = None, late_days: int = 7) -> DataFrame:
    """All rows of the provider's files, failures included (see the module)."""
    spark.dataSource.register(ProviderSource)
    options = {"tickers": ",".join(tickers) if tickers is not None else None, "start": start, "end": end, "late_days": late_days}
    return spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items() if v is not None}).load(folder)


def download(spark: SparkSession, folder: str, tickers: list[str], start: str, end: str, late_days: int = 7, most_failures: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): the bars of all series that could be read, with split factors, and (ticker, failure) of the
    others; raises if more of the tickers failed than that share, or all. Files are read once."""
    rows = written(read_provider(spark, folder, tickers, start, end, late_days))
    failures = rows.where("failure is not null").select("ticker", "failure")
    failed, wanted = failures.count(), len({canonical_name(t) for t in tickers})
    if not wanted or failed == wanted or failed / wanted > most_failures:
        some = ", ".join(f"{r['ticker']} ({r['failure']})" for r in failures.orderBy("ticker").limit(10).collect())
        raise RuntimeError(f"{failed} of {wanted} series failed: {some}")
    return rows.where("failure is null").drop("failure"), failures


def write_provider_files(bars: DataFrame, folder: str) -> None:
    """bars (date, ticker, open, high, low, close, adj_close, volume, split_factor) as a provider's files, a folder a
    ticker: what read_provider() takes."""
    bars.repartition("ticker").sortWithinPartitions("ticker", "date").select(
        "ticker", F.col("date").alias("Date"), *(F.col(c).alias(k) for k, c in PRICES.items()),
        F.col("adj_close").alias("Adj Close"), F.col("volume").alias("Volume"), F.col("split_factor").alias("Stock Splits"),
    ).write.mode("overwrite").partitionBy("ticker").option("header", True).csv(folder)
