"""Whole flows: research inference, backtest and ingest, each one lazy plan up to its small results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import quality, validation
from panelspark.operators.execution import BacktestResult, run_backtests
from panelspark.operators.features import compute_features, forward_return
from panelspark.operators.inference import CONFIRMATORY, Registry, adjust_family, daily_ic, ic_summary, quantile_spread, spread_summary
from panelspark.operators.metrics import performance, tearsheet
from panelspark.operators.resampling import permutation_test
from panelspark.operators.signals import CombinedSignal, get_signal
from panelspark.sources.calendar import trading_sessions
from panelspark.sources.config import ExperimentConfig
from panelspark.sources.panels import ingest, load_ohlcv, with_session_idx, write_metadata, write_panel
from panelspark.sources.provider import download
from panelspark.sources.tables import cached, file_state, settings_key


def ingest_panel(spark: SparkSession, raw: DataFrame, requested: list[str], start: str, end: str, path: str) -> quality.QualityReport:
    """Raw provider rows to a clean panel at path, and the report, which is observed while the panel is written."""

    def write(panel: DataFrame) -> DataFrame:
        write_panel(panel, path)
        return spark.read.schema(panel.schema).parquet(path)

    _, report = quality.clean_to(ingest(raw, requested, start), trading_sessions(spark, start, end), write)
    write_metadata(spark, path, report.terminated)
    return report


def provided_panel(spark: SparkSession, folder: str, tickers: list[str], start: str, end: str, cache: str, **options) -> tuple[DataFrame, str]:
    """(the clean panel of a provider's files, its key): made and written in the folder cache where it does not hold the
    panel of these files, as they are now, and these settings; read from there else."""
    key = f"{file_state(spark, folder)}-{settings_key({'tickers': sorted(tickers), 'start': start, 'end': end} | options)}"

    def make() -> DataFrame:
        rows, _ = download(spark, folder, tickers, start, end, **options)
        return quality.clean(rows, trading_sessions(spark, start, end))[0]

    return cached(spark, cache, key, make), key


def signal_panel(panel: DataFrame, **options) -> DataFrame:
    """The panel with features and all five signals."""
    return CombinedSignal().compute(compute_features(panel, **options))


def confirmatory_inference(spark: SparkSession, panel: DataFrame, permutations: int = 1000, alpha: float = 0.05) -> dict:
    """Each confirmatory hypothesis' IC, spread and p-values, and the family's correction."""
    df, registry, out = signal_panel(panel), Registry(), {}
    for h in CONFIRMATORY:
        signal = get_signal(h.signal).name
        ic, summary = registry.evaluate(h.id, df, signal)
        summary["spread"] = spread_summary(quantile_spread(df, signal, h.target))
        summary["perm_p"] = permutation_test(df, signal, h.target, permutations)[1]
        out[h.id] = summary
    out["family"] = adjust_family(spark, {h.id: out[h.id]["hac_p"] for h in CONFIRMATORY}, alpha)
    return out


def horizon_profile(df: DataFrame, signals: list[str], price: str = "adj_close", horizons=(1, 5, 10, 20, 40, 60)) -> DataFrame:
    """(signal, horizon, date, ic, n) of all pairs in one plan: rows are stacked by signal and horizon, then ranked."""
    df = df.withColumns({f"__f{h}": forward_return(price, h) for h in horizons})
    stacked = F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(h).alias("horizon"), F.col(s).alias("x"), F.col(f"__f{h}").alias("y")) for s in signals for h in horizons))
    rows = df.select("date", "ticker", F.explode(stacked).alias("p")).select("date", "ticker", "p.*")
    return daily_ic(rows, "x", "y", keys=("signal", "horizon"))


def backtest(spark: SparkSession, config: ExperimentConfig, panel: DataFrame | None = None) -> tuple[BacktestResult, DataFrame]:
    """A configured run and its metrics. The date filter comes before features, and reaches the scan."""
    df = panel if panel is not None else load_ohlcv(spark, config["data.panel"])
    df = df.where(F.col("date").between(F.lit(config["data.start_date"]).cast("date"), F.lit(config["data.end_date"]).cast("date")))
    df = df if "session_idx" in df.columns else with_session_idx(df)
    signal = config.signal()
    weights = config.constructor().construct(signal.compute(compute_features(df)), signal.name)
    result = run_backtests(weights, config["data.price"], config.costs(), config["backtest.initial_cash"], config["backtest.rebalance_frequency"])
    return result, performance(result.snapshots)


def report(metrics: DataFrame, title: str) -> str:
    """Markdown of a one-run metrics table."""
    row = metrics.first()
    return tearsheet(row.asDict(), title) if row else f"# {title}\n\nno runs"


__all__ = ["backtest", "confirmatory_inference", "horizon_profile", "ic_summary", "ingest_panel", "report", "signal_panel", "validation"]
