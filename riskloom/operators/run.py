"""A run from trades to its export: history, paths, reports, and files that are whole or unmarked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import trades as sources
from ..sources.shared import shared
from . import performance, reports
from .kernels import Config
from .models import simulate_history

#: The mark that a finished export carries, written after all else.
COMPLETE = "complete"


@dataclass(frozen=True)
class Run:
    """Results of a run, each a DataFrame: ``paths`` and ``trades`` are written once."""

    model: str
    config: Config
    trades: DataFrame
    paths: DataFrame
    reports: dict[str, DataFrame]

    def export(self, path: str) -> None:
        """Writes the sections as CSV folders under ``path``, which must not exist: ``metadata``,
        ``paths``, ``history`` and ``regimes``; then COMPLETE. A reader that waits for the mark
        never sees half of a run."""
        sections = {"metadata": "csv_export_metadata", "paths": "csv_export_paths", "history": "historical_stats", "regimes": "historical_stats_by_regime"}
        for name, report in sections.items():
            sources.csv_export(self.reports[report], f"{path}/{name}")
        self.trades.sparkSession.range(1).select(F.lit("done").alias("state")).coalesce(1).write.csv(f"{path}/{COMPLETE}", header=True)


def settings(model: str, config: Config) -> reports.Settings:
    return reports.Settings(model=model, seed=config.seed, capital=config.capital, ruin_percent=config.ruin_percent, multiplicative=config.multiplicative)


def run(trades: DataFrame, model: str = "bootstrap", config: Config | None = None) -> Run:
    """Simulates each series of ``trades(series_id, trade_idx, pnl, regime)`` under ``model``
    and works out the reports over its history and its paths."""
    config = config or Config()
    spark = trades.sparkSession
    trades = shared(trades.select("series_id", "trade_idx", "pnl", "regime"))
    paths = shared(simulate_history(trades, model, config))
    found = {name: plan.run(spark, paths=paths) for name, plan in reports.plans(settings(model, config)).items() if set(plan.inputs) == {"paths"}}
    past = {name: performance.PLANS[name].run(spark, trades=trades) for name in ("historical_stats", "historical_stats_by_regime")}
    return Run(model, config, trades, paths, found | past)


def run_file(spark: SparkSession, path: str, model: str = "bootstrap", config: Config | None = None, roles: sources.Roles | None = None) -> Run:
    """A run over CSV files: their rows in order, roles found by their headers unless given,
    a series for each sleeve that is on."""
    table = sources.csv_scan(spark, path)
    return run(sources.trades_of(table, roles or sources.roles_of(table)), model, config)
