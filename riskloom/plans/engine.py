"""Runs a declarative plan: SQL over named inputs, which are DataFrames on Spark.

A plan is text that starts with WITH and refers to its inputs as ``$name``; what the
two dialects spell differently comes from the functions below."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared

SPARK, DUCKDB = "spark", "duckdb"


def xor(dialect: str, a: str, b: str) -> str:
    return f"({a} ^ {b})" if dialect == SPARK else f"xor({a}, {b})"


def numbers(dialect: str, n: int) -> str:
    """A relation with a column ``i``: 0 to n - 1."""
    return f"(SELECT id AS i FROM range({n}))" if dialect == SPARK else f"(SELECT CAST(range AS BIGINT) AS i FROM range({n}))"


#: Columns that plans read of a table of trades; all others are left out, so none can clash.
TRADES = ("series_id", "trade_idx", "ts", "pnl", "regime", "benchmark")
#: Columns by which plans group and join, and what stands for a null there.
KEYS, NAMELESS = ("series_id", "regime"), "default"


def tidied(df: DataFrame) -> DataFrame:
    if {"series_id", "trade_idx"} <= set(df.columns):
        df = df.select(*(c for c in TRADES if c in df.columns))
    return df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit(NAMELESS)) for k in KEYS if k in df.columns})


@dataclass(frozen=True)
class Plan:
    """``sql``: text, or a function of the dialect. ``inputs``: name of each input to
    the view that the test queries bind to it. ``stages``: SQL that Spark works out and
    writes down first, each a further input of those behind it.

    Of trades a plan reads TRADES alone; a null series_id or regime is the one NAMELESS."""

    sql: str | Callable[[str], str]
    inputs: dict[str, str] = field(default_factory=lambda: {"trades": "trades"})
    stages: dict[str, str] = field(default_factory=dict)

    def text(self, dialect: str) -> str:
        return (self.sql if isinstance(self.sql, str) else self.sql(dialect)).strip()

    def run(self, spark: SparkSession, **inputs: DataFrame) -> DataFrame:
        known = {k: tidied(df) for k, df in inputs.items()}

        def run(sql: str) -> DataFrame:
            body = Template(sql).substitute({k: "{" + k + "}" for k in known})
            return spark.sql(body, **{k: df for k, df in known.items() if "{" + k + "}" in body})

        for name, sql in self.stages.items():
            known[name] = shared(run(sql))
        return run(self.text(SPARK))

    def oracle(self, views: dict[str, str]) -> str:
        body = Template(self.text(DUCKDB)).substitute({k: k for k in self.inputs})
        return "WITH " + ", ".join(f"{k} AS ({views[v]})" for k, v in self.inputs.items()) + ", " + body.removeprefix("WITH ")
