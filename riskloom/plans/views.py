"""Views of the test tables as trade series; the same text on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _events(series: str, limit: str = "") -> str:
    return f"""
SELECT {series} AS series_id, CAST(row_number() OVER (PARTITION BY {series} ORDER BY event_id) - 1 AS BIGINT) AS trade_idx, ts,
  value - CAST(50 AS DOUBLE) AS pnl, event_type AS regime,
  (CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) - CAST(50 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS benchmark
FROM events{limit}"""


#: A strategy for each of some groups of users, whose regime is the kind of event.
GROUP = "concat('users ', CAST(user_id % 6 AS STRING))"
#: Inputs by name: one row a trade, in order of trade_idx within series_id.
VIEWS = {
    "trades": _events("event_type"),
    "single": _events(GROUP),
    "losses": f"SELECT series_id, trade_idx, ts, -pnl AS pnl, regime, benchmark FROM ({_events(GROUP)})",
    "days": "SELECT o_orderpriority AS series_id, o_orderkey AS trade_idx, o_orderdate AS ts, o_totalprice - CAST(250000 AS DOUBLE) AS pnl, o_orderstatus AS regime FROM orders",
    "weights": "SELECT event_type AS series_id, CAST(length(event_type) AS DOUBLE) AS weight FROM events GROUP BY event_type",
    "times": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN CAST(event_id * 86400001 AS STRING) WHEN 1 THEN concat('2024-0', CAST(event_id % 9 + 1 AS STRING), '-15T09:30:00Z') WHEN 2 THEN concat(CAST(event_id % 12 + 1 AS STRING), '/', CAST(event_id % 28 + 1 AS STRING), '/2024 9:', CAST(event_id % 50 + 10 AS STRING), ':05') WHEN 3 THEN concat(' ', CAST(event_id % 12 + 1 AS STRING), '/', CAST(event_id % 28 + 1 AS STRING), '/2023 ') WHEN 4 THEN '' WHEN 5 THEN 'yesterday' ELSE concat('2023-11-', CAST(event_id % 20 + 10 AS STRING), ' 23:59') END AS raw FROM events",
    "raw": "SELECT event_id, event_type AS instrument, CASE WHEN event_id % 4 = 0 THEN concat('($', CAST(CAST(floor(value * 100) AS BIGINT) AS STRING), ')') WHEN event_id % 4 = 1 THEN concat(' $1,', CAST(CAST(floor(value) AS BIGINT) + 100 AS STRING)) WHEN event_id % 7 = 2 THEN '' WHEN event_id % 7 = 3 THEN 'n/a' ELSE CAST(CAST(floor(value * 10) AS BIGINT) AS STRING) END AS profit, CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'n' WHEN 2 THEN ' TRUE ' WHEN 3 THEN '0' ELSE 'maybe' END AS in_regime FROM events",
}
TABLES = ("events", "orders")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    sql = VIEWS[name]
    used = {t: df for t, df in tables.items() if f"FROM {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **used)
