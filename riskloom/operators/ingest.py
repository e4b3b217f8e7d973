"""Import of trade tables: lenient parsing, filtering, roles and sleeves."""

from __future__ import annotations

from ..plans.engine import SPARK, Plan

def _parsed(dialect: str) -> str:
    if dialect == "spark":
        clean = r"regexp_replace(regexp_replace(profit, '[$,\\s]', ''), '^\\((.*)\\)$', '-$1')".replace("$", "$$")
        number = f"CASE WHEN {clean} RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$$' THEN CAST({clean} AS DOUBLE) END"
    else:
        clean = r"regexp_replace(regexp_replace(profit, '[$,\s]', '', 'g'), '^\((.*)\)$', '-\1')".replace("$", "$$")
        number = f"CASE WHEN regexp_matches({clean}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$$') THEN CAST({clean} AS DOUBLE) END"
    return f"p AS (SELECT event_id, instrument, in_regime, CASE WHEN profit IS NULL OR profit = '' THEN NULL WHEN {clean} = '' THEN CAST(0 AS DOUBLE) ELSE {number} END AS pnl FROM $raw)"


FLAG = "CASE WHEN lower(trim(in_regime)) IN ('true', '1', 'yes', 'y') THEN 1 WHEN lower(trim(in_regime)) IN ('false', '0', 'no', 'n') THEN 0 END"
RAW = {"raw": "raw"}


def _numeric(d: str) -> str:
    return _parsed(d) + ", f AS (SELECT pnl FROM p ORDER BY event_id LIMIT 50)"


def _times(d: str) -> str:
    """ISO text, milliseconds since 1970, or American dates; null for anything else."""
    if d == SPARK:
        american = ", ".join(f"try_to_timestamp(x, '{f}')" for f in ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy"))
        millis = "CASE WHEN try_cast(x AS BIGINT) BETWEEN -9223372036854775 AND 9223372036854775 THEN try_cast(x AS BIGINT) END"  # else no timestamp holds it
        value = f"CASE WHEN x RLIKE '^-?[0-9]+$$' THEN timestamp_millis({millis}) WHEN x LIKE '%/%' THEN coalesce({american}) ELSE try_cast(x AS TIMESTAMP) END"
        text = f"ltrim('+', date_format({value}, 'yyyy-MM-dd HH:mm:ss'))"  # years of five digits get a sign
    else:
        american = "try_strptime(x, ['%m/%d/%Y %H:%M:%S', '%m/%d/%Y %H:%M', '%m/%d/%Y'])"
        value = f"CASE WHEN regexp_matches(x, '^-?[0-9]+$$') THEN make_timestamp(TRY_CAST(x AS BIGINT) * 1000) WHEN x LIKE '%/%' THEN {american} ELSE TRY_CAST(rtrim(x, 'Z') AS TIMESTAMP) END"
        text = f"strftime({value}, '%Y-%m-%d %H:%M:%S')"
    return f"WITH c AS (SELECT event_id, trim(raw) AS x FROM $times) SELECT event_id, {text} AS ts FROM c"


PLANS = {
    "parse_timestamp": Plan(_times, {"times": "times"}),
    "parse_financial": Plan(lambda d: f"WITH {_parsed(d)} SELECT event_id, pnl FROM p", RAW),
    "row_filter": Plan(lambda d: f"WITH {_parsed(d)} SELECT row_number() OVER (PARTITION BY instrument ORDER BY event_id) - 1 AS trade_idx, instrument, event_id, pnl FROM p WHERE pnl IS NOT NULL".replace("row_number() OVER (PARTITION BY instrument ORDER BY event_id) - 1", "CAST(row_number() OVER (PARTITION BY instrument ORDER BY event_id) - 1 AS BIGINT)"), RAW),
    "parse_boolean": Plan(f"WITH b AS (SELECT event_id, {FLAG} AS flag FROM $raw) SELECT event_id, coalesce(flag, -1) AS flag, CASE WHEN coalesce(flag, 0) = 1 THEN 'In regime' ELSE 'Out of regime' END AS label FROM b", RAW),
    "instrument_sleeves": Plan(lambda d: f"WITH {_parsed(d)}, c AS (SELECT instrument, count(*) AS n FROM p WHERE pnl IS NOT NULL AND trim(instrument) <> '' GROUP BY instrument) SELECT instrument, n, row_number() OVER (ORDER BY instrument) AS position, round(CAST(1 AS DOUBLE) / count(*) OVER (), 8) AS weight FROM c".replace("row_number() OVER (ORDER BY instrument)", "CAST(row_number() OVER (ORDER BY instrument) AS BIGINT)"), RAW),
    "detect_numeric": Plan(lambda d: f"WITH {_numeric(d)} SELECT 'profit' AS name, CASE WHEN avg(CASE WHEN pnl IS NULL THEN CAST(0 AS DOUBLE) ELSE 1 END) >= CAST('0.7' AS DOUBLE) THEN 1 ELSE 0 END AS is_numeric FROM f", RAW),
    "sleeve_extract": Plan(lambda d: f"WITH {_parsed(d)} SELECT instrument AS series_id, CAST(row_number() OVER (PARTITION BY instrument ORDER BY event_id) - 1 AS BIGINT) AS trade_idx, pnl, CASE WHEN coalesce({FLAG}, 0) = 1 THEN 'in' ELSE 'out' END AS segment FROM p WHERE pnl IS NOT NULL", RAW),
    "horizon": Plan("WITH c AS (SELECT series_id, count(*) AS n FROM $trades GROUP BY series_id) SELECT max(n) AS horizon FROM c"),
    "normalized_weights": Plan("WITH c AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS w FROM $trades GROUP BY series_id) SELECT series_id, round(CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () ELSE CAST(1 AS DOUBLE) / count(*) OVER () END, 10) AS weight FROM c"),
    "return_series": Plan("WITH t AS (SELECT series_id, trade_idx, pnl FROM $trades) SELECT series_id, trade_idx, round(1 + pnl / 100, 8) AS pct, round(1 + pnl, 6) AS mult, round(pnl, 6) AS absolute, round(pnl * 2 - CAST('2.5' AS DOUBLE), 6) AS scaled_net FROM t"),
    "slippage": Plan("WITH v AS (SELECT series_id, coalesce(stddev_samp(pnl), 0) AS vol FROM $trades GROUP BY series_id), s AS (SELECT t.series_id, trade_idx, pnl, greatest(vol, CAST('1e-12' AS DOUBLE)) AS s, vol FROM $trades t JOIN v ON t.series_id = v.series_id) SELECT series_id, trade_idx, CAST(0 AS DOUBLE) AS none, CAST('5.25' AS DOUBLE) AS fixed, round(greatest(CAST(0 AS DOUBLE), CAST('0.1' AS DOUBLE) * s * sqrt(CAST(4 AS DOUBLE)) * (abs(pnl) / (abs(pnl) + s))), 8) AS sqrt_impact, round(CASE WHEN vol > 0 THEN CAST('2.5' AS DOUBLE) * (1 + abs(pnl) / vol * CAST('0.1' AS DOUBLE)) ELSE CAST('2.5' AS DOUBLE) END, 8) AS linear_impact FROM s"),
}
