"""Statistics of ordered trade series: equity, drawdown, streaks, rolling windows."""

from __future__ import annotations

from ..plans.engine import Plan
from ..plans.scans import scan

CAPITAL, PERIODS = 10000, 252
#: What one is in a multiplicative result: a result of as much doubles the balance.
UNIT = 100000


def equity(d: str) -> str:
    """CTE ``pk``: equity from the starting capital (t = 0) on, and its running peak."""
    return f"""{scan(d, "e0", "$trades", "series_id", "pnl", {"cum": ("sum", "pnl")})},
e1 AS (SELECT series_id, trade_idx, pnl, CAST({CAPITAL} AS DOUBLE) + cum AS equity FROM e0),
{scan(d, "e2", "e1", "series_id", "pnl, equity", {"high": ("max", "equity")})},
pk AS (
  SELECT series_id, trade_idx + 1 AS t, pnl, equity, greatest(CAST({CAPITAL} AS DOUBLE), high) AS peak FROM e2
  UNION ALL SELECT DISTINCT series_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST({CAPITAL} AS DOUBLE), CAST({CAPITAL} AS DOUBLE) FROM $trades
)"""


def stats(d: str, by: str = "series_id") -> str:
    """Historical statistics for each value of ``by``, with an equity curve each. Ratios are
    per year of PERIODS trades, or of as many as there are if they are fewer."""
    keys = [k.strip() for k in by.split(",")]
    year = f"sqrt(least(CAST({PERIODS} AS DOUBLE), CAST(trades AS DOUBLE)))"
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return f"""WITH {scan(d, "p0", "$trades", by, "pnl", {"n": ("sum", "1"), "cum": ("sum", "pnl")})},
p1 AS (SELECT {by}, trade_idx, pnl, n, CAST({CAPITAL} AS DOUBLE) + cum AS equity, CASE WHEN pnl < 0 THEN 0 ELSE n END AS calm FROM p0),
{scan(d, "p2", "p1", by, "pnl, n, equity", {"high": ("max", "equity"), "calm_until": ("max", "calm")})},
pk AS (SELECT {by}, equity, greatest(CAST({CAPITAL} AS DOUBLE), high) AS peak, CASE WHEN pnl < 0 THEN n - calm_until ELSE 0 END AS streak FROM p2),
dd AS (SELECT {by}, max(peak - equity) AS dollars, max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE CAST(0 AS DOUBLE) END) AS share, max(streak) AS streak FROM pk GROUP BY {by}),
ag AS (
  SELECT {by}, count(*) AS trades, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) AS losses,
    coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0) AS profit, coalesce(-sum(CASE WHEN pnl < 0 THEN pnl END), 0) AS loss,
    avg(pnl) AS mean, coalesce(stddev_samp(pnl), 0) AS std, sqrt(coalesce(avg(CASE WHEN pnl < 0 THEN pnl * pnl END), 0)) AS down, sum(pnl) AS net
  FROM $trades GROUP BY {by}
), r AS (SELECT *, CASE WHEN wins > 0 THEN profit / wins ELSE 0 END AS avg_win, CASE WHEN losses > 0 THEN loss / losses ELSE 0 END AS avg_loss FROM ag)
SELECT {", ".join("r." + k for k in keys)}, CAST(trades AS BIGINT) AS total_trades, round(CAST(100 AS DOUBLE) * wins / trades, 6) AS win_rate,
  round(CASE WHEN loss > 0 THEN profit / loss WHEN profit > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0 END, 6) AS profit_factor,
  round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss, round(mean, 6) AS expectancy,
  round(CASE WHEN std > 0 THEN mean / std * {year} ELSE 0 END, 6) AS sharpe,
  round(CASE WHEN down > 0 THEN mean / down * {year} ELSE 0 END, 6) AS sortino,
  CAST(streak AS BIGINT) AS max_consecutive_losses,
  round(CASE WHEN avg_win > 0 AND avg_loss > 0 THEN greatest(CAST(0 AS DOUBLE), CAST(wins AS DOUBLE) / trades - (1 - CAST(wins AS DOUBLE) / trades) / (avg_win / avg_loss)) ELSE 0 END, 6) AS kelly,
  round(CASE WHEN dollars > 0 THEN net / dollars ELSE 0 END, 6) AS recovery_factor, round(share, 6) AS max_drawdown
FROM r JOIN dd ON {same("r", "dd")}"""


def periods(d: str) -> str:
    """CTE ``periods`` over ``pk``: drawdowns, from the first point under the peak to the one
    that regains it. Points under it belong to the last point that was not."""
    return f"""u0 AS (SELECT series_id, t AS trade_idx, equity, peak, CASE WHEN equity < peak THEN 1 ELSE 0 END AS under, CASE WHEN equity < peak THEN -1 ELSE t END AS top FROM pk),
{scan(d, "u1", "u0", "series_id", "equity, peak, under", {"since": ("max", "top")})},
ul AS (SELECT series_id, max(trade_idx) AS last_t FROM u0 GROUP BY series_id),
up AS (SELECT series_id, since, min(trade_idx) AS start_t, max(trade_idx) AS until_t, max((peak - equity) / peak) AS depth FROM u1 WHERE under = 1 GROUP BY series_id, since),
periods AS (SELECT up.series_id, start_t, CASE WHEN until_t = last_t THEN until_t ELSE until_t + 1 END AS end_t, depth, CASE WHEN until_t = last_t THEN 0 ELSE 1 END AS recovered, last_t FROM up JOIN ul ON ul.series_id = up.series_id)"""


def _growth(d: str) -> str:
    """A product, from sums of logarithms, signs and zeros."""
    terms = {"l": ("sum", "CASE WHEN f <> 0 THEN ln(abs(CASE WHEN f <> 0 THEN f ELSE 1 END)) ELSE 0 END"), "minus": ("sum", "CASE WHEN f < 0 THEN 1 ELSE 0 END"), "nothing": ("sum", "CASE WHEN f = 0 THEN 1 ELSE 0 END")}
    return f"""WITH f AS (SELECT series_id, trade_idx, 1 + pnl / CAST({UNIT} AS DOUBLE) AS f FROM $trades), {scan(d, "g", "f", "series_id", "f", terms)}
SELECT series_id, trade_idx + 1 AS t, round(CASE WHEN nothing > 0 THEN 0 WHEN minus % 2 = 1 THEN -{CAPITAL} * exp(l) ELSE {CAPITAL} * exp(l) END, 4) AS equity FROM g"""


WINDOW, THRESHOLD = 20, 50
#: Trades before the last one of the worst window.
SPAN = 9
#: Rows of a block of the variance recursion, and blocks back to which a weight is above 0: 0.9^7168 is 0 in a double.
BLOCK, BLOCKS = 512, 15

#: CTE ``sg``: whether the last pairs of neighbours before each trade correlate.
AUTOCORRELATED = """sp0 AS (SELECT series_id, trade_idx, pnl AS y, lag(pnl) OVER (PARTITION BY series_id ORDER BY trade_idx) AS x FROM $trades),
sm0 AS (SELECT series_id, trade_idx, count(x) OVER w AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * x) OVER w AS sxx, sum(y * y) OVER w AS syy, sum(x * y) OVER w AS sxy FROM sp0 WINDOW w AS (PARTITION BY series_id ORDER BY trade_idx ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)),
sr0 AS (SELECT series_id, trade_idx, CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) ELSE 0 END AS rho FROM sm0),
sg AS (SELECT series_id, trade_idx, CASE WHEN trade_idx >= 19 AND abs(rho) >= CAST(0.35 AS DOUBLE) THEN 'clustered' ELSE 'dispersed' END AS segment FROM sr0)"""

PLANS = {
    "historical_stats": Plan(stats),
    "historical_stats_by_regime": Plan(lambda d: stats(d, "series_id, regime"), {"trades": "single"}),
    "preview_stats": Plan(stats),  # the same without a multiplier, which no plan has
    "equity_curve": Plan(lambda d: f"WITH {equity(d)} SELECT series_id, t, round(equity, 4) AS equity FROM pk"),
    "running_drawdown": Plan(lambda d: f"WITH {equity(d)} SELECT series_id, t, round(peak, 4) AS peak, round(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END, 8) AS drawdown, round(least(CAST(1 AS DOUBLE), (peak - equity) / greatest(peak, CAST('1e-8' AS DOUBLE))), 8) AS capped FROM pk"),
    "equity_curve_multiplicative": Plan(_growth),
    "loss_streaks": Plan("WITH x AS (SELECT series_id, trade_idx, pnl, trade_idx - row_number() OVER (PARTITION BY series_id, CASE WHEN pnl < 0 THEN 1 ELSE 0 END ORDER BY trade_idx) AS island FROM $trades) SELECT series_id, min(trade_idx) AS first_idx, count(*) AS length, round(sum(pnl), 4) AS pnl FROM x WHERE pnl < 0 GROUP BY series_id, island"),
    "rolling_win_rate": Plan(f"WITH w AS (SELECT series_id, trade_idx, avg(CASE WHEN pnl > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) OVER (PARTITION BY series_id ORDER BY trade_idx ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS v FROM $trades) SELECT series_id, trade_idx, round(CASE WHEN trade_idx >= {WINDOW} THEN v ELSE 0 END, 6) AS win_rate FROM w"),
    "auto_regime": Plan(f"""WITH w AS (SELECT series_id, trade_idx, avg(CASE WHEN pnl > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) OVER (PARTITION BY series_id ORDER BY trade_idx ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS v FROM $trades),
s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v, trade_idx) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM w WHERE trade_idx >= {WINDOW}),
c AS (SELECT series_id, v AS cutoff FROM s WHERE r = least(n - 1, CAST(floor(n * (CAST({THRESHOLD} AS DOUBLE) / 100)) AS BIGINT)))
SELECT w.series_id, trade_idx, CASE WHEN trade_idx >= {WINDOW} AND v >= coalesce(cutoff, 0) THEN 'Clustered' ELSE 'Dispersed' END AS regime FROM w LEFT JOIN c ON w.series_id = c.series_id"""),
    "regime_segments": Plan(f"WITH {AUTOCORRELATED} SELECT series_id, trade_idx, segment FROM sg"),
    "drawdown_periods": Plan(lambda d: f"WITH {equity(d)}, {periods(d)} SELECT series_id, start_t, end_t, round(depth, 8) AS depth, end_t - start_t AS duration, recovered FROM periods"),
    "time_under_water": Plan(lambda d: f"WITH {equity(d)}, {periods(d)}, u AS (SELECT series_id, max(end_t - start_t) AS longest, avg(CASE WHEN recovered = 1 THEN CAST(end_t - start_t AS DOUBLE) END) AS mean, max(CASE WHEN recovered = 0 THEN end_t - start_t ELSE 0 END) AS now, CAST(sum(end_t - start_t) AS DOUBLE) / greatest(1, max(last_t)) AS share FROM periods GROUP BY series_id) SELECT i.series_id, coalesce(longest, 0) AS max_duration, round(coalesce(mean, 0), 6) AS avg_duration, coalesce(now, 0) AS current_duration, round(coalesce(share, 0), 8) AS share_under FROM (SELECT DISTINCT series_id FROM $trades) i LEFT JOIN u ON u.series_id = i.series_id"),
    "worst_window": Plan(f"WITH w AS (SELECT series_id, trade_idx, sum(pnl) OVER (PARTITION BY series_id ORDER BY trade_idx ROWS BETWEEN {SPAN} PRECEDING AND CURRENT ROW) AS s FROM $trades), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(s, 6), trade_idx) AS n FROM w WHERE trade_idx >= {SPAN}) SELECT i.series_id, trade_idx - {SPAN} AS start_idx, round(coalesce(s, 0), 4) AS pnl FROM (SELECT DISTINCT series_id FROM $trades) i LEFT JOIN r ON r.series_id = i.series_id AND r.n = 1"),
    "garch_variance": Plan(f"""WITH m AS (SELECT series_id, avg(pnl) AS mu, var_samp(pnl) AS v FROM $trades GROUP BY series_id),
e AS (SELECT t.series_id, trade_idx, trade_idx % {BLOCK} AS p, trade_idx - trade_idx % {BLOCK} AS b0, v, CAST(0.02 AS DOUBLE) * v + CAST(0.08 AS DOUBLE) * (pnl - mu) * (pnl - mu) AS c FROM $trades t JOIN m ON t.series_id = m.series_id),
bl AS (SELECT series_id, b0, sum(power(CAST(0.9 AS DOUBLE), {BLOCK} - 1 - p) * c) AS s FROM e GROUP BY series_id, b0),
k AS (SELECT CAST(column0 AS BIGINT) AS k FROM (VALUES {", ".join(f"({i})" for i in range(1, BLOCKS + 1))}) AS x(column0)),
lk AS (SELECT bl.series_id, b0, b0 - {BLOCK} * k AS b1 FROM bl CROSS JOIN k),
ca AS (SELECT lk.series_id, lk.b0, sum(power(CAST(0.9 AS DOUBLE), lk.b0 - {BLOCK} - lk.b1) * s) AS h FROM lk JOIN bl ON bl.series_id = lk.series_id AND bl.b0 = lk.b1 GROUP BY lk.series_id, lk.b0),
w AS (SELECT series_id, trade_idx, p, b0, v, coalesce(sum(power(CAST(0.9 AS DOUBLE), -p) * c) OVER (PARTITION BY series_id, b0 ORDER BY trade_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e)
SELECT w.series_id, trade_idx, round(power(CAST(0.9 AS DOUBLE), trade_idx) * v + power(CAST(0.9 AS DOUBLE), p) * coalesce(h, 0) + power(CAST(0.9 AS DOUBLE), p - 1) * s, 4) AS variance FROM w LEFT JOIN ca ON ca.series_id = w.series_id AND ca.b0 = w.b0"""),
}
