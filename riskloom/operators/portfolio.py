"""Several strategies held together: alignment, correlation, combined paths."""

from __future__ import annotations

import numpy as np

from ..plans.engine import Plan, numbers
from .performance import AUTOCORRELATED, CAPITAL, PERIODS
from .simulate import LEVEL, LOW95, PATHS, SEED, at, uniform

#: Every series on every step up to the longest: no trade is 0.
ALIGNED = """sl AS (SELECT DISTINCT series_id FROM $trades), st AS (SELECT DISTINCT trade_idx FROM $trades),
al AS (SELECT sl.series_id, st.trade_idx, coalesce(t.pnl, 0) AS pnl FROM sl CROSS JOIN st LEFT JOIN $trades t ON t.series_id = sl.series_id AND t.trade_idx = st.trade_idx)"""


def correlations(source: str, key: str = "") -> str:
    """CTEs ``mo`` and ``pr``: moments of each series and correlations of each pair, steps
    without a trade counting as 0. Only rows that are there are joined; ``key`` names
    further columns that tell groups of steps apart, with the number of steps as ``h``."""
    k = f"{key}, " if key else ""
    on = f"a.{key} = b.{key} AND " if key else ""
    by = f"a.{key}, " if key else ""
    return f"""mo AS (SELECT {k}series_id, max(h) AS h, sum(pnl) AS s, sum(pnl * pnl) AS q FROM {source} GROUP BY {k}series_id),
xy AS (SELECT {by}a.series_id AS i, b.series_id AS j, sum(a.pnl * b.pnl) AS p FROM {source} a JOIN {source} b ON {on}a.trade_idx = b.trade_idx AND a.series_id < b.series_id GROUP BY {by}a.series_id, b.series_id),
pr AS (SELECT {by}a.series_id AS i, b.series_id AS j, CASE WHEN a.h >= 2 AND a.q - a.s * a.s / a.h > CAST('1e-12' AS DOUBLE) * (1 + a.q) AND b.q - b.s * b.s / b.h > CAST('1e-12' AS DOUBLE) * (1 + b.q) THEN (coalesce(p, 0) - a.s * b.s / a.h) / sqrt(greatest(CAST('1e-300' AS DOUBLE), (a.q - a.s * a.s / a.h) * (b.q - b.s * b.s / b.h))) ELSE 0 END AS rho
  FROM mo a JOIN mo b ON {on}a.series_id < b.series_id LEFT JOIN xy ON {f"xy.{key} = a.{key} AND " if key else ""}xy.i = a.series_id AND xy.j = b.series_id)"""


#: Capital is dealt by ``weights(series_id, weight)``, made to sum to 1; equal, if they sum to nothing.
WEIGHTS = """wk AS (SELECT i.series_id, coalesce(w.weight, 0) AS weight FROM (SELECT DISTINCT series_id FROM $trades) i LEFT JOIN $weights w ON w.series_id = i.series_id),
ws AS (SELECT sum(weight) AS total, count(*) AS k FROM wk), wt AS (SELECT series_id, CASE WHEN total > 0 THEN weight / total ELSE CAST(1 AS DOUBLE) / k END AS weight FROM wk CROSS JOIN ws)"""
#: A leg starts with its share of the capital, and stays where it ends up to the longest one's end.
LEGS = f"""{WEIGHTS}, leg AS (SELECT t.series_id, trade_idx, w.weight, t.pnl, CAST({CAPITAL} AS DOUBLE) * w.weight AS capital, CAST({CAPITAL} AS DOUBLE) * w.weight + sum(pnl) OVER (PARTITION BY t.series_id ORDER BY trade_idx ROWS UNBOUNDED PRECEDING) AS balance FROM $trades t JOIN wt w ON w.series_id = t.series_id),
so AS (SELECT series_id, weight, capital, max(CASE WHEN peak > 0 THEN (peak - balance) / peak ELSE 0 END) AS max_drawdown, max(CASE WHEN back = 1 THEN balance END) AS terminal, count(*) AS trades, CAST(100 AS DOUBLE) * sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) / count(*) AS win_rate, avg(pnl) AS expectancy, coalesce(stddev_samp(pnl), 0) AS std, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS profit, -sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) AS loss
  FROM (SELECT *, greatest(capital, max(balance) OVER (PARTITION BY series_id ORDER BY trade_idx ROWS UNBOUNDED PRECEDING)) AS peak, row_number() OVER (PARTITION BY series_id ORDER BY trade_idx DESC) AS back FROM leg) x GROUP BY series_id, weight, capital)"""


def resampled(d: str, source: str, joint: bool = False) -> str:
    """CTE ``pp``: a row for each simulated path of each ``seg`` of ``source(seg, series_id,
    trade_idx, pnl)``, whose strategies draw from their own trades, each its own (or, if
    ``joint``, all the same row) at every step up to the longest strategy's."""
    draw = "sim_id * h + t + 1" if joint else "(sim_id * h + t) * legs + j + 1"
    n = "least(n, h)" if joint else "n"
    return f"""lg AS (SELECT seg, series_id, count(*) AS n, CAST(row_number() OVER (PARTITION BY seg ORDER BY series_id) - 1 AS BIGINT) AS j FROM {source} GROUP BY seg, series_id),
hz AS (SELECT seg, {"min(n)" if joint else "max(n)"} AS h, count(*) AS legs FROM lg GROUP BY seg),
sp AS (SELECT DISTINCT s.seg, trade_idx AS t FROM {source} s JOIN hz ON hz.seg = s.seg WHERE trade_idx < h),
pg AS (SELECT lg.seg, lg.series_id, {n} AS n, j, h, legs, x.i AS sim_id, t FROM lg JOIN hz ON hz.seg = lg.seg JOIN sp ON sp.seg = lg.seg CROSS JOIN {numbers(d, PATHS)} x),
{uniform(d, "pg", draw, "seg, series_id, n, sim_id, t", SEED, "p")},
pd AS (SELECT q.seg, sim_id, t, sum(p.pnl) AS pnl FROM (SELECT seg, series_id, sim_id, t, coalesce(CAST(floor(u * n) AS BIGINT), 0) AS idx FROM pr5) q JOIN {source} p ON p.seg = q.seg AND p.series_id = q.series_id AND p.trade_idx = q.idx GROUP BY q.seg, sim_id, t),
pb AS (SELECT *, CAST({CAPITAL} AS DOUBLE) + sum(pnl) OVER (PARTITION BY seg, sim_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS balance, row_number() OVER (PARTITION BY seg, sim_id ORDER BY t DESC) AS back FROM pd),
pq AS (SELECT *, greatest(CAST({CAPITAL} AS DOUBLE), max(balance) OVER (PARTITION BY seg, sim_id ORDER BY t ROWS UNBOUNDED PRECEDING)) AS peak FROM pb),
pp AS (SELECT seg, sim_id, max(CASE WHEN back = 1 THEN balance END) AS final_balance, max(CASE WHEN peak > 0 THEN (peak - balance) / peak ELSE 0 END) AS max_drawdown, max(CASE WHEN balance <= {LEVEL} THEN 1 ELSE 0 END) AS ruined FROM pq GROUP BY seg, sim_id)"""


ALL = "SELECT 'all' AS seg, series_id, trade_idx, pnl FROM $trades"
#: Trades by segment, numbered anew; strategies of SEGMENT_ROWS rows or more, segments with two strategies.
SEGMENT_ROWS = 3
SEGMENTS = f"""{AUTOCORRELATED}, sx AS (SELECT t.series_id, sg.segment AS seg, t.pnl, CAST(row_number() OVER (PARTITION BY t.series_id, sg.segment ORDER BY t.trade_idx) - 1 AS BIGINT) AS trade_idx, count(*) OVER (PARTITION BY t.series_id, sg.segment) AS own FROM $trades t JOIN sg ON sg.series_id = t.series_id AND sg.trade_idx = t.trade_idx),
sy AS (SELECT seg, count(DISTINCT series_id) AS legs FROM sx WHERE own >= {SEGMENT_ROWS} GROUP BY seg), sz AS (SELECT sx.seg, series_id, trade_idx, pnl FROM sx JOIN sy ON sy.seg = sx.seg WHERE own >= {SEGMENT_ROWS} AND legs >= 2)"""


#: The last parts of two reports, from the paths ``pp``.
_ORDER = "row_number() OVER (PARTITION BY seg ORDER BY final_balance, sim_id) - 1"
BREAKDOWN_ENDS = f"""ro AS (SELECT *, final_balance - {CAPITAL} AS pnl, {_ORDER} AS r, count(*) OVER (PARTITION BY seg) AS n FROM pp), tc AS (SELECT seg, count(*) AS trades FROM sz GROUP BY seg)
SELECT ro.seg AS segment, max(trades) AS trades, round(avg(pnl), 6) AS mean_pnl, round(CAST(100 AS DOUBLE) * sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) / count(*), 6) AS win_rate, round(max(CASE WHEN r = {at(LOW95)} THEN pnl END), 6) AS var95, round(avg(CASE WHEN r < greatest(1, CAST(floor(n * {LOW95}) AS BIGINT)) THEN pnl END), 6) AS cvar95, round(CAST(100 AS DOUBLE) * sum(ruined) / count(*), 6) AS ruin_percent
FROM ro JOIN tc ON tc.seg = ro.seg GROUP BY ro.seg"""
RATIO_ENDS = """md AS (SELECT max_drawdown, row_number() OVER (PARTITION BY seg ORDER BY max_drawdown, sim_id) - 1 AS r, count(*) OVER (PARTITION BY seg) AS n FROM pp), sd AS (SELECT sum(weight * max_drawdown) AS solo FROM so) SELECT round(max(solo), 8) AS weighted_solo, round(max(max_drawdown), 8) AS median_simulated, round(CASE WHEN max(solo) > 0 THEN max(solo) / greatest(max(max_drawdown), CAST('1e-9' AS DOUBLE)) ELSE 1 END, 6) AS ratio FROM md CROSS JOIN sd WHERE r = CAST(floor(n * CAST('0.5' AS DOUBLE)) AS BIGINT)"""


def _breakdown(d: str) -> str:
    return f"WITH {SEGMENTS}, {resampled(d, 'sz')}, {BREAKDOWN_ENDS}"


#: Regimes of all steps: the segment of the first strategy by name, dispersed where it has no trade.
REGIMES = f"""{AUTOCORRELATED}, f1 AS (SELECT min(series_id) AS first FROM $trades), rl AS (SELECT st.trade_idx, coalesce(sg.segment, 'dispersed') AS regime FROM (SELECT DISTINCT trade_idx FROM $trades) st CROSS JOIN f1 LEFT JOIN sg ON sg.series_id = f1.first AND sg.trade_idx = st.trade_idx)"""


def _dynamic(d: str) -> str:
    """Long form: how often each regime comes first, what follows it, and the correlations
    of the strategies within it."""
    return f"""WITH {REGIMES}, rc AS (SELECT regime, count(*) AS h FROM rl GROUP BY regime), nx AS (SELECT regime AS a, lead(regime) OVER (PARTITION BY one ORDER BY trade_idx) AS b FROM (SELECT 1 AS one, regime, trade_idx FROM rl) x),
tr AS (SELECT a, b, count(*) AS n FROM nx WHERE b IS NOT NULL GROUP BY a, b), tg AS (SELECT x.regime AS a, y.regime AS b FROM rc x CROSS JOIN rc y),
tn AS (SELECT tg.a, tg.b, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY tg.a) AS total, count(*) OVER (PARTITION BY tg.a) AS k FROM tg LEFT JOIN tr ON tr.a = tg.a AND tr.b = tg.b),
rt AS (SELECT t.series_id, t.trade_idx, t.pnl, rl.regime, rc.h FROM $trades t JOIN rl ON rl.trade_idx = t.trade_idx JOIN rc ON rc.regime = rl.regime), {correlations("rt", "regime")}
SELECT 'initial' AS kind, regime, '' AS i, '' AS j, round(CAST(h AS DOUBLE) / sum(h) OVER (), 8) AS value FROM rc
UNION ALL SELECT 'transition', a, b, '', round(CASE WHEN total > 0 THEN CAST(n AS DOUBLE) / total ELSE CAST(1 AS DOUBLE) / k END, 8) FROM tn
UNION ALL SELECT 'correlation', regime, i, j, round(rho, 8) FROM pr"""


HORIZON = "ah AS (SELECT t.*, h FROM $trades t CROSS JOIN (SELECT count(DISTINCT trade_idx) AS h FROM $trades) x)"
BOTH = {"trades": "trades", "weights": "weights"}
PLANS = {
    "align_sleeves": Plan(f"WITH {ALIGNED} SELECT series_id, trade_idx, round(pnl, 6) AS pnl FROM al"),
    "correlation_matrix": Plan(f"WITH {HORIZON}, {correlations('ah')} SELECT i, j, round(rho, 8) AS rho FROM pr UNION ALL SELECT j, i, round(rho, 8) FROM pr UNION ALL SELECT DISTINCT series_id, series_id, CAST(1 AS DOUBLE) FROM $trades"),
    "combine_leg_paths": Plan(f"WITH {LEGS}, ch AS (SELECT trade_idx, sum(pnl) AS pnl FROM $trades GROUP BY trade_idx) SELECT trade_idx + 1 AS t, round({CAPITAL} + sum(pnl) OVER (PARTITION BY one ORDER BY trade_idx ROWS UNBOUNDED PRECEDING), 4) AS balance FROM (SELECT 1 AS one, ch.* FROM ch) x", BOTH),
    "strategy_results": Plan(f"WITH {LEGS} SELECT series_id, round(weight, 8) AS weight, round(capital, 4) AS allocated, round(max_drawdown, 6) AS max_drawdown, round(terminal, 4) AS terminal, round(terminal - capital, 4) AS net, trades, round(win_rate, 6) AS win_rate, round(expectancy, 6) AS expectancy, round(CASE WHEN loss > 0 THEN profit / loss WHEN profit > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0 END, 6) AS profit_factor, round(CASE WHEN std > 0 THEN expectancy / std * sqrt(CAST({PERIODS} AS DOUBLE)) ELSE 0 END, 6) AS sharpe FROM so", BOTH),
    "portfolio_independent": Plan(lambda d: f"WITH al AS ({ALL}), {resampled(d, 'al')} SELECT sim_id, round(final_balance, 4) AS final_balance, round(max_drawdown, 8) AS max_drawdown, ruined FROM pp"),
    "portfolio_joint_rows": Plan(lambda d: f"WITH al AS ({ALL}), {resampled(d, 'al', joint=True)} SELECT sim_id, round(final_balance, 4) AS final_balance, round(max_drawdown, 8) AS max_drawdown, ruined FROM pp"),
    "diversification_ratio": Plan(lambda d: f"WITH {LEGS}, al AS ({ALL}), {resampled(d, 'al')}, {RATIO_ENDS}", BOTH),
    "regime_breakdown": Plan(_breakdown),
    "dynamic_copula_model": Plan(_dynamic),
}


#: On Spark the paths of a portfolio come from kernels, which draw by the same counters; a row a
#: path, ``$pp``, then stands for CTE ``pp``. ``$sz``: the trades of SEGMENTED.
SEGMENTED = Plan(f"WITH {SEGMENTS} SELECT seg, series_id, trade_idx, pnl FROM sz")
JOINT = Plan("WITH lg AS (SELECT series_id, count(*) AS n FROM $trades GROUP BY series_id), hz AS (SELECT min(n) AS h FROM lg) SELECT 'all' AS series_id, trade_idx, sum(pnl) AS pnl FROM $trades CROSS JOIN hz WHERE trade_idx < h GROUP BY trade_idx")
ENDS = "SELECT sim_id, round(final_balance, 4) AS final_balance, round(max_drawdown, 8) AS max_drawdown, CAST(ruined AS INT) AS ruined FROM pp"
PP = "pp AS (SELECT seg, sim_id, final_balance, max_drawdown, CAST(ruined AS INT) AS ruined FROM $pp)"
REDUCED = {
    "portfolio_independent": Plan(f"WITH {PP} {ENDS}", {"pp": "pp"}),
    "portfolio_joint_rows": Plan(f"WITH pp AS (SELECT * FROM $pp) {ENDS}", {"pp": "pp"}),
    "diversification_ratio": Plan(f"WITH {LEGS}, {PP}, {RATIO_ENDS}", BOTH | {"pp": "pp"}),
    "regime_breakdown": Plan(f"WITH sz AS (SELECT * FROM $sz), {PP}, {BREAKDOWN_ENDS}", {"sz": "sz", "pp": "pp"}),
}


def cholesky(matrix: np.ndarray) -> np.ndarray | None:
    """The lower factor, or None if a pivot is not above 1e-12. Small and on the driver:
    its size is the number of strategies."""
    size = len(matrix)
    low = np.zeros((size, size))
    for i in range(size):
        rest = matrix[i:, i] - low[i:, :i] @ low[i, :i]
        if rest[0] <= 1e-12:
            return None
        low[i:, i] = rest / np.sqrt(rest[0])
    return low


def repaired(matrix: np.ndarray) -> np.ndarray:
    """``matrix``, drawn towards the identity until it can be factored: each of at most
    30 tries moves it by 0.02 more than the one before, up to one half."""
    out = np.array(matrix, float)
    for attempt in range(30):
        if cholesky(out) is not None:
            return out
        share = min(0.5, 0.02 * (attempt + 1))
        out = (1 - share) * out + share * np.eye(len(out))
    return out if cholesky(out) is not None else np.eye(len(out))
