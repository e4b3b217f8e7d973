"""Stress scenarios: each a shocked copy of the series, all replayed in one pass.

On Spark the pass goes over blocks of a series, so that no task sorts a series: shocks are
columns side by side, and what stands before a block (sums, peaks, flipped wins of equal size)
comes from totals, a row a block."""

from __future__ import annotations

from ..plans.engine import SPARK, Plan
from ..plans.scans import BLOCK
from .orderstats import order_stats
from .performance import CAPITAL

RUIN_PERCENT = 50
LEVEL = f"(CAST({CAPITAL} AS DOUBLE) * (1 - CAST({RUIN_PERCENT} AS DOUBLE) / 100))"


def _worst(k: int) -> str:
    """The worst ``k`` trades in a row; a series with fewer stays as it is, one row of nothing."""
    return f"""w{k} AS (SELECT series_id, trade_idx, row_number() OVER (PARTITION BY series_id ORDER BY round(s, 6), trade_idx) AS n FROM (
    SELECT series_id, trade_idx, sum(pnl) OVER (PARTITION BY series_id ORDER BY trade_idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS s FROM base) x WHERE trade_idx >= {k - 1}),
s{k} AS (SELECT b.series_id, 'worst_{k}' AS scenario, b.trade_idx, CASE WHEN w.n = 1 THEN pnl ELSE 0 END AS pnl FROM base b LEFT JOIN w{k} w ON b.series_id = w.series_id AND w.n = 1 WHERE w.n IS NULL AND b.trade_idx = 0 OR b.trade_idx > w.trade_idx - {k} AND b.trade_idx <= w.trade_idx)"""


def _flip(source: str, name: str, share: str) -> str:
    """The smallest ``share`` of the wins of ``source`` become average losses."""
    return f"""{name} AS (SELECT series_id, '{name}' AS scenario, trade_idx, CASE WHEN pnl > 0 AND r <= CAST(floor(wins * CAST('{share}' AS DOUBLE)) AS BIGINT) THEN loss ELSE pnl END AS pnl FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, CASE WHEN pnl > 0 THEN 1 ELSE 0 END ORDER BY round(pnl, 9), trade_idx) AS r, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id) AS wins,
      coalesce(avg(CASE WHEN pnl < 0 THEN pnl END) OVER (PARTITION BY series_id), -sd) AS loss FROM {source}) x)"""


SCENARIOS = f"""base AS (SELECT t.series_id, trade_idx, pnl, mean, sd, low FROM $trades t JOIN (SELECT series_id, avg(pnl) AS mean, coalesce(stddev_samp(pnl), 0) AS sd, min(pnl) AS low FROM $trades GROUP BY series_id) m ON t.series_id = m.series_id),
{_worst(5)}, {_worst(10)}, {_worst(20)},
vol AS (SELECT series_id, trade_idx, mean + (pnl - mean) * CAST('1.5' AS DOUBLE) AS pnl, sd FROM base),
{_flip("base", "win_rate_10", "0.1")}, {_flip("base", "win_rate_20", "0.2")}, {_flip("vol", "combined", "0.1")},
shocked AS (
  SELECT * FROM s5 UNION ALL SELECT * FROM s10 UNION ALL SELECT * FROM s20
  UNION ALL SELECT series_id, 'volatility_1.5', trade_idx, pnl FROM vol
  UNION ALL SELECT series_id, 'volatility_2', trade_idx, mean + (pnl - mean) * 2 FROM base
  UNION ALL SELECT * FROM win_rate_10 UNION ALL SELECT * FROM win_rate_20
  UNION ALL SELECT series_id, 'losses_2', trade_idx, CASE WHEN pnl < 0 THEN pnl * 2 ELSE pnl END FROM base
  UNION ALL SELECT series_id, 'black_swan', trade_idx, pnl FROM base
  UNION ALL SELECT DISTINCT series_id, 'black_swan', CAST(k AS BIGINT), low * 5 FROM base CROSS JOIN (SELECT column0 AS k FROM (VALUES (-1), (-2), (-3)) AS v(column0)) v
  UNION ALL SELECT * FROM combined
),
eq AS (
  SELECT series_id, scenario, trade_idx, CAST({CAPITAL} AS DOUBLE) + sum(pnl) OVER (PARTITION BY series_id, scenario ORDER BY trade_idx ROWS UNBOUNDED PRECEDING) AS equity, row_number() OVER (PARTITION BY series_id, scenario ORDER BY trade_idx DESC) AS back FROM shocked
), pk AS (SELECT *, greatest(CAST({CAPITAL} AS DOUBLE), max(equity) OVER (PARTITION BY series_id, scenario ORDER BY trade_idx ROWS UNBOUNDED PRECEDING)) AS peak FROM eq),
rs AS (SELECT series_id, scenario, max(CASE WHEN back = 1 THEN equity END) AS capital_after, max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END) AS max_drawdown FROM pk GROUP BY series_id, scenario),
res AS (SELECT rs.*, n < CASE scenario WHEN 'worst_5' THEN 5 WHEN 'worst_10' THEN 10 WHEN 'worst_20' THEN 20 ELSE 0 END AS short FROM rs JOIN (SELECT series_id, count(*) AS n FROM $trades GROUP BY series_id) m ON m.series_id = rs.series_id)"""

#: Scenarios that shock all of a series, with the result of each row.
SHOCKS = {
    "volatility_1.5": "vol", "volatility_2": "mean + (pnl - mean) * 2", "win_rate_10": "CASE WHEN f1 THEN loss ELSE pnl END", "win_rate_20": "CASE WHEN f2 THEN loss ELSE pnl END",
    "losses_2": "CASE WHEN pnl < 0 THEN pnl * 2 ELSE pnl END", "black_swan": "pnl", "combined": "CASE WHEN f3 THEN vloss ELSE vol END",
}
#: Flips: the wins they order, and their share of those.
FLIPS = {1: ("win", "0.1"), 2: ("win", "0.2"), 3: ("vwin", "0.1")}
WORST = (5, 10, 20)
REACH = max(WORST) - 1


def _each(text: str, over=range(1, len(SHOCKS) + 1)) -> str:
    return ", ".join(text.replace("#", str(i)) for i in over)


START = f"CAST({CAPITAL} AS DOUBLE)"
VOL = "mean + (pnl - mean) * CAST('1.5' AS DOUBLE)"
SO_FAR = "OVER (PARTITION BY series_id, blk ORDER BY trade_idx ROWS UNBOUNDED PRECEDING)"
BEFORE = "OVER (PARTITION BY series_id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SUMS = ", ".join(f"sum(pnl) OVER (PARTITION BY series_id, blk ORDER BY trade_idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS s{k}" for k in WORST)
OF_SERIES = "m AS (SELECT series_id, count(*) AS rows, count(pnl) AS known, avg(pnl) AS mean, coalesce(stddev_samp(pnl), 0) AS sd, min(pnl) AS low, coalesce(avg(CASE WHEN pnl < 0 THEN pnl END), -coalesce(stddev_samp(pnl), 0)) AS loss FROM $t GROUP BY series_id)"


def _flipped() -> str:
    """A row a block: how many wins as large as the last flipped one are still to be flipped in it."""
    share = lambda i, n="n": f"CAST(floor({n} * CAST('{FLIPS[i][1]}' AS DOUBLE)) AS BIGINT)"
    ties = ", ".join(f"sum(CASE WHEN {w} = v{i} THEN 1 ELSE 0 END) AS tie{i}, sum(CASE WHEN {w} < v{i} THEN 1 ELSE 0 END) AS less{i}" for i, (w, _) in FLIPS.items())
    return f"""WITH {OF_SERIES},
v AS (SELECT series_id, trade_idx, pnl, sd, {VOL} AS vol FROM (SELECT /*+ BROADCAST(m) */ t.series_id, trade_idx, pnl, mean, sd FROM $t t JOIN m ON t.series_id = m.series_id) x),
base AS (SELECT series_id, CAST(floor(trade_idx / {BLOCK}) AS BIGINT) AS blk, CASE WHEN pnl > 0 THEN round(pnl, 9) END AS win, CASE WHEN vol > 0 THEN round(vol, 9) END AS vwin FROM v),
vl AS (SELECT series_id, coalesce(avg(CASE WHEN vol < 0 THEN vol END), -max(sd)) AS vloss FROM v GROUP BY series_id),
{order_stats(SPARK, "q", "base", "series_id", "win", {f"v{i}": share(i) + " - 1" for i in (1, 2)})},
{order_stats(SPARK, "z", "base", "series_id", "vwin", {"v3": share(3) + " - 1"})},
cut AS (SELECT m.series_id, mean, low, loss, vloss, v1, v2, v3, {share(1, "q.n")} AS k1, {share(2, "q.n")} AS k2, {share(3, "z.n")} AS k3 FROM m JOIN vl ON vl.series_id = m.series_id LEFT JOIN q ON q.series_id = m.series_id LEFT JOIN z ON z.series_id = m.series_id),
bt AS (SELECT /*+ BROADCAST(cut) */ b.series_id, blk, count(*) AS size, first(struct(cut.*)) AS cut, {ties} FROM base b JOIN cut ON cut.series_id = b.series_id GROUP BY b.series_id, blk)
SELECT series_id, blk, size, cut.mean, cut.low, cut.loss, cut.vloss, {_each("cut.v#, cut.k# - sum(less#) OVER (PARTITION BY series_id) - coalesce(sum(tie#) " + BEFORE + ", 0) AS left#", FLIPS)} FROM bt"""


def _within() -> str:
    """CTE ``d5``: each row's place, window sums, and sums and peaks of each shock inside its block."""
    return f"""d AS (SELECT series_id, CAST(floor(trade_idx / {BLOCK}) AS BIGINT) AS blk, trade_idx, pnl FROM $t DISTRIBUTE BY series_id, blk),
d0 AS (SELECT *, CASE WHEN pnl > 0 THEN round(pnl, 9) END AS win, CASE WHEN vol > 0 THEN round(vol, 9) END AS vwin FROM (
  SELECT /*+ BROADCAST(k) */ d.series_id, d.blk, trade_idx, pnl, {VOL} AS vol, size, mean, loss, vloss, {_each("v#, left#", FLIPS)} FROM d JOIN $k k ON d.series_id = k.series_id AND d.blk = k.blk) x),
d1 AS (SELECT *, row_number() OVER (PARTITION BY series_id, blk ORDER BY trade_idx) AS rn, {", ".join(f"sum(CASE WHEN {w} = v{i} THEN 1 ELSE 0 END) {SO_FAR} AS r{i}" for i, (w, _) in FLIPS.items())}, {SUMS} FROM d0),
d2 AS (SELECT *, {", ".join(f"coalesce({w} < v{i} OR {w} = v{i} AND r{i} <= left{i}, FALSE) AS f{i}" for i, (w, _) in FLIPS.items())} FROM d1),
d3 AS (SELECT series_id, blk, trade_idx, pnl, rn, size, {", ".join(f"s{k}" for k in WORST)}, {", ".join(f"coalesce({x}, 0) AS p{i}" for i, x in enumerate(SHOCKS.values(), 1))} FROM d2),
d4 AS (SELECT *, {_each(f"sum(p#) {SO_FAR} AS c#")} FROM d3),
d5 AS (SELECT *, {_each(f"max(c#) {SO_FAR} AS h#")} FROM d4)"""


def _least(where: str) -> str:
    """The least sum of each length and the row where it ends, the first of equal ones."""
    return ", ".join(f"min(CASE WHEN trade_idx >= {k - 1} AND {where.replace('#', str(k))} THEN struct(round(s{k}, 6) AS s, trade_idx) END) AS w{k}" for k in WORST)


def _totals() -> str:
    """A row a block: what ``d5`` comes to, and its first and last rows, where sums cross blocks."""
    return f"""WITH {_within()} SELECT series_id, blk, {_each("max_by(c#, rn) AS t#, max(c#) AS h#")}, {_least("rn >= #")},
  sort_array(collect_list(CASE WHEN rn <= {REACH} THEN struct(rn, trade_idx, pnl) END)) AS head, sort_array(collect_list(CASE WHEN rn > size - {REACH} THEN struct(rn, trade_idx, pnl) END)) AS tail FROM d5 GROUP BY series_id, blk"""


def _blocks() -> str:
    """CTE ``res`` and others, from the rows ``t``, ``k`` of _flipped and ``b`` of _totals."""
    swan = list(SHOCKS).index("black_swan") + 1
    peak = f"greatest(pk#, {START} + o# + d5.h#)"
    of_swan = lambda x, nothing: ", ".join(x.replace("#", str(i)) if i == swan else nothing for i in range(1, len(SHOCKS) + 1))
    worst = " UNION ALL ".join(f"SELECT /*+ BROADCAST(wk) */ t.series_id, 'worst_{k}' AS scenario, t.trade_idx, CASE WHEN w{k} IS NULL THEN 0 ELSE pnl END AS pnl FROM $t t JOIN wk ON t.series_id = wk.series_id WHERE w{k} IS NULL AND t.trade_idx = 0 OR t.trade_idx > w{k}.trade_idx - {k} AND t.trade_idx <= w{k}.trade_idx" for k in WORST)
    stacked = ", ".join(f"'{x}', e{i}, a{i}" for i, x in enumerate(SHOCKS, 1))
    return f"""{OF_SERIES}, {_within()},
tt AS (SELECT series_id, blk, {_each("t#, h#")} FROM $b UNION ALL SELECT series_id, CAST(NULL AS BIGINT), {of_swan("low * 15, greatest(low * 5, low * 15)", "CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)")} FROM m),
sums AS (SELECT *, {_each(f"coalesce(sum(t#) {BEFORE}, 0) AS o#")} FROM tt),
tk AS (SELECT series_id, blk, {_each(f"o#, {START} + greatest(0, coalesce(max(o# + h#) {BEFORE}, 0)) AS pk#")} FROM sums),
dd AS (SELECT series_id, {_each("max(a#) AS a#")} FROM (
  SELECT /*+ BROADCAST(tk) */ d5.series_id, {_each(f"CASE WHEN {peak} > 0 THEN ({peak} - ({START} + o# + c#)) / {peak} ELSE 0 END AS a#")} FROM d5 JOIN tk ON d5.series_id = tk.series_id AND d5.blk = tk.blk
  UNION ALL SELECT series_id, {of_swan(f"greatest(CAST(0 AS DOUBLE), -low * 15 / {START})", "CAST(0 AS DOUBLE)")} FROM m) x GROUP BY series_id),
te AS (SELECT series_id, {_each(f"{START} + sum(t#) AS e#")} FROM tt GROUP BY series_id),
led AS (SELECT series_id, blk, flatten(collect_list(tail) OVER (PARTITION BY series_id ORDER BY blk ROWS BETWEEN {REACH} PRECEDING AND 1 PRECEDING)) AS tails FROM $b),
ed AS (SELECT series_id, blk, x.trade_idx, x.pnl, x.rn FROM $b LATERAL VIEW explode(head) e AS x UNION ALL SELECT series_id, blk, x.trade_idx, x.pnl, NULL FROM led LATERAL VIEW explode(tails) e AS x),
es AS (SELECT *, {SUMS} FROM ed),
wk AS (SELECT series_id, {", ".join(f"min(w{k}) AS w{k}" for k in WORST)} FROM (SELECT series_id, {", ".join(f"w{k}" for k in WORST)} FROM $b UNION ALL SELECT series_id, {_least("rn < #")} FROM es GROUP BY series_id) x GROUP BY series_id),
ws AS ({worst}),
we AS (SELECT series_id, scenario, trade_idx, {START} + sum(pnl) OVER (PARTITION BY series_id, scenario ORDER BY trade_idx ROWS UNBOUNDED PRECEDING) AS equity, row_number() OVER (PARTITION BY series_id, scenario ORDER BY trade_idx DESC) AS back FROM ws),
wp AS (SELECT *, greatest({START}, max(equity) OVER (PARTITION BY series_id, scenario ORDER BY trade_idx ROWS UNBOUNDED PRECEDING)) AS peak FROM we),
rs AS (SELECT series_id, scenario, max(CASE WHEN back = 1 THEN equity END) AS capital_after, max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END) AS max_drawdown FROM wp GROUP BY series_id, scenario
  UNION ALL SELECT te.series_id, stack({len(SHOCKS)}, {stacked}) AS (scenario, capital_after, max_drawdown) FROM te JOIN dd ON te.series_id = dd.series_id),
res AS (SELECT rs.series_id, scenario, CASE WHEN known > 0 THEN capital_after END AS capital_after, CASE WHEN known > 0 THEN max_drawdown END AS max_drawdown, rows < CASE scenario WHEN 'worst_5' THEN 5 WHEN 'worst_10' THEN 10 WHEN 'worst_20' THEN 20 ELSE 0 END AS short FROM rs JOIN m ON m.series_id = rs.series_id)"""


#: What Spark writes down first: the numbered history, and two tables of a row a block.
STAGES = {"t": "SELECT series_id, CAST(trade_idx AS BIGINT) AS trade_idx, CAST(pnl AS DOUBLE) AS pnl FROM $trades", "k": _flipped(), "b": _totals()}


def scenarios(d: str) -> str:
    return _blocks() if d == SPARK else SCENARIOS


#: The scenarios in their order: of equal drawdowns the first one counts.
NAMES = ("worst_5", "worst_10", "worst_20", "volatility_1.5", "volatility_2", "win_rate_10", "win_rate_20", "losses_2", "black_swan", "combined")
ORDER = "CASE scenario " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(NAMES)) + " END"

PLANS = {
    "stress_scenarios": Plan(lambda d: f"""WITH {scenarios(d)} SELECT series_id, scenario, round(capital_after, 4) AS capital_after, round(max_drawdown, 6) AS max_drawdown, CASE WHEN capital_after > {LEVEL} THEN 1 ELSE 0 END AS survives,
  CASE WHEN short THEN 'low' WHEN scenario LIKE 'worst%' THEN CASE WHEN max_drawdown > CAST('0.3' AS DOUBLE) THEN 'extreme' WHEN max_drawdown > CAST('0.15' AS DOUBLE) THEN 'high' ELSE 'medium' END WHEN scenario IN ('volatility_1.5', 'win_rate_20') THEN 'high' WHEN scenario = 'win_rate_10' THEN 'medium' ELSE 'extreme' END AS severity FROM res""", stages=STAGES),
    "worst_survivable": Plan(lambda d: f"WITH {scenarios(d)}, su AS (SELECT series_id, scenario, max_drawdown, row_number() OVER (PARTITION BY series_id ORDER BY round(max_drawdown, 9) DESC, {ORDER}) AS k, count(*) OVER (PARTITION BY series_id) AS surviving FROM res WHERE capital_after > {LEVEL}) SELECT i.series_id, scenario, round(max_drawdown, 6) AS max_drawdown, coalesce(surviving, 0) AS surviving FROM (SELECT DISTINCT series_id FROM $trades) i LEFT JOIN su ON su.series_id = i.series_id AND su.k = 1", stages=STAGES),
}
