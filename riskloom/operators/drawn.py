"""SQL of the kernels' paths under models that Spark's SQL has no form for: the oracle's side of
kernels that draw by counters (``Config.counter``), path by path."""

from __future__ import annotations

from ..plans.engine import DUCKDB
from .kernels import STREAM
from .performance import CAPITAL
from .simulate import LEVEL, SEED, grid, uniform
from .stats import FITS, D

#: Regimes and doublings of the steps that the oracle has room for: 131,072 steps.
REGIMES, DOUBLINGS = 8, 17
COUNTER = "sim_id * n + t + 1"
KEEP = "series_id, n, sim_id, t"
#: CTE ``out`` of the steps ``st(series_id, sim_id, t, pnl)``: the summary of each path.
SUMMED = f"""pa AS (SELECT series_id, sim_id, t + 1 AS t, CAST({CAPITAL} AS DOUBLE) + sum(pnl) OVER (PARTITION BY series_id, sim_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS balance FROM st),
pk AS (SELECT *, greatest(CAST({CAPITAL} AS DOUBLE), max(balance) OVER (PARTITION BY series_id, sim_id ORDER BY t ROWS UNBOUNDED PRECEDING)) AS peak, max(t) OVER (PARTITION BY series_id, sim_id) AS last_t FROM pa)
SELECT series_id, sim_id, round(max(CASE WHEN t = last_t THEN balance END), 4) AS final_balance, round(greatest(CAST(0 AS DOUBLE), max(least(CAST(1 AS DOUBLE), (peak - balance) / greatest(peak, {D("1e-8")})))), 8) AS max_drawdown,
  max(CASE WHEN balance <= {LEVEL} THEN 1 ELSE 0 END) AS ruined, round((max(CASE WHEN t = last_t THEN balance END) - {CAPITAL}) / max(last_t), 10) AS ev FROM pk GROUP BY series_id, sim_id"""


def parametric_sql(pool: str) -> str:
    """Draws of the fitted law: normal by polar coordinates, Student by the same with
    df * (u ** (-2 / df) - 1) for the squared radius."""
    u = f"greatest(a.u, {D(2.0**-33)})"
    scale = "CASE WHEN df > 2 THEN sqrt((df - 2) / df) ELSE 1 END"
    text = f"""{FITS.replace("$trades", "pool")}, law AS (SELECT m.series_id, m.mu, CASE WHEN t.df IS NULL THEN m.sd ELSE m.sd * {scale} END AS sigma, t.df FROM m JOIN no ON no.series_id = m.series_id
  LEFT JOIN tb t ON t.series_id = m.series_id AND m.n >= 3 AND m.sd > {D("1e-10")} AND -2 * t.ll + 3 * ln(m.n) < -2 * no.ll + 2 * ln(m.n)),
{grid(DUCKDB)}, {uniform(DUCKDB, "g", COUNTER, KEEP)}, {uniform(DUCKDB, "g", COUNTER, KEEP, SEED + STREAM, "v")},
st AS (SELECT a.series_id, a.sim_id, a.t, mu + sigma * CASE WHEN df IS NULL THEN sqrt(-2 * ln({u})) ELSE sqrt(df * (power({u}, -2 / df) - 1)) END * cos(2 * pi() * b.u) AS pnl
  FROM r5 a JOIN vr5 b ON a.series_id = b.series_id AND a.sim_id = b.sim_id AND a.t = b.t JOIN law ON law.series_id = a.series_id),
{SUMMED}"""
    return f"WITH pool AS ({pool}), " + text.replace("$pool", "pool")


def regimes_sql(pool: str) -> str:
    """Each step is a map from regime to next regime, four bits a regime; maps are composed
    by doubling, so every step's regime is a function of the first one."""
    digit = lambda f, s: f"(({f} >> CAST(4 * ({s}) AS INTEGER)) & 15)"
    composed = " | ".join(f"({digit('b.f', digit('a.f', str(s)))} << {4 * s})" for s in range(REGIMES))
    moves = " | ".join(f"(least(k - 1, len(list_filter(list_extract(upto, {s + 1}), lambda x: x <= u))) << {4 * s})" for s in range(REGIMES))
    levels = ", ".join(f"d{i + 1} AS (SELECT b.series_id, b.sim_id, b.t, CASE WHEN a.f IS NULL THEN b.f ELSE {composed} END AS f FROM d{i} b LEFT JOIN d{i} a ON a.series_id = b.series_id AND a.sim_id = b.sim_id AND a.t = b.t - {1 << i})" for i in range(DOUBLINGS))
    text = f"""la AS (SELECT series_id, trade_idx, pnl, coalesce(regime, 'default') AS regime FROM pool),
fr AS (SELECT series_id, regime, count(*) AS size, row_number() OVER (PARTITION BY series_id ORDER BY min(trade_idx)) - 1 AS s, count(*) OVER (PARTITION BY series_id) AS k FROM la GROUP BY series_id, regime),
ix AS (SELECT la.series_id, fr.s, pnl, row_number() OVER (PARTITION BY la.series_id, fr.s ORDER BY trade_idx) - 1 AS i, trade_idx FROM la JOIN fr ON fr.series_id = la.series_id AND fr.regime = la.regime),
mv AS (SELECT series_id, s AS a, lead(s) OVER (PARTITION BY series_id ORDER BY trade_idx) AS b FROM ix),
mc AS (SELECT series_id, a, b, count(*) AS c FROM mv WHERE b IS NOT NULL GROUP BY series_id, a, b),
gr AS (SELECT x.series_id, x.s AS a, y.s AS b, x.k, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY x.series_id, x.s) AS total FROM fr x JOIN fr y ON x.series_id = y.series_id LEFT JOIN mc ON mc.series_id = x.series_id AND mc.a = x.s AND mc.b = y.s),
cu AS (SELECT series_id, k, a, b, sum(CASE WHEN total > 0 THEN CAST(c AS DOUBLE) / CAST(total AS DOUBLE) ELSE CAST(1 AS DOUBLE) / k END) OVER (PARTITION BY series_id, a ORDER BY b ROWS UNBOUNDED PRECEDING) AS p FROM gr),
ro AS (SELECT series_id, k, a, list(p ORDER BY b) AS row FROM cu GROUP BY series_id, k, a), tr AS (SELECT series_id, k, list(row ORDER BY a) AS upto FROM ro GROUP BY series_id, k),
{grid(DUCKDB)}, {uniform(DUCKDB, "g", COUNTER, KEEP)}, {uniform(DUCKDB, "g", COUNTER, KEEP, SEED + STREAM, "v")}, g0 AS (SELECT * FROM g WHERE t = 0), {uniform(DUCKDB, "g0", COUNTER, KEEP, SEED + 2 * STREAM, "w")},
d0 AS (SELECT v.series_id, v.sim_id, v.t + 1 AS t, CAST({moves} AS BIGINT) AS f FROM vr5 v JOIN tr ON tr.series_id = v.series_id), {levels},
fi AS (SELECT w.series_id, w.sim_id, least(k - 1, CAST(floor(u * k) AS BIGINT)) AS s FROM wr5 w JOIN tr ON tr.series_id = w.series_id),
wh AS (SELECT r.series_id, r.sim_id, r.t, r.u, CASE WHEN r.t = 0 THEN fi.s ELSE {digit('d.f', 'fi.s')} END AS s FROM r5 r JOIN fi ON fi.series_id = r.series_id AND fi.sim_id = r.sim_id LEFT JOIN d{DOUBLINGS} d ON d.series_id = r.series_id AND d.sim_id = r.sim_id AND d.t = r.t),
st AS (SELECT wh.series_id, wh.sim_id, wh.t, ix.pnl FROM wh JOIN fr ON fr.series_id = wh.series_id AND fr.s = wh.s JOIN ix ON ix.series_id = wh.series_id AND ix.s = wh.s AND ix.i = CAST(floor(wh.u * fr.size) AS BIGINT)),
{SUMMED}"""
    return f"WITH pool AS ({pool}), " + text.replace("$pool", "pool")
