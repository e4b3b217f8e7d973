"""Reports over the summaries of simulated paths, whatever drew them and however many.

``$paths``: a row for each path: series_id, sim_id (from 0), final_balance, max_drawdown,
ruined (boolean), steps, outcome, event_step. ``$plain``: series_id, sim_id and v, the sum of
as many plain draws; ``$pool``: the history."""

from __future__ import annotations

from dataclasses import dataclass

from ..plans.engine import DUCKDB, SPARK, Plan
from .orderstats import first, order_stats, position
from .performance import CAPITAL, PERIODS
from .simulate import PATHS, RULES, SEED, grid, paths, uniform
from .stats import D, ad_p, kolmogorov, two_samples

#: Numbers of paths at which the estimates are looked at, besides all.
CHECKPOINTS = (100, 200, 500, 1000, 2000, 5000, 10_000, 20_000, 50_000)
#: Offset of the seed of the plain sample, and most sums of it.
OTHER_SEED, SAMPLES = 7919, 2000
LOW95, LOW99 = f"(1 - {D('0.95')})", f"(1 - {D('0.99')})"


@dataclass(frozen=True)
class Settings:
    """What the reports are told of a run. ``periods``: trades of a year, at most; a history
    with fewer counts as one year."""

    model: str = "bootstrap"
    seed: int = SEED
    capital: float = CAPITAL
    ruin_percent: float = 50
    periods: int = PERIODS
    multiplicative: bool = False
    checkpoints: tuple[int, ...] = CHECKPOINTS

    @property
    def level(self) -> str:
        return D(self.capital * (1 - self.ruin_percent / 100))


def _metrics(d: str, s: Settings) -> str:
    """Skewness and kurtosis are 0 for results that do not vary (but for rounding)."""
    balances = {"var95": position(LOW95), "var99": position(LOW99), "median_balance": position(D("0.5")), "p5_balance": position(D("0.05")), "p95_balance": position(D("0.95"))}
    return f"""WITH {order_stats(d, "ob", "$paths", "series_id", "final_balance", balances, {"cvar95": first(LOW95), "cvar99": first(LOW99)})},
{order_stats(d, "od", "$paths", "series_id", "max_drawdown", {"median_drawdown": position(D("0.5")), "p95_drawdown": position(D("0.95"))})},
mu AS (SELECT series_id, avg(final_balance) AS mean_balance, max(abs(final_balance)) AS most, {D(100)} * sum(CASE WHEN final_balance < {D(s.capital)} THEN 1 ELSE 0 END) / count(*) AS probability_of_loss, {D(100)} * sum(CASE WHEN ruined THEN 1 ELSE 0 END) / count(*) AS ruin_percent, CAST(max(steps) AS DOUBLE) AS steps FROM $paths GROUP BY series_id),
m AS (SELECT p.series_id, avg(power(final_balance - mean_balance, 2)) AS m2, avg(power(final_balance - mean_balance, 3)) AS m3, avg(power(final_balance - mean_balance, 4)) AS m4 FROM $paths p JOIN mu ON mu.series_id = p.series_id GROUP BY p.series_id),
y AS (SELECT mu.*, m2, m3, m4, ob.n, var95, var99, cvar95, cvar99, median_balance, p5_balance, p95_balance, median_drawdown, p95_drawdown, m2 > {D("1e-18")} * greatest({D(1)}, most * most) AS varies,
  steps / least({D(s.periods)}, greatest({D(1)}, steps)) AS years, greatest(median_balance / {D(s.capital)}, 0) AS growth
  FROM mu JOIN m ON m.series_id = mu.series_id JOIN ob ON ob.series_id = mu.series_id JOIN od ON od.series_id = mu.series_id)
SELECT series_id, round(var95 - {D(s.capital)}, 6) AS var95, round(var99 - {D(s.capital)}, 6) AS var99, round(cvar95 - {D(s.capital)}, 6) AS cvar95, round(cvar99 - {D(s.capital)}, 6) AS cvar99, round(median_balance, 6) AS median_balance, round(median_drawdown, 8) AS median_drawdown, round(p95_drawdown, 8) AS p95_drawdown,
  round(CASE WHEN n >= 3 AND varies THEN m3 / power(CASE WHEN varies THEN m2 ELSE 1 END, 1.5) ELSE 0 END, 6) AS skewness, round(CASE WHEN n >= 4 AND varies THEN m4 / power(CASE WHEN varies THEN m2 ELSE 1 END, 2) - 3 ELSE 0 END, 6) AS excess_kurtosis, round(probability_of_loss, 6) AS probability_of_loss, round(ruin_percent, 6) AS ruin_percent, round(mean_balance, 6) AS mean_balance, round(p5_balance, 6) AS p5_balance, round(p95_balance, 6) AS p95_balance,
  round(years, 8) AS years, round(CASE WHEN median_drawdown > 0 THEN (power(growth, 1 / years) - 1) / median_drawdown ELSE 0 END, 6) AS calmar,
  round((mean_balance - {D(s.capital)}) / greatest(steps, 1), 8) AS mean_ev, round((p5_balance - {D(s.capital)}) / greatest(steps, 1), 8) AS low_ev, round((p95_balance - {D(s.capital)}) / greatest(steps, 1), 8) AS high_ev FROM y"""


def _prop(d: str, s: Settings) -> str:
    return f"""WITH {order_stats(d, "os", "$paths", "series_id, outcome", "event_step", {"median": position(D("0.5"))})},
c AS (SELECT series_id, outcome, count(*) AS paths FROM $paths GROUP BY series_id, outcome), t AS (SELECT series_id, sum(paths) AS total FROM c GROUP BY series_id)
SELECT c.series_id, c.outcome, CAST(paths AS BIGINT) AS paths, round({D(100)} * paths / total, 6) AS percent, CAST(median AS DOUBLE) AS median_trades
FROM c JOIN t ON t.series_id = c.series_id LEFT JOIN os ON os.series_id = c.series_id AND os.outcome = c.outcome"""


def _checkpoints(d: str, s: Settings) -> str:
    """CTE ``cv``: estimates over the first paths of each checkpoint, and over all."""
    sizes = ", ".join(map(str, s.checkpoints))
    if d == SPARK:
        pairs = f"SELECT series_id, CAST(points AS BIGINT) AS points, final_balance FROM (SELECT p.*, explode(filter(array_distinct(array({sizes}, total)), x -> x <= total AND x > sim_id)) AS points FROM (SELECT p.series_id, sim_id, final_balance, CAST(total AS INT) AS total FROM $paths p JOIN np ON np.series_id = p.series_id) p) x"
    else:
        pairs = f"SELECT series_id, points, final_balance FROM (SELECT p.series_id, sim_id, final_balance, CAST(unnest(list_distinct([{sizes}, total])) AS BIGINT) AS points, total FROM $paths p JOIN np ON np.series_id = p.series_id) x WHERE points <= total AND sim_id < points"
    return f"""np AS (SELECT series_id, count(*) AS total FROM $paths GROUP BY series_id), ck AS ({pairs}),
{order_stats(d, "oc", "ck", "series_id, points", "final_balance", {"var95": position(LOW95)}, {"cvar95": first(LOW95)})},
ce AS (SELECT series_id, points, {D(100)} * sum(CASE WHEN final_balance <= {s.level} THEN 1 ELSE 0 END) / count(*) AS ruin_percent, avg(final_balance) AS mean_balance, coalesce(stddev_samp(final_balance), 0) / sqrt(CAST(count(*) AS DOUBLE)) AS se_mean FROM ck GROUP BY series_id, points),
cv AS (SELECT ce.series_id, ce.points AS n, var95 - {D(s.capital)} AS var95, cvar95 - {D(s.capital)} AS cvar95, ruin_percent, mean_balance, se_mean FROM ce JOIN oc ON oc.series_id = ce.series_id AND oc.points = ce.points)"""


def _status(d: str, s: Settings) -> str:
    """Whether the last three checkpoints agree: VaR within 2 %, ruin within half a
    point, the mean within 1 %; two of the three are marginal. Fewer never converge."""
    last = lambda c: f"max(CASE WHEN k = 1 THEN {c} END)"
    stable = lambda c, share: f"(CASE WHEN max({c}) - min({c}) < {share} * CASE WHEN {last(c)} = 0 THEN 1 ELSE abs({last(c)}) END THEN 1 ELSE 0 END)"
    return f"""WITH {_checkpoints(d, s)}, la AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC) AS k FROM cv),
sc AS (SELECT series_id, count(*) AS points, {stable("var95", D("0.02"))} + (CASE WHEN max(ruin_percent) - min(ruin_percent) < {D("0.5")} THEN 1 ELSE 0 END) + {stable("mean_balance", D("0.01"))} AS agree FROM la WHERE k <= 3 GROUP BY series_id)
SELECT series_id, agree, CASE WHEN points < 3 OR agree < 2 THEN 'not_converged' WHEN agree = 3 THEN 'converged' ELSE 'marginal' END AS status FROM sc"""


def _goodness(d: str, s: Settings) -> str:
    """Final results of paths against sums of as many plain draws; 10 rows of history at least."""
    return f"""WITH h AS (SELECT series_id FROM $pool GROUP BY series_id HAVING count(*) >= 10),
sa AS (SELECT series_id, round(final_balance - {D(s.capital)}, 6) AS v, 0 AS s, sim_id AS k FROM $paths UNION ALL SELECT series_id, round(v, 6), 1, sim_id FROM $plain),
{two_samples("sa", "k")}, gk AS (SELECT series_id, max(abs(CAST(i AS DOUBLE) / n - CAST(j AS DOUBLE) / m)) AS d, max(sqrt(CAST(n AS DOUBLE) * m / (n + m))) AS en,
  sum(CASE WHEN k < n + m THEN power(CAST(i AS DOUBLE) * (n + m) - CAST(n AS DOUBLE) * k, 2) / (CAST(k AS DOUBLE) * greatest(1, n + m - k)) ELSE 0 END) / max(CAST(n AS DOUBLE) * m) AS a2 FROM o GROUP BY series_id HAVING max(n) > 0 AND max(m) > 0),
gp AS (SELECT gk.series_id, d, (en + {D('0.12')} + {D('0.11')} / en) * d AS lam, a2 FROM gk JOIN h ON h.series_id = gk.series_id),
gq AS (SELECT series_id, d, {kolmogorov("lam")} AS ks_p, a2, {ad_p("a2")} AS ad_p FROM gp)
SELECT series_id, round(d, 8) AS ks, round(ks_p, 6) AS ks_p, round(a2, 6) AS ad, round(ad_p, 6) AS ad_p, CASE WHEN ks_p < {D(0.01)} OR ad_p <= {D(0.01)} THEN 'fail' WHEN ks_p < {D(0.05)} OR ad_p <= {D(0.05)} THEN 'warn' ELSE 'pass' END AS verdict FROM gq"""


def _section(d: str, s: Settings) -> str:
    """The first section of an export, a field a row: VaR and CVaR only where the ends of the
    paths say something, that is, differ, and are no orders of the same absolute results."""
    number = lambda x: f"CAST(CAST(round({x}, 4) AS DECIMAL(28, 4)) AS STRING)"
    never = s.model == "permutation" and not s.multiplicative
    fields = {
        "model": f"'{s.model}'", "seed": f"'{s.seed}'", "n_simulations": "CAST(n AS STRING)", "trades": "CAST(steps AS STRING)", "terminal_pnl_metrics_valid": "CASE WHEN valid THEN 'true' ELSE 'false' END",
        "var_95": f"CASE WHEN valid THEN {number('var95')} ELSE 'N/A' END", "cvar_95": f"CASE WHEN valid THEN {number('cvar95')} ELSE 'N/A' END", "ruin_probability_pct": number("ruin"),
    }
    each = " UNION ALL ".join(f"SELECT series_id, '{k}' AS field, {v} AS value FROM f" for k, v in fields.items())
    return f"""WITH {order_stats(d, "ob", "$paths", "series_id", "final_balance", {"v95": position(LOW95)}, {"c95": first(LOW95)})},
a AS (SELECT series_id, max(steps) AS steps, count(*) AS paths, max(final_balance) - min(final_balance) AS spread, {D(100)} * sum(CASE WHEN ruined THEN 1 ELSE 0 END) / count(*) AS ruin FROM $paths GROUP BY series_id),
f AS (SELECT a.series_id, n, steps, ruin, {"1 = 0" if never else f"(paths < 2 OR spread >= {D('1e-4')})"} AS valid, v95 - {D(s.capital)} AS var95, c95 - {D(s.capital)} AS cvar95 FROM a JOIN ob ON ob.series_id = a.series_id) {each}"""


def _rows(d: str, s: Settings) -> str:
    """The second section: a row for each path."""
    return f"WITH p AS (SELECT * FROM $paths) SELECT series_id, sim_id + 1 AS simulation_path, round(final_balance, 2) AS final_balance, round(max_drawdown * 100, 4) AS max_drawdown, round(final_balance - {D(s.capital)}, 2) AS terminal_pnl FROM p"


REPORTS = {"risk_metrics": _metrics, "prop_evaluation": _prop, "convergence": lambda d, s: f"WITH {_checkpoints(d, s)} SELECT series_id, n, round(var95, 6) AS var95, round(cvar95, 6) AS cvar95, round(ruin_percent, 6) AS ruin_percent, round(mean_balance, 6) AS mean_balance, round(se_mean, 6) AS se_mean FROM cv", "convergence_status": _status, "csv_export_metadata": _section, "csv_export_paths": _rows}


def plans(settings: Settings) -> dict[str, Plan]:
    """The reports of a run with these settings."""
    one = {name: Plan(lambda d, f=f: f(d, settings), {"paths": "paths"}) for name, f in REPORTS.items()}
    return one | {"goodness_of_fit": Plan(lambda d: _goodness(d, settings), {"pool": "single", "paths": "single_paths", "plain": "single_plain"})}


PLANS = plans(Settings())
#: The export of a run that says nothing of its ends.
PLANS["csv_export_metadata_permutation"] = Plan(lambda d: _section(d, Settings(model="permutation")), {"paths": "permuted_paths"})


def paths_sql(pool: str, how: str = "bootstrap") -> str:
    """The summaries of PATHS paths of the view ``pool``, in the oracle's SQL."""
    drawdown, target, share = RULES
    text = f"""{paths(DUCKDB, how)}, ev AS (SELECT series_id, sim_id, t, CASE WHEN peak - balance >= {drawdown} THEN 'drawdown' WHEN balance - {CAPITAL} >= {target} THEN CASE WHEN max(pnl) OVER (PARTITION BY series_id, sim_id ORDER BY t ROWS UNBOUNDED PRECEDING) > (balance - {CAPITAL}) * {share} / {D(100)} THEN 'consistency' ELSE 'passed' END END AS event FROM pk),
f AS (SELECT series_id, sim_id, event, t, row_number() OVER (PARTITION BY series_id, sim_id ORDER BY t) AS k FROM ev WHERE event IS NOT NULL)
SELECT ps.series_id, ps.sim_id, final_balance, max_drawdown, ruined = 1 AS ruined, steps, coalesce(event, 'time') AS outcome, f.t AS event_step FROM ps LEFT JOIN f ON f.series_id = ps.series_id AND f.sim_id = ps.sim_id AND k = 1"""
    return f"WITH pool AS ({pool}), " + text.replace("$pool", "pool")


def plain_sql(pool: str) -> str:
    """Sums of as many plain draws as the history has rows, in the oracle's SQL."""
    text = f"""{grid(DUCKDB)}, {uniform(DUCKDB, "g", "sim_id * n + t + 1", "series_id, n, sim_id, t", SEED + OTHER_SEED, "e")}
SELECT e.series_id, e.sim_id, sum(p.pnl) AS v FROM (SELECT series_id, sim_id, CAST(floor(u * n) AS BIGINT) AS idx FROM er5) e JOIN pool p ON p.series_id = e.series_id AND p.trade_idx = e.idx GROUP BY e.series_id, e.sim_id"""
    return f"WITH pool AS ({pool}), " + text.replace("$pool", "pool")


__all__ = ["PATHS", "PLANS", "paths_sql", "plain_sql"]
