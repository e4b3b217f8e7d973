"""Model validation: p-values, backtests, goodness of fit, and the report over them."""

from __future__ import annotations

from ..plans.engine import Plan, numbers
from .performance import CAPITAL
from .simulate import PATHS, SEED, draw, paths, uniform
from .stats import LAGS, LOG, D, ad_p, breaches, chi_square_upper, ecdf, kolmogorov, ljung_box, log_gamma, two_samples

#: Terms of the series of the incomplete gamma function, and the statistic from which a
#: tail of few degrees of freedom is 0 in a double.
TERMS, FAR = 300, 300
#: Rows of history that the rolling tests need, and bins of the calibration.
LEAST, BINS = 130, 10
#: Offset of the seed of the empirical sample.
OTHER_SEED = 7919


def upper_tail(d: str, name: str, source: str, keys: str, stat: str, df: str) -> str:
    """CTE ``name``: for each row of ``source`` (told apart by ``keys``) P(X > stat) of a
    chi-square law of any ``df``, by the series of the lower incomplete gamma function."""
    a, x = f"(CAST({df} AS DOUBLE) / 2)", f"(greatest({stat}, {D('1e-300')}) / 2)"
    term = f"exp(-{x} + ({a} + i) * ln({x}) - {log_gamma(f'({a} + i + 1)')})"
    return f"{name} AS (SELECT {keys}, CASE WHEN max({stat}) <= 0 THEN {D(1)} WHEN max({stat}) > {FAR} THEN {D(0)} ELSE greatest({D(0)}, 1 - sum({term})) END AS p FROM {source} CROSS JOIN {numbers(d, TERMS)} terms GROUP BY {keys})"


def verdict(*p: str) -> str:
    """fail below 0.01 in any, warn below 0.05."""
    return f"CASE WHEN {' OR '.join(f'{x} < {D(0.01)}' for x in p)} THEN 'fail' WHEN {' OR '.join(f'{x} < {D(0.05)}' for x in p)} THEN 'warn' ELSE 'pass' END"


def backtest(d: str) -> str:
    """CTE ``bt``: coverage and independence of the breaches, with p-values."""
    kupiec = f"greatest({D(0)}, -2 * (x * ln(1 - {D('0.95')}) + (n - x) * ln({D('0.95')}) - {LOG('x', '(x / n)')} - {LOG('(n - x)', '(1 - x / n)')}))"
    independence = f"CASE WHEN n < 2 OR q <= 0 OR q >= 1 THEN {D(0)} ELSE greatest({D(0)}, -2 * ({LOG('(n00 + n10)', '(1 - q)')} + {LOG('(n01 + n11)', 'q')} - {LOG('n00', '(1 - q01)')} - {LOG('n01', 'q01')} - {LOG('n10', '(1 - q11)')} - {LOG('n11', 'q11')})) END"
    count = lambda a, b: f"CAST(sum(CASE WHEN b = {a} AND breach = {b} THEN 1 ELSE 0 END) AS DOUBLE) AS n{a}{b}"
    return f"""{breaches(d)}, bl AS (SELECT *, lag(breach) OVER (PARTITION BY series_id ORDER BY trade_idx) AS b FROM br),
bc AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(breach) AS DOUBLE) AS x, {count(0, 0)}, {count(0, 1)}, {count(1, 0)}, {count(1, 1)} FROM bl GROUP BY series_id),
bq AS (SELECT *, CASE WHEN n > 1 THEN (n01 + n11) / (n - 1) ELSE 0 END AS q, CASE WHEN n00 + n01 > 0 THEN n01 / (n00 + n01) ELSE 0 END AS q01, CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) ELSE 0 END AS q11 FROM bc WHERE n >= {LEAST} - 100),
bs AS (SELECT *, {kupiec} AS kupiec_lr, {independence} AS independence_lr FROM bq),
{upper_tail(d, "bk", "bs", "series_id", "kupiec_lr", "1")}, {upper_tail(d, "bi", "bs", "series_id", "independence_lr", "1")},
bt AS (SELECT bs.series_id, n, x, kupiec_lr, bk.p AS kupiec_p, independence_lr, bi.p AS independence_p, {verdict("bk.p", "bi.p")} AS verdict FROM bs JOIN bk ON bk.series_id = bs.series_id JOIN bi ON bi.series_id = bs.series_id)"""


def calibration(d: str) -> str:
    """CTE ``pc``: uniformity of the ranks of each trade among those before it."""
    return f"""{ecdf(d)}, cb AS (SELECT series_id, least(CAST({BINS - 1} AS BIGINT), CAST(floor(u * {BINS}) AS BIGINT)) AS bin, count(*) AS n FROM u GROUP BY 1, 2),
ct AS (SELECT series_id, sum(n) AS total FROM cb GROUP BY series_id), ca AS (SELECT ct.series_id, i AS bin, CAST(total AS DOUBLE) / {BINS} AS expected FROM ct CROSS JOIN {numbers(d, BINS)} bins WHERE total >= {LEAST} - 100),
cs AS (SELECT ca.series_id, sum(power(coalesce(cb.n, 0) - expected, 2) / expected) AS chi2 FROM ca LEFT JOIN cb ON cb.series_id = ca.series_id AND cb.bin = ca.bin GROUP BY ca.series_id),
{upper_tail(d, "cp", "cs", "series_id", "chi2", str(BINS - 1))}, pc AS (SELECT cs.series_id, chi2, p, {verdict("p")} AS verdict FROM cs JOIN cp ON cp.series_id = cs.series_id)"""


def fit_of_paths(d: str, reduced: bool = False) -> str:
    """CTE ``gf``: final results of simulated paths against sums of as many plain draws; or, if
    ``reduced``, of ``$paths`` against ``$plain``, a row a path, which kernels have made."""
    if reduced:
        head = "ps AS (SELECT series_id, sim_id, final_balance FROM $paths), es AS (SELECT series_id, sim_id, v FROM $plain)"
    else:
        head = f"""{paths(d, "bootstrap")}, {uniform(d, "g", "sim_id * n + t + 1", "series_id, n, sim_id, t", SEED + OTHER_SEED, "e")},
es AS (SELECT e.series_id, e.sim_id, sum(p.pnl) AS v FROM (SELECT series_id, sim_id, coalesce(CAST(floor(u * n) AS BIGINT), 0) AS idx FROM er5) e JOIN $pool p ON p.series_id = e.series_id AND p.trade_idx = e.idx GROUP BY e.series_id, e.sim_id)"""
    return f"""{head},
sa AS (SELECT series_id, round(final_balance - {CAPITAL}, 6) AS v, 0 AS s, sim_id AS k FROM ps UNION ALL SELECT series_id, round(v, 6), 1, sim_id FROM es),
{two_samples("sa", "k")}, gk AS (SELECT series_id, max(abs(CAST(i AS DOUBLE) / n - CAST(j AS DOUBLE) / m)) AS d, max(sqrt(CAST(n AS DOUBLE) * m / (n + m))) AS en,
  sum(CASE WHEN k < n + m THEN power(CAST(i AS DOUBLE) * (n + m) - CAST(n AS DOUBLE) * k, 2) / (CAST(k AS DOUBLE) * greatest(1, n + m - k)) ELSE 0 END) / max(CAST(n AS DOUBLE) * m) AS a2 FROM o GROUP BY series_id),
gp AS (SELECT gk.series_id, d, (en + {D('0.12')} + {D('0.11')} / en) * d AS lam, a2 FROM gk JOIN (SELECT series_id FROM n WHERE n >= 10) h ON h.series_id = gk.series_id),
gq AS (SELECT series_id, d, {kolmogorov("lam")} AS ks_p, a2, {ad_p("a2")} AS ad_p FROM gp),
gf AS (SELECT *, CASE WHEN ks_p < {D(0.01)} OR ad_p <= {D(0.01)} THEN 'fail' WHEN ks_p < {D(0.05)} OR ad_p <= {D(0.05)} THEN 'warn' ELSE 'pass' END AS verdict FROM gq)"""


def dependence(d: str, drawn: bool = True) -> str:
    """CTE ``sd``: whether the first simulated path has the serial structure of history."""
    head = draw(d, "bootstrap") + ", " if drawn else ""
    return f"""{head}fp AS (SELECT dr.series_id, t AS trade_idx, p.pnl FROM dr JOIN $pool p ON p.series_id = dr.series_id AND p.trade_idx = dr.idx WHERE sim_id = 0),
{ljung_box(d, "$pool", "h")}, {ljung_box(d, "fp", "s")},
sd AS (SELECT series_id, hq, hp, sq, sp, CASE WHEN (hp < {D(0.05)}) <> (sp < {D(0.05)}) THEN 'warn' ELSE 'pass' END AS verdict FROM (SELECT hlb.series_id, hlb.q AS hq, {chi_square_upper("hlb.q", LAGS)} AS hp, slb.q AS sq, {chi_square_upper("slb.q", LAGS)} AS sp FROM hlb JOIN slb ON slb.series_id = hlb.series_id WHERE hlb.n >= 30) x)"""


def _report(d: str, reduced: bool = False) -> str:
    parts = ("goodness_of_fit", "gf"), ("serial_dependence", "sd"), ("var_backtest", "bt"), ("calibration", "pc")
    joins = " ".join(f"LEFT JOIN {cte} ON {cte}.series_id = ids.series_id" for _, cte in parts)
    any_of = lambda v: " OR ".join(f"coalesce({cte}.verdict, '') = '{v}'" for _, cte in parts)
    simulated = f"{dependence(d)}, {fit_of_paths(d, True)}" if reduced else f"{fit_of_paths(d)}, {dependence(d, False)}"
    return f"""WITH {simulated}, {backtest(d)}, {calibration(d)}, ids AS (SELECT DISTINCT series_id FROM $trades)
SELECT ids.series_id, {", ".join(f"coalesce({cte}.verdict, 'not run') AS {name}" for name, cte in parts)}, CASE WHEN {any_of("fail")} THEN 'fail' WHEN {any_of("warn")} THEN 'warn' ELSE 'pass' END AS overall FROM ids {joins}"""


BOTH = {"trades": "single", "pool": "single"}
PLANS = {
    "gamma_p": Plan(lambda d: f"WITH x AS (SELECT series_id, trade_idx, abs(pnl) AS x, trade_idx % 9 + 1 AS df FROM $trades), {upper_tail(d, 't', 'x', 'series_id, trade_idx, x, df', 'x', 'df')} SELECT series_id, trade_idx, df, round(x, 6) AS x, round(1 - p, 8) AS gamma_p, round(p, 8) AS upper FROM t"),
    "var_backtest": Plan(lambda d: f"WITH {backtest(d)} SELECT series_id, n AS observations, x AS breaches, round(n * (1 - {D('0.95')}), 6) AS expected, round(kupiec_lr, 6) AS kupiec_lr, round(kupiec_p, 6) AS kupiec_p, round(independence_lr, 6) AS independence_lr, round(independence_p, 6) AS independence_p, verdict FROM bt", {"trades": "single"}),
    "pit_report": Plan(lambda d: f"WITH {breaches(d)}, {calibration(d)} SELECT series_id, round(chi2, 6) AS chi2, round(p, 6) AS p, verdict FROM pc", {"trades": "single"}),
    "serial_dependence": Plan(lambda d: f"WITH {dependence(d)} SELECT series_id, round(hq, 6) AS empirical_q, round(hp, 6) AS empirical_p, round(sq, 6) AS simulated_q, round(sp, 6) AS simulated_p, verdict FROM sd", {"pool": "single"}),
    "validation_report": Plan(_report, BOTH),
}
#: The report of registered runs, over the kernels' paths: no step of a path is a row.
REDUCED = {"validation_report": Plan(lambda d: _report(d, True), BOTH | {"paths": "single_paths", "plain": "single_plain"})}

__all__ = ["PATHS", "PLANS"]
