"""Calendar, attribution, correlation, tail and validation statistics."""

from __future__ import annotations

from ..plans.engine import SPARK, Plan
from ..plans.scans import BLOCK, scan

D = lambda x: f"CAST('{x}' AS DOUBLE)"

#: Coefficients of the normal distribution function (Abramowitz and Stegun 26.2.17).
NORMAL = ("0.319381530", "-0.356563782", "1.781477937", "-1.821255978", "1.330274429")


def normal_cdf(x: str) -> str:
    """P(Z <= x) for a column expression without side effects."""
    t = f"(1 / (1 + {D('0.2316419')} * abs({x})))"
    poly = D(NORMAL[-1])
    for c in reversed(NORMAL[:-1]):
        poly = f"({D(c)} + {t} * {poly})"
    upper = f"(exp(-0.5 * {x} * {x}) / sqrt(2 * pi()) * {t} * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {upper} ELSE {upper} END)"


def two_sided(t: str) -> str:
    return f"(2 * (1 - {normal_cdf(f'abs({t})')}))"


def chi_square_upper(x: str, df: int) -> str:
    """P(X > x) for an even ``df``: a finite sum."""
    term = " + ".join(f"power({x} / 2, {i}) / {D(f'{__import__("math").factorial(i)}.0')}" for i in range(df // 2))
    return f"(CASE WHEN {x} <= 0 THEN CAST(1 AS DOUBLE) ELSE exp(-{x} / 2) * ({term}) END)"


def kolmogorov(x: str) -> str:
    term = " + ".join(f"({2 if k % 2 else -2}) * exp(-2 * {k * k} * {x} * {x})" for k in range(1, 101))
    return f"(CASE WHEN {x} <= 0 THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {term})) END)"


#: Anderson-Darling statistic and p-value at the knots of the table.
AD_TABLE = ((0.0, 1.0), (1.933, 0.10), (2.492, 0.05), (3.070, 0.025), (3.878, 0.01), (10.0, 0.001))


def ad_p(x: str) -> str:
    cases = "".join(f" WHEN {x} < {D(b)} THEN {D(p)} + ({x} - {D(a)}) / ({D(b)} - {D(a)}) * ({D(q)} - {D(p)})" for (a, p), (b, q) in zip(AD_TABLE, AD_TABLE[1:], strict=False))
    return f"(CASE WHEN {x} <= 0 THEN CAST(1 AS DOUBLE){cases} ELSE {D(AD_TABLE[-1][1])} END)"


def islands(sign: str) -> str:
    """Subquery: the longest run of days of one sign, for each series."""
    return f"(SELECT series_id, max(n) AS n FROM (SELECT series_id, count(*) AS n FROM (SELECT series_id, d - row_number() OVER (PARTITION BY series_id, CASE WHEN pnl {sign} 0 THEN 1 ELSE 0 END ORDER BY d) AS island, pnl FROM nd) x WHERE pnl {sign} 0 GROUP BY series_id, island) y GROUP BY series_id)"


#: Loss of a day that counts as a breach of the limit, and trades with a time that a report needs.
DAY_LIMIT, TIMED = 100000, 5
DAILY = "daily AS (SELECT series_id, CAST(ts AS DATE) AS day, sum(pnl) AS pnl, count(*) AS trades FROM $trades GROUP BY series_id, CAST(ts AS DATE))"
#: Rank from 0 in ascending order and count, for order statistics by position.
RANKED = "rk AS (SELECT series_id, pnl, row_number() OVER (PARTITION BY series_id ORDER BY pnl, trade_idx) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM $trades)"


def position(share: str) -> str:
    return f"least(n - 1, greatest(0, CAST(floor(n * {share}) AS BIGINT)))"


LAGS = 10


def acf(d: str, source: str = "$trades", tag: str = "") -> str:
    """CTE ``acf`` (with ``tag`` before it): the first LAGS autocorrelations of each series. On
    Spark rows are numbered and dealt to blocks, each with the first rows of the next one, and
    all lags are looked at in one pass, so no task holds a series."""
    head = f"""{tag}m AS (SELECT series_id, avg(pnl) AS mu, count(*) AS n FROM {source} GROUP BY series_id),
{tag}c AS (SELECT t.series_id, trade_idx, pnl - mu AS e, m.n FROM {source} t JOIN {tag}m m ON t.series_id = m.series_id)"""
    if d == SPARK:
        lags = range(1, LAGS + 1)
        return f"""{head}, {scan(d, f"{tag}nr", f"{tag}c", "series_id", "e, n", {"i": ("sum", "CAST(1 AS BIGINT)")})},
{tag}ov AS (SELECT series_id, n, e, i, CAST(floor(i / {BLOCK}) AS BIGINT) AS own, explode(CASE WHEN i % {BLOCK} < {LAGS} THEN array(CAST(floor(i / {BLOCK}) AS BIGINT), CAST(floor(i / {BLOCK}) AS BIGINT) - 1) ELSE array(CAST(floor(i / {BLOCK}) AS BIGINT)) END) AS piece FROM {tag}nr),
{tag}ld AS (SELECT series_id, n, e, own = piece AS own{"".join(f", lead(e, {k}) OVER w AS e{k}" for k in lags)} FROM {tag}ov WINDOW w AS (PARTITION BY series_id, piece ORDER BY i)),
{tag}su AS (SELECT series_id, n, sum(e * e) AS q{"".join(f", sum(e * e{k}) AS p{k}" for k in lags)} FROM {tag}ld WHERE own GROUP BY series_id, n),
{tag}acf AS (SELECT series_id, k, n, CASE WHEN q > 0 THEN coalesce(p, 0) / q ELSE 0 END AS rho FROM (SELECT series_id, n, q, stack({LAGS}, {", ".join(f"CAST({k} AS BIGINT), p{k}" for k in lags)}) AS (k, p) FROM {tag}su) x)"""
    return f"""{head},
{tag}lagged AS ({" UNION ALL ".join(f"SELECT series_id, CAST({k} AS BIGINT) AS k, n, e * lead(e, {k}) OVER (PARTITION BY series_id ORDER BY trade_idx) AS p, e * e AS q FROM {tag}c" for k in range(1, LAGS + 1))}),
{tag}acf AS (SELECT series_id, k, n, CASE WHEN sum(q) > 0 THEN coalesce(sum(p), 0) / sum(q) ELSE 0 END AS rho FROM {tag}lagged GROUP BY series_id, k, n)"""


def ljung_box(d: str, source: str = "$trades", tag: str = "") -> str:
    """CTE ``lb`` (with ``tag`` before it): the Ljung-Box statistic of each series."""
    return f"{acf(d, source, tag)}, {tag}lb AS (SELECT series_id, max(n) AS n, max(n) * (max(n) + {D(2)}) * sum(rho * rho / greatest(1, n - k)) AS q FROM {tag}acf GROUP BY series_id)"



BREACH_WINDOW = 100
POSITION = f"floor({BREACH_WINDOW} * (1 - {D('0.95')}))"


def breaches(d: str) -> str:
    """CTEs ``pr``: each trade with the BREACH_WINDOW before it, and ``br``: whether it
    falls below their VaR95. On Spark a frame, in the oracle a join, of the same rows."""
    if d == SPARK:
        return f"""pr AS (SELECT * FROM (SELECT series_id, trade_idx, pnl, collect_list(pnl) OVER (PARTITION BY series_id ORDER BY trade_idx ROWS BETWEEN {BREACH_WINDOW} PRECEDING AND 1 PRECEDING) AS past FROM $trades) x WHERE trade_idx >= {BREACH_WINDOW}),
br AS (SELECT series_id, trade_idx, CASE WHEN pnl < sort_array(past)[CAST({POSITION} AS INT)] THEN 1 ELSE 0 END AS breach FROM pr)"""
    return f"""pr AS (SELECT a.series_id, a.trade_idx, a.pnl, b.pnl AS past, row_number() OVER (PARTITION BY a.series_id, a.trade_idx ORDER BY b.pnl, b.trade_idx) - 1 AS r
  FROM $trades a JOIN $trades b ON a.series_id = b.series_id AND b.trade_idx >= a.trade_idx - {BREACH_WINDOW} AND b.trade_idx < a.trade_idx WHERE a.trade_idx >= {BREACH_WINDOW}),
br AS (SELECT series_id, trade_idx, CASE WHEN pnl < past THEN 1 ELSE 0 END AS breach FROM pr WHERE r = CAST({POSITION} AS BIGINT))"""


def ecdf(d: str) -> str:
    """CTE ``u``: the share of the window at or below each trade, less half a step."""
    count, group = ("size(filter(past, v -> v <= pnl))", "") if d == SPARK else ("sum(CASE WHEN past <= pnl THEN 1 ELSE 0 END)", " GROUP BY series_id, trade_idx")
    return f"u AS (SELECT series_id, trade_idx, greatest(CAST(0 AS DOUBLE), ({count} - {D('0.5')}) / {BREACH_WINDOW}) AS u FROM pr{group})"


LOG = lambda n, p: f"(CASE WHEN {p} > 0 THEN {n} * ln(CASE WHEN {p} > 0 THEN {p} ELSE 1 END) ELSE 0 END)"

GPD_Q = "0.9"
GPD = f"""so AS (SELECT series_id, pnl, row_number() OVER (PARTITION BY series_id ORDER BY pnl) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM $trades WHERE pnl > 0),
th AS (SELECT series_id, n, pnl AS u FROM so WHERE r = least(n - 2, greatest(1, CAST(floor(n * {D(GPD_Q)}) AS BIGINT)))),
ex AS (SELECT so.series_id, th.n, u, pnl - u AS e, row_number() OVER (PARTITION BY so.series_id ORDER BY pnl) AS i, count(*) OVER (PARTITION BY so.series_id) AS nu FROM so JOIN th ON so.series_id = th.series_id WHERE pnl > u),
pw AS (SELECT series_id, n, u, nu, avg(e) AS m, avg(e * (1 - (i - {D("0.35")}) / nu)) AS a1 FROM ex GROUP BY series_id, n, u, nu),
gp AS (SELECT *, 2 - m / (m - 2 * a1) AS xi, 2 * m * a1 / (m - 2 * a1) AS beta FROM pw WHERE n >= 50 AND nu >= 25 AND m <> 2 * a1)"""


#: The Hill estimate over the largest tenth of the losses, 20 to 250 of them: null for fewer
#: than 20 losses, or no more than those, and if they are equal, but for rounding.
HILL = f"""ho AS (SELECT series_id, pnl, row_number() OVER (PARTITION BY series_id ORDER BY pnl DESC) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM $trades WHERE pnl > 0),
hk AS (SELECT *, CASE WHEN n < 20 THEN 0 ELSE greatest(20, least(250, CAST(floor(n / {D(10)}) AS BIGINT))) END AS k FROM ho),
hm AS (SELECT series_id, max(n) AS n, max(k) AS k, avg(CASE WHEN r <= k THEN ln(pnl) END) AS top, max(CASE WHEN r = k + 1 THEN ln(pnl) END) AS edge FROM hk GROUP BY series_id),
hi AS (SELECT i.series_id, coalesce(k, 0) AS k, CASE WHEN k > 0 AND k < n AND top - edge > {D("1e-12")} * greatest({D(1)}, abs(edge)) THEN 1 / (top - edge) END AS alpha FROM (SELECT DISTINCT series_id FROM $trades) i LEFT JOIN hm ON hm.series_id = i.series_id)"""


def evt_var(p: str) -> str:
    ratio = f"(CAST(n AS DOUBLE) / nu * (1 - {D(p)}))"
    return f"(CASE WHEN abs(xi) < {D('1e-6')} THEN u - beta * ln({ratio}) ELSE u + beta / xi * (power({ratio}, -xi) - 1) END)"


PAIRED = "pr AS (SELECT series_id, pnl AS y, benchmark AS x FROM $trades WHERE benchmark IS NOT NULL)"
#: Sums of squares below this share of those about 0 are rounding: the column does not vary.
ROUNDING = D("1e-20")
OLS = f"""{PAIRED}, s AS (SELECT series_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x) AS sx, sum(x * x) AS sxx, sum(y * y) AS syy FROM pr GROUP BY series_id),
b0 AS (SELECT pr.series_id, sum((x - mx) * (x - mx)) AS cxx, sum((x - mx) * (y - my)) AS cxy, sum((y - my) * (y - my)) AS cyy FROM pr JOIN s ON pr.series_id = s.series_id GROUP BY pr.series_id),
b AS (SELECT b0.series_id, cxx, cyy, cxx > {ROUNDING} * sxx AS moves, cyy > {ROUNDING} * syy AS varies, CASE WHEN cxx > {ROUNDING} * sxx THEN cxy / cxx ELSE 0 END AS beta FROM b0 JOIN s ON s.series_id = b0.series_id),
co AS (SELECT s.*, beta, my - beta * mx AS alpha, moves, varies, cyy, CASE WHEN moves THEN n * cxx END AS det FROM s JOIN b ON s.series_id = b.series_id),
re AS (SELECT co.series_id, sum((y - alpha - beta * x) * (y - alpha - beta * x)) AS rss, sum((y - alpha - beta * x) * (y - alpha - beta * x) * x) AS s12, sum((y - alpha - beta * x) * (y - alpha - beta * x) * x * x) AS s22 FROM pr JOIN co ON pr.series_id = co.series_id GROUP BY co.series_id),
vw AS (SELECT co.*, rss, CASE WHEN varies THEN 1 - rss / CASE WHEN varies THEN cyy ELSE 1 END ELSE 0 END AS r2, CASE WHEN rss > {ROUNDING} * syy THEN (sxx * sxx * rss - 2 * sxx * sx * s12 + sx * sx * s22) / (det * det) END AS va, CASE WHEN rss > {ROUNDING} * syy THEN (sx * sx * rss - 2 * n * sx * s12 + CAST(n AS DOUBLE) * n * s22) / (det * det) END AS vb FROM co JOIN re ON co.series_id = re.series_id),
vv AS (SELECT *, CASE WHEN va > 0 THEN sqrt(CASE WHEN va > 0 THEN va ELSE 1 END) END AS sa, CASE WHEN vb > 0 THEN sqrt(CASE WHEN vb > 0 THEN vb ELSE 1 END) END AS sb FROM vw)"""


def two_samples(source: str, last: str) -> str:
    """CTE ``o``: how many of each sample ``s`` (0 or 1) stand up to each value ``v``."""
    return f"""o AS (SELECT series_id, s, sum(1 - s) OVER w AS i, sum(s) OVER w AS j, row_number() OVER w AS k, sum(1 - s) OVER (PARTITION BY series_id) AS n, sum(s) OVER (PARTITION BY series_id) AS m FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY v, s, {last} ROWS UNBOUNDED PRECEDING))"""


TWO_SAMPLES = f"sa AS (SELECT series_id, pnl AS v, CASE WHEN regime < 'm' THEN 0 ELSE 1 END AS s, trade_idx FROM $trades), {two_samples('sa', 'trade_idx')}"

#: Lanczos coefficients for g = 7.
LANCZOS = ("0.99999999999980993", "676.5203681218851", "-1259.1392167224028", "771.32342877765313", "-176.61502916214059", "12.507343278686905", "-0.13857109526572012", "9.9843695780195716e-6", "1.5056327351493116e-7")


def log_gamma(x: str) -> str:
    """ln(gamma(x)) for x >= 0.5."""
    z = f"({x} - 1)"
    series = D(LANCZOS[0]) + "".join(f" + {D(c)} / ({z} + {i})" for i, c in enumerate(LANCZOS[1:], 1))
    return f"({D('0.9189385332046727')} + ({z} + 0.5) * ln({z} + 7.5) - ({z} + 7.5) + ln({series}))"


def log_gamma_any(x: str) -> str:
    """ln(abs(gamma(x))), below 0.5 by reflection; null at its poles."""
    low = f"(CASE WHEN sin(pi() * {x}) <> 0 THEN ln(pi() / abs(CASE WHEN sin(pi() * {x}) <> 0 THEN sin(pi() * {x}) ELSE 1 END)) - {log_gamma(f'greatest(1 - {x}, {D(0.5)})')} END)"
    return f"(CASE WHEN {x} < 0.5 THEN {low} ELSE {log_gamma(f'greatest({x}, {D(0.5)})')} END)"


def student_t_cdf(x: str, df: str) -> str:
    """P(T <= x) as the normal distribution function of x drawn in for ``df``; 0.5 if
    there are no degrees of freedom, and for two or fewer no drawing in is defined."""
    return f"(CASE WHEN {df} <= 0 THEN {D(0.5)} WHEN {df} > 2 THEN {normal_cdf(f'({x} * sqrt((greatest({df}, {D(2)}) - 2) / greatest({df}, {D(2)})) * (1 + 1 / (4 * greatest({df}, {D(2)}))))')} END)"


#: Steps of the continued fraction of the incomplete beta function.
FRACTION = 24


def student_t_exact(d: str, x: str, df: str) -> str:
    """P(T <= x) for any ``df`` above 0, by the incomplete beta function: a continued fraction
    of fixed length, from its end, on the side where it converges."""
    a, z = f"({df} / 2)", f"({df} / ({df} + {x} * {x}))"
    swap = f"({z} > ({a} + 1) / ({a} + {D('2.5')}))"
    p, q = f"(CASE WHEN {swap} THEN {D('0.5')} ELSE {a} END)", f"(CASE WHEN {swap} THEN {a} ELSE {D('0.5')} END)"
    y, left = f"greatest({D('1e-300')}, CASE WHEN {swap} THEN 1 - {z} ELSE {z} END)", f"greatest({D('1e-300')}, CASE WHEN {swap} THEN {z} ELSE 1 - {z} END)"
    odd = f"(-({p} + m) * ({p} + {q} + m) * {y} / (({p} + 2 * m) * ({p} + 2 * m + 1)))"
    even = f"((m + 1) * ({q} - m - 1) * {y} / (({p} + 2 * m + 1) * ({p} + 2 * m + 2)))"
    step = f"1 + {odd} / (1 + {even} / f)"
    fraction = f"aggregate(sequence({FRACTION - 1}, 0, -1), {D(1)}, (f, m) -> {step})" if d == SPARK else f"list_reduce(range({FRACTION - 1}, -1, -1), lambda f, m: {step}, {D(1)})"
    gammas = f"({log_gamma(f'({a} + {D(0.5)})')} - {log_gamma(f'({a} + 1)')} + ln({a}) - {D('0.5723649429247001')})"
    beta = f"(exp({gammas} + {p} * ln({y}) + {q} * ln({left})) / {p} / {fraction})"
    tail = f"(CASE WHEN {swap} THEN 1 - {beta} ELSE {beta} END / 2)"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def t_log_pdf(x: str, mu: str, sigma: str, df: str) -> str:
    return f"({log_gamma(f'(({df} + 1) / 2)')} - {log_gamma(f'({df} / 2)')} - 0.5 * ln({df} * pi()) - ln({sigma}) - ({df} + 1) / 2 * ln(1 + power(({x} - {mu}) / {sigma}, 2) / {df}))"


FITS = f"""m AS (SELECT series_id, count(*) AS n, avg(pnl) AS mu, greatest(stddev_pop(pnl), {D("1e-10")}) AS sd FROM $trades GROUP BY series_id),
no AS (SELECT m.series_id, n, mu, sd AS sigma, sum(-0.5 * ln(2 * pi()) - ln(sd) - 0.5 * power((pnl - mu) / sd, 2)) AS ll FROM $trades t JOIN m ON t.series_id = m.series_id GROUP BY m.series_id, n, mu, sd),
gr AS (SELECT CAST(column0 AS DOUBLE) AS df FROM (VALUES {", ".join(f"({1 + i / 2})" for i in range(59))}) AS g(column0)),
pr AS (SELECT m.*, df, CASE WHEN df > 2 THEN sd * sqrt((df - 2) / df) ELSE sd END AS sigma FROM m CROSS JOIN gr),
tt AS (SELECT pr.series_id, n, mu, df, sigma, {log_gamma("((df + 1) / 2)")} - {log_gamma("(df / 2)")} - 0.5 * ln(df * pi()) - ln(sigma) AS head FROM pr),
tl AS (SELECT tt.series_id, tt.n, tt.mu, df, sigma, n * head - sum((df + 1) / 2 * ln(1 + power((pnl - mu) / sigma, 2) / df)) AS ll FROM tt JOIN $trades t ON t.series_id = tt.series_id GROUP BY tt.series_id, tt.n, tt.mu, df, sigma, head),
tb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(ll, 7) DESC, df) AS k FROM tl) x WHERE k = 1)"""
AIC = lambda k: f"round(-2 * ll + 2 * {k}, 4) AS aic, round(-2 * ll + {k} * ln(n), 4) AS bic"



def _special(student: str, any_df: str, kolmogorov_q: str) -> str:
    """The functions of each ``x``, given the dear ones."""
    return f"SELECT series_id, trade_idx, round({log_gamma("x")}, 8) + {D(0)} AS log_gamma, round({log_gamma_any('(x / 7 - 3.01)')}, 6) AS log_gamma_reflected, round({student_t_cdf('(x - 3)', D(5))}, 9) AS student_t_cdf_crude, round({student}, 9) AS student_t_cdf, round({any_df}, 8) AS student_t_any, round({normal_cdf('(x / 3)')}, 10) AS normal_cdf, round({kolmogorov_q}, 8) AS kolmogorov_q, round({ad_p('x')}, 8) AS ad_p, round({chi_square_upper('x', 10)}, 8) AS chi_square_upper, round({two_sided('x')}, 8) AS two_sided, round({t_log_pdf('x', '1', '2', D(5))}, 8) AS t_log_pdf FROM x"


#: On Spark the dear functions come from ``simulate.special_columns``, a batch at a time.
REDUCED = {"special_functions": Plan(f"WITH x AS (SELECT series_id, at AS trade_idx, x, student, any_df, kolmogorov FROM $x) {_special('student', 'any_df', 'kolmogorov')}", {"x": "x"})}
PLANS = {
    "daily_aggregate": Plan(f"WITH {DAILY} SELECT series_id, CAST(day AS STRING) AS day, round(pnl, 2) AS pnl, trades FROM daily", {"trades": "days"}),
    "calendar_report": Plan(f"""WITH {DAILY}, nd AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS d FROM daily),
ag AS (SELECT series_id, count(*) AS trading_days, CAST(sum(trades) AS BIGINT) AS total_trades, CAST(sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS BIGINT) AS win_days, CAST(sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_days,
  max(pnl) AS best, min(pnl) AS worst, avg(pnl) AS mean, coalesce(stddev_samp(pnl), 0) AS std, CAST(sum(CASE WHEN pnl <= -{DAY_LIMIT} THEN 1 ELSE 0 END) AS BIGINT) AS limit_breaches FROM nd GROUP BY series_id)
SELECT ag.series_id, trading_days, total_trades, win_days, loss_days, round(best, 2) AS best, CAST(b.day AS STRING) AS best_day, round(worst, 2) AS worst, CAST(w.day AS STRING) AS worst_day, round(mean, 2) AS mean, round(std, 2) AS std,
  round(CASE WHEN std > 0 THEN mean / std * sqrt({D(252)}) ELSE 0 END, 6) AS sharpe, coalesce(ws.n, 0) AS win_streak, coalesce(ls.n, 0) AS loss_streak, limit_breaches
FROM ag JOIN (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY round(pnl, 6) DESC, day) AS k FROM nd) b ON b.series_id = ag.series_id AND b.k = 1
JOIN (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY round(pnl, 6), day) AS k FROM nd) w ON w.series_id = ag.series_id AND w.k = 1
LEFT JOIN {islands(">")} ws ON ws.series_id = ag.series_id LEFT JOIN {islands("<")} ls ON ls.series_id = ag.series_id WHERE total_trades >= {TIMED}""", {"trades": "days"}),
    "day_of_week": Plan(lambda d: f"WITH {DAILY}, w AS (SELECT series_id, {'dayofweek(day) - 1' if d == 'spark' else 'CAST(dayofweek(day) AS INTEGER)'} AS dow, pnl FROM daily) SELECT series_id, dow, count(*) AS days, round(sum(pnl), 2) AS total_pnl, round(avg(pnl), 2) AS avg_pnl, round({D(100)} * sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) / count(*), 6) AS win_rate FROM w GROUP BY series_id, dow", {"trades": "days"}),
    "value_at_risk": Plan(f"""WITH {RANKED} SELECT series_id, round(max(CASE WHEN r = {position("(1 - " + D("0.95") + ")")} THEN pnl END), 6) AS var95, round(max(CASE WHEN r = {position("(1 - " + D("0.99") + ")")} THEN pnl END), 6) AS var99,
  round(avg(CASE WHEN r < greatest(1, CAST(floor(n * (1 - {D("0.95")})) AS BIGINT)) THEN pnl END), 6) AS cvar95, round(avg(CASE WHEN r < greatest(1, CAST(floor(n * (1 - {D("0.99")})) AS BIGINT)) THEN pnl END), 6) AS cvar99, round(max(CASE WHEN r = {position(D("0.5"))} THEN pnl END), 6) AS median FROM rk GROUP BY series_id"""),
    "moments": Plan("WITH m AS (SELECT series_id, avg(pnl) AS mu FROM $trades GROUP BY series_id), c AS (SELECT t.series_id, count(*) AS n, avg(power(pnl - mu, 2)) AS m2, avg(power(pnl - mu, 3)) AS m3, avg(power(pnl - mu, 4)) AS m4 FROM $trades t JOIN m ON t.series_id = m.series_id GROUP BY t.series_id) SELECT series_id, round(CASE WHEN n >= 3 AND m2 > 0 THEN m3 / power(m2, 1.5) ELSE 0 END, 6) AS skewness, round(CASE WHEN n >= 4 AND m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END, 6) AS excess_kurtosis FROM c"),
    "histogram": Plan("WITH b AS (SELECT series_id, min(pnl) AS lo, (max(pnl) - min(pnl)) / 30 AS w FROM $trades GROUP BY series_id), g AS (SELECT CAST(column0 AS BIGINT) AS bin FROM (VALUES " + ", ".join(f"({i})" for i in range(30)) + ") AS g(column0)), h AS (SELECT t.series_id, CASE WHEN w > 0 THEN least(CAST(floor((pnl - lo) / w) AS BIGINT), 29) ELSE 0 END AS bin, count(*) AS n FROM $trades t JOIN b ON t.series_id = b.series_id GROUP BY 1, 2) SELECT b.series_id, g.bin, round(lo + g.bin * w, 6) AS lower, coalesce(n, 0) AS n FROM b CROSS JOIN g LEFT JOIN h ON h.series_id = b.series_id AND h.bin = g.bin"),
    "autocorrelation": Plan(lambda d: f"WITH {acf(d)} SELECT series_id, k, round(rho, 8) AS rho FROM acf"),
    "ljung_box": Plan(lambda d: f"WITH {ljung_box(d)} SELECT series_id, round(q, 6) AS q, round({chi_square_upper('q', LAGS)}, 6) AS p FROM lb"),
    "block_length": Plan(lambda d: f"WITH {acf(d)} SELECT series_id, round(rho, 8) AS rho, CAST(CASE WHEN abs(rho) < {D('0.05')} THEN 1 ELSE least(ceil(power(CAST(n AS DOUBLE), {D(1)} / 3)), greatest({D(1)}, floor(n / {D(4)}))) END AS BIGINT) AS block FROM acf WHERE k = 1"),
    "var_breaches": Plan(lambda d: f"WITH {breaches(d)} SELECT series_id, trade_idx, breach FROM br", {"trades": "single"}),
    "kupiec": Plan(lambda d: f"WITH {breaches(d)}, a AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(breach) AS DOUBLE) AS x FROM br GROUP BY series_id) SELECT series_id, n, x, round(-2 * (x * ln(1 - {D('0.95')}) + (n - x) * ln({D('0.95')}) - {LOG('x', '(x / n)')} - {LOG('(n - x)', '(1 - x / n)')}), 6) AS lr FROM a", {"trades": "single"}),
    "christoffersen": Plan(lambda d: f"""WITH {breaches(d)}, l AS (SELECT *, lag(breach) OVER (PARTITION BY series_id ORDER BY trade_idx) AS b FROM br),
c AS (SELECT series_id, CAST(sum(CASE WHEN b = 0 AND breach = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n00, CAST(sum(CASE WHEN b = 0 AND breach = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n01, CAST(sum(CASE WHEN b = 1 AND breach = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n10, CAST(sum(CASE WHEN b = 1 AND breach = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n11 FROM l WHERE b IS NOT NULL GROUP BY series_id),
p AS (SELECT *, (n01 + n11) / (n00 + n01 + n10 + n11) AS q, CASE WHEN n00 + n01 > 0 THEN n01 / (n00 + n01) ELSE 0 END AS q01, CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) ELSE 0 END AS q11 FROM c)
SELECT series_id, n00, n01, n10, n11, round(CASE WHEN q = 0 OR q = 1 THEN 0 ELSE -2 * ({LOG("(n00 + n10)", "(1 - q)")} + {LOG("(n01 + n11)", "q")} - {LOG("n00", "(1 - q01)")} - {LOG("n01", "q01")} - {LOG("n10", "(1 - q11)")} - {LOG("n11", "q11")}) END, 6) AS lr FROM p""", {"trades": "single"}),
    "pit_calibration": Plan(lambda d: f"WITH {breaches(d)}, {ecdf(d)} SELECT series_id, least(CAST(9 AS BIGINT), CAST(floor(u * 10) AS BIGINT)) AS bin, count(*) AS n FROM u GROUP BY 1, 2", {"trades": "single"}),
    # an empty sample: the greatest distance; with fewer than two values no AD statistic, and nothing to reject
    "ks_two_sample": Plan(f"WITH {TWO_SAMPLES}, d AS (SELECT series_id, coalesce(max(abs(CAST(i AS DOUBLE) / nullif(n, 0) - CAST(j AS DOUBLE) / nullif(m, 0))), {D(1)}) AS d, max(CASE WHEN n > 0 AND m > 0 THEN sqrt(CAST(n AS DOUBLE) * m / (n + m)) END) AS en FROM o GROUP BY series_id), l AS (SELECT *, (en + {D('0.12')} + {D('0.11')} / en) * d AS lam FROM d) SELECT series_id, round(d, 8) AS d, CASE WHEN lam IS NULL THEN 0 ELSE round({kolmogorov('lam')}, 6) END AS p FROM l", {"trades": "single"}),
    "ad_two_sample": Plan(f"WITH {TWO_SAMPLES}, a AS (SELECT series_id, CASE WHEN max(n) >= 2 AND max(m) >= 2 THEN sum(CASE WHEN k < n + m THEN power(CAST(i AS DOUBLE) * (n + m) - CAST(n AS DOUBLE) * k, 2) / (CAST(k AS DOUBLE) * greatest(1, n + m - k)) ELSE 0 END) / nullif(max(CAST(n AS DOUBLE) * m), 0) END AS a2 FROM o GROUP BY series_id) SELECT series_id, round(a2, 6) AS a2, CASE WHEN a2 IS NULL THEN 1 ELSE round({ad_p('a2')}, 6) END AS p FROM a", {"trades": "single"}),
    "hill_index": Plan(f"WITH {HILL} SELECT series_id, k, round(alpha, 6) AS alpha FROM hi", {"trades": "losses"}),
    "fit_gpd": Plan(f"WITH {GPD} SELECT series_id, n, nu, round(u, 6) AS threshold, round(xi, 6) AS xi, round(beta, 6) AS beta FROM gp", {"trades": "losses"}),
    "evt_report": Plan(f"""WITH {GPD}, {HILL}, v AS (SELECT *, {evt_var("0.95")} AS v95, {evt_var("0.99")} AS v99 FROM gp),
em AS (SELECT series_id, max(n) AS n, max(CASE WHEN r = {position(D("0.95"))} THEN pnl END) AS e95, max(CASE WHEN r = {position(D("0.99"))} THEN pnl END) AS e99, avg(CASE WHEN r >= greatest(1, CAST(floor(n * {D("0.95")}) AS BIGINT)) THEN pnl END) AS c95, avg(CASE WHEN r >= greatest(1, CAST(floor(n * {D("0.99")}) AS BIGINT)) THEN pnl END) AS c99 FROM so GROUP BY series_id)
SELECT em.series_id, round(v95, 5) AS var95, round(v99, 5) AS var99, round(CASE WHEN xi < 1 THEN (v95 + beta - xi * u) / (1 - CASE WHEN xi < 1 THEN xi ELSE 0 END) END, 5) AS cvar95, round(CASE WHEN xi < 1 THEN (v99 + beta - xi * u) / (1 - CASE WHEN xi < 1 THEN xi ELSE 0 END) END, 5) AS cvar99, round(e95, 5) AS empirical_var95, round(e99, 5) AS empirical_var99, round(c95, 5) AS empirical_cvar95, round(c99, 5) AS empirical_cvar99, round(alpha, 6) AS alpha, CASE WHEN coalesce(xi, 0) > {D("0.1")} OR coalesce(alpha, 99) < 4 THEN 1 ELSE 0 END AS heavy_tail, CASE WHEN xi IS NULL THEN 'too few losses for a fit: empirical values only' WHEN xi > {D("0.1")} OR coalesce(alpha, 99) < 4 THEN 'heavy tail' ELSE 'well-behaved tail' END AS note FROM em LEFT JOIN v ON v.series_id = em.series_id LEFT JOIN hi ON hi.series_id = em.series_id WHERE em.n >= 30""", {"trades": "losses"}),
    "ols_robust": Plan(f"WITH {OLS} SELECT series_id, n, round(alpha, 6) AS alpha, round(beta, 5) AS beta, round(r2, 8) AS r_squared, round(sa, 6) AS alpha_se, round(sb, 5) AS beta_se, round(alpha / sa, 6) AS alpha_t, round(beta / sb, 6) AS beta_t, CASE WHEN sa IS NOT NULL THEN round({two_sided('(alpha / sa)')}, 6) END AS alpha_p, CASE WHEN sb IS NOT NULL THEN round({two_sided('(beta / sb)')}, 6) END AS beta_p FROM vv WHERE n >= 3"),
    "attribution_report": Plan(f"""WITH {OLS}, ac AS (SELECT series_id, avg(y - x) AS ma, stddev_samp(y - x) * sqrt(least({D(252)}, CAST(count(*) AS DOUBLE))) AS te, coalesce(avg(CASE WHEN x > 0 THEN y END) / avg(CASE WHEN x > 0 THEN x END), 0) AS up, coalesce(avg(CASE WHEN x < 0 THEN y END) / avg(CASE WHEN x < 0 THEN x END), 0) AS down, covar_samp(x, y) AS cov, stddev_samp(x) AS dx, stddev_samp(y) AS dy FROM pr GROUP BY series_id)
SELECT vv.series_id, n, round(alpha * least(252, n), 4) AS alpha_annualized, round(beta, 5) AS beta, round(te, 5) AS tracking_error, round(CASE WHEN te > 0 THEN ma * least(252, n) / te ELSE 0 END, 6) AS information_ratio, round(up, 5) AS up_capture, round(down, 5) AS down_capture, round(CASE WHEN moves AND varies THEN cov / CASE WHEN moves AND varies THEN dx * dy ELSE 1 END ELSE 0 END, 8) AS correlation FROM vv JOIN ac ON vv.series_id = ac.series_id WHERE n >= 10"""),
    "fit_normal": Plan(f"WITH {FITS} SELECT series_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(ll, 4) AS log_likelihood, {AIC(2)} FROM no"),
    "fit_student_t": Plan(f"WITH {FITS} SELECT series_id, df, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(ll, 4) AS log_likelihood, {AIC(3)} FROM tb"),
    "fit_best": Plan(f"WITH {FITS}, a AS (SELECT series_id, 'normal' AS kind, 0 AS o, -2 * ll + 2 * ln(n) AS bic FROM no UNION ALL SELECT series_id, 'student_t', 1, -2 * ll + 3 * ln(n) FROM tb) SELECT series_id, kind, round(bic, 4) AS bic FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY bic, o) AS k FROM a) x WHERE k = 1"),
    "special_functions": Plan(lambda d: f"WITH x AS (SELECT series_id, trade_idx, abs(pnl) / 10 + {D('0.5')} AS x FROM $trades) {_special(student_t_exact(d, '(x - 3)', D(5)), student_t_exact(d, '(x / 4 - 1)', '(x * 3)'), kolmogorov('x'))}"),
    "regime_transitions": Plan("""WITH p AS (SELECT series_id, regime AS a, lead(regime) OVER (PARTITION BY series_id ORDER BY trade_idx) AS b FROM $trades),
g AS (SELECT x.series_id, x.regime AS a, y.regime AS b FROM (SELECT DISTINCT series_id, regime FROM $trades) x JOIN (SELECT DISTINCT series_id, regime FROM $trades) y ON x.series_id = y.series_id),
c AS (SELECT series_id, a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY series_id, a, b),
j AS (SELECT g.series_id, g.a, g.b, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.series_id, g.a) AS t, count(*) OVER (PARTITION BY g.series_id, g.a) AS k FROM g LEFT JOIN c ON c.series_id = g.series_id AND c.a = g.a AND c.b = g.b)
SELECT j.series_id, a AS from_regime, b AS to_regime, n, round(CASE WHEN t > 0 THEN CAST(n AS DOUBLE) / t ELSE CAST(1 AS DOUBLE) / k END, 8) AS p, round(i.p, 8) AS initial FROM j JOIN (SELECT series_id, regime, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY series_id) AS p FROM $trades GROUP BY series_id, regime) i ON i.series_id = j.series_id AND i.regime = j.a""", {"trades": "single"}),
}
