"""Monte Carlo paths: a declarative form that SQL can check, and numpy kernels over
partitions of path ids for scale. Both reduce each path to one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans.engine import SPARK, Plan, numbers, xor
from .kernels import STREAM, SUMMARY, Config, Kernel, Session, Source, Walk, block_bootstrap, block_size, blocks_of, bootstrap, garch, parametric, paths_of, permutation, regime_switching
from .performance import CAPITAL, PERIODS

SEED, PATHS, RUIN_PERCENT = 42, 200, 50
MASK = 4294967295
#: What stands for a uniform of 0 in logarithms.
TINY = "CAST('1.1641532182693481e-10' AS DOUBLE)"
LEVEL = f"(CAST({CAPITAL} AS DOUBLE) * (1 - CAST({RUIN_PERCENT} AS DOUBLE) / 100))"


def uniform(d: str, source: str, k: str, keep: str, seed: int = SEED, tag: str = "") -> str:
    """CTEs r0 to r5 (with ``tag`` before each): a counter-based uniform ``u`` for draw
    ``k`` (from 1) of ``source``."""

    def shift(x: str, n: int) -> str:
        return f"shiftright({x}, {n})" if d == SPARK else f"({x} >> {n})"

    def product(a: str, b: str) -> str:  # its low 32 bits, without passing 63
        return f"(({a} * ({b} & 65535) + ((({a} * ({shift(b, 16)} & 65535)) & 65535) * 65536)) & {MASK})"

    r = f"{tag}r"
    return f"""{r}0 AS (SELECT {keep}, ({seed} + (({k}) & {MASK}) * CAST(1831565813 AS BIGINT)) & {MASK} AS a0 FROM {source}),
{r}1 AS (SELECT {keep}, {xor(d, "a0", shift("a0", 15))} AS x0, (a0 | 1) AS y0 FROM {r}0),
{r}2 AS (SELECT {keep}, {product("x0", "y0")} AS h FROM {r}1),
{r}3 AS (SELECT {keep}, h, {xor(d, "h", shift("h", 7))} AS x0, (h | 61) AS y0 FROM {r}2),
{r}4 AS (SELECT {keep}, {xor(d, "((h + " + product("x0", "y0") + f") & {MASK})", "h")} AS h FROM {r}3),
{r}5 AS (SELECT {keep}, {xor(d, "h", shift("h", 14))} / CAST(4294967296 AS DOUBLE) AS u FROM {r}4)"""


def grid(d: str) -> str:
    """CTE ``g``: for each series PATHS paths of as many steps as it has rows. ``trade_idx``
    counts the rows of a series from 0."""
    return f"n AS (SELECT series_id, count(*) AS n FROM $pool GROUP BY series_id), g AS (SELECT p.series_id, n, s.i AS sim_id, p.trade_idx AS t FROM {numbers(d, PATHS)} s CROSS JOIN $pool p JOIN n ON n.series_id = p.series_id)"


def draw(d: str, how: str) -> str:
    """CTE ``dr``: (series_id, sim_id, t, idx), the history row that each step repeats."""
    head = grid(d) + ", " + uniform(d, "g", "sim_id * n + t + 1", "series_id, n, sim_id, t")
    if how == "bootstrap":  # coalesce: a join key that cannot be null gets no filter, into which Spark would copy all of r0 to r5
        return head + ", dr AS (SELECT series_id, sim_id, t, coalesce(CAST(floor(u * n) AS BIGINT), 0) AS idx FROM r5)"
    if how == "permutation":
        return head + ", dr AS (SELECT series_id, sim_id, CAST(row_number() OVER (PARTITION BY series_id, sim_id ORDER BY u, t) - 1 AS BIGINT) AS t, t AS idx FROM r5)"
    # stationary blocks: the uniform starts one with probability 1/5, and its rest places it
    return head + """, bl AS (SELECT series_id, sim_id, t, CASE WHEN t = 0 OR u < CAST('0.2' AS DOUBLE) THEN t END AS t0, CASE WHEN t = 0 THEN CAST(floor(u * n) AS BIGINT) WHEN u < CAST('0.2' AS DOUBLE) THEN CAST(floor(u * 5 * n) AS BIGINT) END AS s0, n FROM r5),
bf AS (SELECT series_id, sim_id, t, n, max(t0) OVER (PARTITION BY series_id, sim_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS t0 FROM bl),
dr AS (SELECT bf.series_id, bf.sim_id, bf.t, (bl.s0 + bf.t - bf.t0) % bf.n AS idx FROM bf JOIN bl ON bf.series_id = bl.series_id AND bf.sim_id = bl.sim_id AND bf.t0 = bl.t)"""


def paths(d: str, how: str) -> str:
    """CTEs ``pa``, ``pk`` and ``ps``: balances, with their peaks, and a row for each path."""
    return draw(d, how) + f""", pa AS (SELECT dr.series_id, sim_id, t + 1 AS t, p.pnl, CAST({CAPITAL} AS DOUBLE) + sum(p.pnl) OVER (PARTITION BY dr.series_id, sim_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS balance FROM dr JOIN $pool p ON p.series_id = dr.series_id AND p.trade_idx = dr.idx),
pk AS (SELECT *, greatest(CAST({CAPITAL} AS DOUBLE), max(balance) OVER (PARTITION BY series_id, sim_id ORDER BY t ROWS UNBOUNDED PRECEDING)) AS peak, max(t) OVER (PARTITION BY series_id, sim_id) AS last_t FROM pa),
ps AS (SELECT series_id, sim_id, max(CASE WHEN t = last_t THEN balance END) AS final_balance, greatest(CAST(0 AS DOUBLE), max(least(CAST(1 AS DOUBLE), (peak - balance) / greatest(peak, CAST('1e-8' AS DOUBLE))))) AS max_drawdown, max(CASE WHEN balance <= {LEVEL} THEN 1 ELSE 0 END) AS ruined, max(last_t) AS steps FROM pk GROUP BY series_id, sim_id)"""


def _summary(how: str) -> Plan:
    return Plan(lambda d: f"WITH {paths(d, how)} SELECT series_id, sim_id, round(final_balance, 4) AS final_balance, round(max_drawdown, 8) AS max_drawdown, ruined, round((final_balance - {CAPITAL}) / steps, 6) AS ev FROM ps", {"pool": "trades"})


def at(share: str) -> str:
    return f"least(n - 1, greatest(0, CAST(floor(n * {share}) AS BIGINT)))"


LOW95 = "(1 - CAST('0.95' AS DOUBLE))"
#: Trailing drawdown, target and consistency of an evaluation account.
RULES = (600, 400, 40)


def _durations(d: str) -> str:
    """Time under water of every path, as a row for each series."""
    return f"""WITH {paths(d, "bootstrap")}, un AS (SELECT series_id, sim_id, t, last_t, CASE WHEN balance < peak THEN 1 ELSE 0 END AS under FROM pk),
ui AS (SELECT *, t - row_number() OVER (PARTITION BY series_id, sim_id, under ORDER BY t) AS island FROM un),
up AS (SELECT series_id, sim_id, max(last_t) AS last_t, CASE WHEN max(t) = max(last_t) THEN max(t) ELSE max(t) + 1 END - min(t) AS duration FROM ui WHERE under = 1 GROUP BY series_id, sim_id, island),
us AS (SELECT ps.series_id, ps.sim_id, coalesce(max(duration), 0) AS longest, coalesce(CAST(sum(duration) AS DOUBLE) / greatest(1, max(last_t)), 0) AS share FROM ps LEFT JOIN up ON up.series_id = ps.series_id AND up.sim_id = ps.sim_id GROUP BY ps.series_id, ps.sim_id),
{DURATION_ENDS}"""


#: The last part of the report, from ``us``: longest fall and share under water of each path.
DURATION_ENDS = f"""uo AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY longest, sim_id) - 1 AS r, count(*) OVER (PARTITION BY series_id) AS n FROM us)
SELECT series_id, max(CASE WHEN r = {at("CAST('0.5' AS DOUBLE)")} THEN longest END) AS median_max_duration, max(CASE WHEN r = {at("CAST('0.95' AS DOUBLE)")} THEN longest END) AS p95_max_duration, round(avg(share), 8) AS mean_share_under FROM uo GROUP BY series_id"""


#: Paths that a sample shows at most, and how far apart they are.
SHOWN = 50
STRIDE = max(1, PATHS // min(PATHS, SHOWN))


def _wide(d: str) -> str:
    """A row for each step from 0: the curve of the history, and a column for each of some
    evenly spread paths."""
    stride = STRIDE
    columns = "".join(f", round(coalesce(max(CASE WHEN sim_id = {i * stride} THEN balance END), {CAPITAL}), 4) AS path_{i}" for i in range(min(SHOWN, -(-PATHS // stride))))
    return f"""WITH {paths(d, "bootstrap")}, sa AS (SELECT series_id, t, sim_id, balance FROM pa WHERE sim_id % {stride} = 0 UNION ALL SELECT DISTINCT series_id, 0, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM $pool),
og AS (SELECT series_id, trade_idx + 1 AS t, CAST({CAPITAL} AS DOUBLE) + sum(pnl) OVER (PARTITION BY series_id ORDER BY trade_idx ROWS UNBOUNDED PRECEDING) AS original FROM $pool)
SELECT sa.series_id, sa.t AS trade, round(coalesce(max(original), {CAPITAL}), 4) AS original{columns} FROM sa LEFT JOIN og ON og.series_id = sa.series_id AND og.t = sa.t GROUP BY sa.series_id, sa.t"""


PLANS = {
    # a uniform, a normal and a geometric number for each row, from its own counter
    "random_draws": Plan(lambda d: f"WITH {uniform(d, '$raw', 'event_id + 1', 'event_id')}, {uniform(d, '$raw', 'event_id + 1', 'event_id', SEED + STREAM, 'v')} SELECT a.event_id AS i, round(a.u, 10) AS u, round(sqrt(-2 * ln(greatest(a.u, {TINY}))) * cos(2 * pi() * b.u), 8) AS normal, CAST(greatest(1, ceil(ln(greatest(a.u, {TINY})) / ln(1 - CAST('0.2' AS DOUBLE)))) AS BIGINT) AS geometric FROM r5 a JOIN vr5 b ON a.event_id = b.event_id", {"raw": "raw"}),
    "bootstrap_paths": _summary("bootstrap"),
    "permutation_paths": _summary("permutation"),
    "block_bootstrap_paths": _summary("blocks"),
    "simulated_durations": Plan(_durations, {"pool": "trades"}),
    "spaghetti_sample": Plan(lambda d: f"WITH {paths(d, 'bootstrap')} SELECT series_id, sim_id, t, round(balance, 4) AS balance FROM pa WHERE sim_id % {PATHS // 50} = 0", {"pool": "trades"}),
    "spaghetti_wide": Plan(_wide, {"pool": "trades"}),
    "metrics_validity": Plan(lambda d: f"WITH {paths(d, 'permutation')}, f AS (SELECT series_id, max(CASE WHEN sim_id = 0 THEN final_balance END) AS first FROM ps GROUP BY series_id) SELECT ps.series_id, CASE WHEN max(abs(final_balance - first)) < CAST('1e-4' AS DOUBLE) THEN 1 ELSE 0 END AS degenerate, count(*) AS paths FROM ps JOIN f ON f.series_id = ps.series_id GROUP BY ps.series_id", {"pool": "trades"}),
}


#: On Spark reports read what kernels make of the same draws, a row a path, so that no step of
#: a path is a row: ``$us`` of ``models.path_durations``, ``$paths`` of ``models.simulate_history``.
REDUCED = {
    "simulated_durations": Plan(f"WITH us AS (SELECT series_id, sim_id, longest, CAST(total AS DOUBLE) / greatest(1, steps) AS share FROM $us), {DURATION_ENDS}", {"us": "us"}),
    "metrics_validity": Plan("WITH ps AS (SELECT series_id, sim_id, final_balance FROM $paths), f AS (SELECT series_id, max(CASE WHEN sim_id = 0 THEN final_balance END) AS first FROM ps GROUP BY series_id) SELECT ps.series_id, CASE WHEN max(abs(final_balance - first)) < CAST('1e-4' AS DOUBLE) THEN 1 ELSE 0 END AS degenerate, count(*) AS paths FROM ps JOIN f ON f.series_id = ps.series_id GROUP BY ps.series_id", {"paths": "permuted_paths"}),
}


def _balances(draws: np.ndarray, config: Config) -> np.ndarray:
    """Balances (path, step), the capital first, from the draws (path, step)."""
    return np.concatenate((np.full((len(draws), 1), float(config.capital)), Walk(len(draws), config).balances(draws.T.astype(float)).T), axis=1)


def reduce_paths(ids: np.ndarray, balance: np.ndarray, config: Config) -> pd.DataFrame:
    """One row for each path of balances (path, step), the capital first."""
    out = Walk(len(ids), config)
    if balance.shape[1] > 1:
        out.see(balance[:, 1:].T)
    return out.frame(ids)


def simulate(spark: SparkSession, kernel: Kernel, config: Config) -> DataFrame:
    """``config.paths`` reduced paths; a lost task is done again alike."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from paths_of(frame["id"], kernel, config)

    return spark.range(blocks_of(config.paths, block_size(kernel, config.steps))).mapInPandas(run, SUMMARY)


def copula_draws(pools: list[np.ndarray], factors: np.ndarray, df: float | None = None, initial: np.ndarray | None = None, transitions: np.ndarray | None = None) -> Kernel:
    """Sums of a result of each of the sorted ``pools``, a strategy's each, whose ranks are tied by a
    Gaussian copula or, with ``df``, a Student one with a shared chi-square.

    ``factors``: the Cholesky factor of each regime. With several regimes the first one is drawn
    by ``initial`` and each next one by ``transitions``. A stream of draws for each strategy, then
    those of the chi-squares and of the regimes."""
    legs, upto = len(pools), None if transitions is None else np.cumsum(transitions, axis=1)

    def begin(source: Source, n: int) -> dict:
        if upto is None:
            return {}
        return {"now": np.minimum((np.cumsum(initial) < source.uniform(legs + 1, 0, 1)[0][:, None]).sum(1), len(upto) - 1)}

    def draw(source: Source, state: dict, t: int, k: int) -> np.ndarray:
        z = [source.normal(j, t, k) for j in range(legs)]
        scale = 1.0 if df is None else np.sqrt(source.chi_square(legs, t, k, df) / df)
        regime = None
        if upto is not None:
            v, now, regime = source.uniform(legs + 2, t, k), state["now"], np.empty(z[0].shape, np.int64)
            for i in range(k):
                regime[i] = now
                now = np.minimum((upto[now] < v[i, :, None]).sum(1), len(upto) - 1)
            state["now"] = now
        total = np.zeros(z[0].shape)
        for i, pool in enumerate(pools):
            factor = lambda j, i=i: factors[0, i, j] if regime is None else factors[regime, i, j]
            x = sum(factor(j) * z[j] for j in range(i + 1)) / scale
            u = normal_cdf(x) if df is None else student_cdf(x, df)
            total += pool[np.minimum((u * len(pool)).astype(np.int64), len(pool) - 1)]
        return total

    return Kernel(begin, draw)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln(gamma(x)) for x >= 0.5, by the same formula as the SQL form."""
    from .stats import LANCZOS

    z = x - 1
    series = sum((float(c) / (z + i) for i, c in enumerate(LANCZOS[1:], 1)), float(LANCZOS[0]))
    return 0.9189385332046727 + (z + 0.5) * np.log(z + 7.5) - (z + 7.5) + np.log(series)


def kolmogorov_q(x: np.ndarray) -> np.ndarray:
    """The Kolmogorov tail, by the same terms as the SQL form."""
    total = np.zeros(len(x))
    for k in range(1, 101):
        total += (-2 if k % 2 == 0 else 2) * np.exp(-2 * k * k * x * x)
    return np.where(x <= 0, 1, np.clip(total, 0, 1))


def special_columns(trades: DataFrame) -> DataFrame:
    """series_id, at (the trade), x and the functions of it that cost most. Rows are dealt out
    first, as numbering the trades leaves a series in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame["x"].to_numpy()
            yield frame.assign(student=student_cdf(x - 3, 5.0), any_df=student_cdf(x / 4 - 1, x * 3), kolmogorov=kolmogorov_q(x))

    rows = trades.selectExpr("series_id", "trade_idx AS at", "abs(pnl) / 10 + CAST('0.5' AS DOUBLE) AS x").repartition(8 * trades.sparkSession.sparkContext.defaultParallelism, "series_id", "at")
    return rows.mapInPandas(run, "series_id string, at long, x double, student double, any_df double, kolmogorov double")


def student_cdf(x: np.ndarray, df: float) -> np.ndarray:
    """P(T <= x) for any ``df`` above 0, one or one for each x, by the same fraction as the SQL form."""
    from .stats import FRACTION

    a, z = df / 2, df / (df + np.square(x))
    swap = z > (a + 1) / (a + 2.5)
    p, q = np.where(swap, 0.5, a), np.where(swap, a, 0.5)
    y, left = np.maximum(1e-300, np.where(swap, 1 - z, z)), np.maximum(1e-300, np.where(swap, z, 1 - z))
    f = np.ones(np.shape(x))
    for m in range(FRACTION - 1, -1, -1):
        even = (m + 1) * (q - m - 1) * y / ((p + 2 * m + 1) * (p + 2 * m + 2))
        f = 1 - (p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)) / (1 + even / f)
    beta = np.exp(log_gamma(a + 0.5) - log_gamma(a + 1) + np.log(a) - 0.5723649429247001 + p * np.log(y) + q * np.log(left)) / p / f
    tail = np.where(swap, 1 - beta, beta) / 2
    return np.where(np.asarray(x) >= 0, 1 - tail, tail)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """P(Z <= x), by the same formula as the SQL form."""
    from .stats import NORMAL

    t = 1 / (1 + 0.2316419 * np.abs(x))
    upper = np.exp(-0.5 * x * x) / np.sqrt(2 * np.pi) * t * np.polyval([float(c) for c in reversed(NORMAL)], t)
    return np.where(x >= 0, 1 - upper, upper)


__all__ = ["SUMMARY", "Config", "Kernel", "Session", "block_bootstrap", "bootstrap", "garch", "parametric", "permutation", "reduce_paths", "regime_switching", "simulate"]
