"""Fits and runs of simulation models on a history: many series in one job."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.engine import Plan
from ..sources.shared import shared
from . import portfolio
from .portfolio import cholesky, repaired
from .kernels import CHUNK, SUMMARY, Config, Counters, Generators, Kernel, Source, Walk, block_bootstrap, block_size, blocks_of, bootstrap, garch, independent, parametric, paths_of, permutation, regime_switching, running, source_of
from .simulate import copula_draws
from .stats import FITS, D

#: Tasks for each core that the paths of a series are dealt to.
TASKS_A_CORE = 2
#: The same where a row is but the numbers of a law, so that a task is about a block of paths and no core
#: has one block more than others for long.
SMALL_TASKS_A_CORE = 16
GRID_ALPHA = np.round(np.arange(0.02, 0.20, 0.02), 4)
GRID_BETA = np.round(np.arange(0.70, 0.98, 0.03), 4)


def garch_likelihood(e2: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Normal log likelihood of squared residuals for each candidate, side by side."""
    h = np.full(len(alpha), max(e2.mean(), 1e-12))
    total = np.zeros(len(alpha))
    for x in e2:
        total -= 0.5 * (np.log(2 * np.pi * h) + x / h)
        h = np.maximum(omega + alpha * x + beta * h, 1e-12)
    return total


def fit_garch(frame: pd.DataFrame) -> pd.DataFrame:
    """The fit of ``garch_models`` for one series in memory, row by row."""
    x = frame.sort_values("trade_idx")["pnl"].to_numpy(float)
    mu, v = x.mean() if len(x) else 0.0, x.var(ddof=1) if len(x) > 1 else 0.0
    row = {"series_id": frame["series_id"].iloc[0], "n": len(x), "df": fitted_df(x), "mu": mu, "omega": 0.1 * v, "alpha": 0.1, "beta": 0.8, "log_likelihood": np.nan}
    if len(x) >= 20 and v > 0:
        e2 = (x - mu) ** 2
        a, b = (g.ravel() for g in np.meshgrid(GRID_ALPHA, GRID_BETA))
        use = a + b < 0.999
        a, b = a[use], b[use]
        score = garch_likelihood(e2, v * (1 - a - b), a, b)
        best = (score.max(), a[score.argmax()], b[score.argmax()])
        for _ in range(50):
            da, db = (g.ravel() * 0.005 for g in np.meshgrid([-1, 0, 1], [-1, 0, 1]))
            a, b = best[1] + da, best[2] + db
            use = (a > 0) & (b > 0) & (a + b < 0.999)
            a, b = a[use], b[use]
            score = garch_likelihood(e2, v * (1 - a - b), a, b)
            if score.max() <= best[0] + 1e-9:
                break
            best = (score.max(), a[score.argmax()], b[score.argmax()])
        row |= {"alpha": best[1], "beta": best[2], "omega": v * (1 - best[1] - best[2]), "log_likelihood": best[0]}
    return pd.DataFrame([row])


#: Rows of a block of the variance recursion, and steps to each side of the lattice around the
#: best candidate that one pass looks at.
ROWS, REACH, STEP, MOST_STEPS = 4096, 10, 0.005, 50
#: Blocks that are passed side by side, and variances of a product.
SIDE, FACTORS = 16, 16
LAWS = Plan(f"""WITH {FITS} SELECT m.series_id, m.n, m.mu, m.sd, CASE WHEN m.n >= 3 AND m.sd > {D("1e-10")} AND -2 * tb.ll + 3 * ln(m.n) < -2 * no.ll + 2 * ln(m.n) THEN df END AS df
FROM m JOIN no ON no.series_id = m.series_id JOIN tb ON tb.series_id = m.series_id""")


def laws(trades: DataFrame) -> DataFrame:
    """(series_id, n, mu, sd, df) of each series: its normal fit, and the degrees of freedom of
    the Student one if that is better by BIC."""
    return LAWS.run(trades.sparkSession, trades=trades.select("series_id", "trade_idx", "pnl"))


def _grid() -> tuple[np.ndarray, np.ndarray]:
    a, b = (g.ravel() for g in np.meshgrid(GRID_ALPHA, GRID_BETA))
    return a[a + b < 0.999], b[a + b < 0.999]


def _lattice(alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(-REACH, REACH + 1) * STEP
    return tuple(g.ravel() for g in np.meshgrid(alpha + steps, beta + steps, indexing="ij"))


def _candidates(row) -> tuple[np.ndarray, np.ndarray]:
    """The candidates that a series is at: all of the grid, or those around its best one."""
    return _grid() if np.isnan(row["alpha"]) else _lattice(row["alpha"], row["beta"])


def _usable(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a > 0) & (b > 0) & (a + b < 0.999)


def _block_rows(frame: pd.DataFrame, run) -> pd.DataFrame:
    """``run(e2, h, a, b)`` of the blocks, those of a series that are as long side by side: for each
    candidate that can be used, 0 for others."""
    alike, out = {}, [None] * len(frame)
    for i, key in enumerate(zip(frame["series_id"], frame["rows"], strict=True)):
        alike.setdefault(key, []).append(i)
    for places in alike.values():
        a, b = _candidates(frame.iloc[places[0]])
        use = _usable(a, b)
        for first in range(0, len(places), SIDE):
            some = places[first : first + SIDE]
            values = np.zeros((len(some), len(a)))
            h = np.stack(frame["h"].iloc[some].to_list())[:, use] if "h" in frame else np.zeros((len(some), int(use.sum())))
            values[:, use] = run(np.stack(frame["e2"].iloc[some].to_list(), axis=1)[..., None], h, a[use], b[use])
            for i, x in zip(some, values):
                out[i] = x
    return pd.DataFrame({"series_id": frame["series_id"].to_numpy(), "block": frame["block"].to_numpy(), "values": out})


def _ends(e2: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the variance of each candidate ends if it begins at nothing: the rest of it is its
    beginning times beta to the number of rows."""
    w, more = 1 - a - b, np.empty_like(h)
    for x in e2:
        np.multiply(x, a, out=more)
        h *= b
        h += more
        h += w
    return h


def _fit_of_block(e2: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The log likelihood of a block for each candidate, from its beginnings ``h``. A variance is 0.001
    at least and the number of rows at most, so logarithms are taken of products of some."""
    w, total, some, product = 1 - a - b, np.zeros_like(h), np.empty_like(h), np.ones_like(h)
    for i, x in enumerate(e2, 1):
        product *= h
        np.divide(x, h, out=some)
        total -= some
        if not i % FACTORS or i == len(e2):
            total -= np.log(product, out=product)
            product[:] = 1
        np.multiply(x, a, out=some)
        h *= b
        h += some
        h += w
    return 0.5 * total


def _carry(frame: pd.DataFrame) -> pd.DataFrame:
    """The beginnings of the blocks of a series: a row a block, whatever its rows are."""
    frame = frame.sort_values("block")
    a, b = _candidates(frame.iloc[0])
    h, out = np.full(len(a), frame["start"].iloc[0]), []
    for values, rows in zip(frame["values"], frame["rows"], strict=True):
        out.append(h)
        h = values + np.power(b, rows) * h
    return frame[["series_id", "block"]].assign(h=out)


def _climb(frame: pd.DataFrame) -> pd.DataFrame:
    """The next place of a series: the best of the grid; in a lattice, steps to the best
    neighbour while that improves, up to the lattice's edge."""
    row = frame.iloc[0].copy()
    a, b = _candidates(row)
    score = np.where(_usable(a, b), frame["values"].sum(), -np.inf) - 0.5 * row["n"] * np.log(2 * np.pi * row["v"])
    if np.isnan(row["alpha"]):
        best = score.argmax()
        row["alpha"], row["beta"], row["best"] = a[best], b[best], score[best]
    else:
        side = 2 * REACH + 1
        score, a, b = (x.reshape(side, side) for x in (score, a, b))
        i = j = REACH
        row["best"] = score[i, j]
        while 0 < i < side - 1 and 0 < j < side - 1 and row["steps"] < MOST_STEPS and not row["done"]:
            near = score[i - 1 : i + 2, j - 1 : j + 2].T.ravel()  # alpha runs first
            row["steps"] += 1
            if near.max() <= row["best"] + 1e-9:
                row["done"] = True
            else:
                at = near.argmax()
                i, j, row["best"] = i + at % 3 - 1, j + at // 3 - 1, near[at]
        row["done"] = bool(row["done"] or row["steps"] >= MOST_STEPS)
        row["alpha"], row["beta"] = a[i, j], b[i, j]
    return pd.DataFrame([row[STATE_NAMES]])


STATE = "series_id string, n long, mu double, v double, start double, alpha double, beta double, best double, steps long, done boolean"
STATE_NAMES = [x.split()[0] for x in STATE.split(", ")]


def garch_models(trades: DataFrame) -> DataFrame:
    """A GARCH(1,1) fit for each series, with variance targeting: the best of a grid, then
    steps of STEP to the best neighbour while that improves. Short series, and such as do not
    vary, keep a plain fallback.

    A series is cut into blocks of ROWS rows. The variance at a block's end is affine in that
    at its beginning, so blocks are passed side by side: once for their ends, which are put
    together over the blocks, and once for the likelihoods, which are added up; for all
    candidates together. No task holds a series."""
    trades = trades.select("series_id", F.col("trade_idx").cast("long").alias("trade_idx"), F.col("pnl").cast("double").alias("pnl"))
    law = shared(laws(trades))
    spread = trades.groupBy("series_id").agg(F.coalesce(F.var_samp("pnl"), F.lit(0.0)).alias("v"))
    known = shared(law.join(spread, "series_id").select("series_id", "n", "df", "mu", "v", "sd"))
    fits = known.where("n >= 20 and v > 0")
    block = F.floor(F.col("trade_idx") / ROWS).alias("block")
    ordered = F.sort_array(F.collect_list(F.struct("trade_idx", "pnl")))
    scaled = trades.join(fits.select("series_id", "mu", "v"), "series_id").select("series_id", block, "trade_idx", ((F.col("pnl") - F.col("mu")) * (F.col("pnl") - F.col("mu")) / F.col("v")).alias("pnl"))
    blocks = shared(scaled.groupBy("series_id", "block").agg(F.transform(ordered, lambda x: x["pnl"]).alias("e2")).withColumn("rows", F.size("e2")))
    nothing = F.lit(float("nan"))
    start = F.greatest(F.col("sd") * F.col("sd") / F.col("v"), F.lit(1e-12))
    state = shared(fits.select("series_id", "n", "mu", "v", start.alias("start"), nothing.alias("alpha"), nothing.alias("beta"), nothing.alias("best"), F.lit(0).cast("long").alias("steps"), F.lit(False).alias("done")))
    values = "series_id string, block long, values array<double>"

    def ends(frames):
        for frame in frames:
            yield _block_rows(frame, _ends)

    def likelihoods(frames):
        for frame in frames:
            yield _block_rows(frame, _fit_of_block)

    tasks = TASKS_A_CORE * trades.sparkSession.sparkContext.defaultParallelism
    finished = None
    while True:
        now = state.select("series_id", "start", "alpha", "beta")
        at = blocks.join(now, "series_id").repartition(tasks, "series_id", "block")
        ended = at.mapInPandas(ends, values).join(blocks.select("series_id", "block", "rows"), ["series_id", "block"]).join(now, "series_id")
        begun = shared(ended.groupBy("series_id").applyInPandas(_carry, "series_id string, block long, h array<double>"))
        found = at.join(begun, ["series_id", "block"]).mapInPandas(likelihoods, values).join(state, "series_id")
        state = shared(found.groupBy("series_id").applyInPandas(_climb, STATE))
        done = state.where("done")
        finished = done if finished is None else finished.unionByName(done)
        state = state.where("not done")
        if state.isEmpty():
            break
    best = finished.select("series_id", "alpha", "beta", "best")
    fallback = known.join(best, "series_id", "left")
    alpha, beta = F.coalesce("alpha", F.lit(0.1)), F.coalesce("beta", F.lit(0.8))
    omega = F.when(F.col("best").isNull(), 0.1 * F.col("v")).otherwise(F.col("v") * (1 - F.col("alpha") - F.col("beta")))
    return fallback.select("series_id", "n", "df", "mu", omega.alias("omega"), alpha.alias("alpha"), beta.alias("beta"), F.coalesce("best", nothing).alias("log_likelihood"))


GRID_DF = np.arange(1.0, 30.5, 0.5)


def fitted_df(x: np.ndarray) -> float | None:
    """Degrees of freedom of the Student law that fits ``x`` best; None if a normal law
    fits better (by BIC), or ``x`` does not vary."""
    from math import lgamma, log, pi

    n, mu, sd = len(x), x.mean() if len(x) else 0.0, x.std() if len(x) else 0.0
    if n < 3 or sd <= 1e-10:
        return None
    z2, best = ((x - mu) / sd) ** 2, (-np.inf, None)
    normal = -0.5 * n * (log(2 * pi) + 2 * log(sd) + 1)
    for df in GRID_DF:
        ratio = (df - 2) / df if df > 2 else 1.0
        head = lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * log(df * pi) - log(sd) - 0.5 * log(ratio)
        total = n * head - (df + 1) / 2 * np.log1p(z2 / (ratio * df)).sum()
        best = max(best, (total, float(df)), key=lambda b: b[0])
    return best[1] if -2 * best[0] + 3 * log(n) < -2 * normal + 2 * log(n) else None


def transition_matrix(labels: list | np.ndarray, order: list) -> np.ndarray:
    at, size = {r: i for i, r in enumerate(order)}, len(order)
    codes = np.fromiter((at[x] for x in labels), np.int64, len(labels))
    counts = np.bincount(codes[:-1] * size + codes[1:], minlength=size * size).reshape(size, size).astype(float)
    sums = counts.sum(1, keepdims=True)
    return np.where(sums > 0, counts / np.maximum(sums, 1), 1 / size)


#: Models that need no history but the numbers of a law.
LAW_MODELS = ("garch", "parametric")
#: What a kernel needs of a series: numbers of its law, or its results (of each regime in turn,
#: with their counts) and how regimes follow each other.
SPEC = "series_id string, n long, law array<double>, pool binary, sizes array<long>, chain array<double>"
SPEC_ARROW = pa.schema([("series_id", pa.string()), ("n", pa.int64()), ("law", pa.list_(pa.float64())), ("pool", pa.binary()), ("sizes", pa.list_(pa.int64())), ("chain", pa.list_(pa.float64()))])


def _sorted(past: pa.Table, name: str = "pnl") -> np.ndarray:
    """A column in the order of the history."""
    return past.column(name).to_numpy()[np.argsort(past.column("trade_idx").to_numpy(), kind="stable")]


def _spec(model: str):
    """A row of SPEC from the history of a series, which stays in Arrow's plain columns."""

    def spec(past: pa.Table) -> pa.Table:
        pool = _sorted(past).astype(float)
        row = {"series_id": past.column("series_id")[0].as_py(), "n": len(pool), "law": [], "pool": b"", "sizes": [], "chain": []}
        if model == "regimes":
            codes = past.column("regime").combine_chunks().dictionary_encode()
            labels = codes.indices.to_numpy()[np.argsort(past.column("trade_idx").to_numpy(), kind="stable")]
            kinds, first = np.unique(labels, return_index=True)
            order = kinds[np.argsort(first)].tolist()
            row["pool"] = np.concatenate([pool[labels == r] for r in order]).tobytes()
            row["sizes"], row["chain"] = [int((labels == r).sum()) for r in order], transition_matrix(labels, order).ravel().tolist()
        else:
            row["pool"] = pool.tobytes()
        return pa.Table.from_pylist([row], SPEC_ARROW)

    return spec


def _kernel_of(row: pd.Series, model: str) -> Kernel:
    law, pool = [None if np.isnan(x) else float(x) for x in row["law"]], np.frombuffer(row["pool"])
    if model == "regimes":
        ends = np.cumsum(row["sizes"])
        return regime_switching(dict(enumerate(np.split(pool, ends[:-1]))), np.reshape(row["chain"], (len(ends), -1)))
    return {"bootstrap": lambda: bootstrap(pool), "permutation": lambda: permutation(pool), "blocks": lambda: block_bootstrap(pool, 5), "parametric": lambda: parametric(*law), "garch": lambda: garch(*law)}[model]()


def _histories(trades: DataFrame, model: str) -> DataFrame:
    """A row of SPEC for each series, its results as plain bytes."""
    none = F.coalesce("df", F.lit(float("nan")))
    if model in LAW_MODELS:
        if model == "garch":
            fits, law = garch_models(trades), F.array("omega", "alpha", "beta", "mu", none)
        else:  # the spread of a Student law is more than its scale
            scale = F.when(F.col("df") > 2, F.sqrt((F.col("df") - 2) / F.greatest("df", F.lit(1.0)))).otherwise(1.0)
            fits, law = laws(trades), F.array("mu", F.col("sd") * scale, none)
        specs = fits.select("series_id", "n", law.alias("law"), F.lit(b"").alias("pool"), F.array().cast("array<long>").alias("sizes"), F.array().cast("array<double>").alias("chain"))
    else:
        regime = [F.coalesce(F.col("regime").cast("string"), F.lit("default")).alias("regime")] if model == "regimes" else []
        specs = trades.select(F.col("series_id").cast("string").alias("series_id"), "trade_idx", F.col("pnl").cast("double").alias("pnl"), *regime).groupBy("series_id").applyInArrow(_spec(model), SPEC)
    return shared(specs)


def _dealt(specs: DataFrame, tasks_a_core: int = TASKS_A_CORE) -> tuple[DataFrame, int]:
    """The parts of each series, evenly dealt to tasks named by number, so all cores work
    whatever the size of the rows is; and how many parts a series has."""
    tasks = tasks_a_core * specs.sparkSession.sparkContext.defaultParallelism
    part = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
    return specs.select("*", part.alias("part")).withColumn("task", F.pmod(F.xxhash64("series_id") % tasks + F.col("part"), F.lit(tasks)).cast("int")), tasks


def _each_history(trades: DataFrame, model: str, config: Config, run, schema: str) -> DataFrame:
    """The frames of ``run(kernel, config, part, parts, pool)`` for each series and part. A task
    holds one series at a time; nothing goes through the driver."""
    deals, tasks = _dealt(_histories(trades, model), SMALL_TASKS_A_CORE if model in LAW_MODELS else TASKS_A_CORE)

    def every(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                kernel, own = _kernel_of(row, model), replace(config, steps=config.steps or int(row["n"]))
                for out in run(kernel, own, int(row["part"]), tasks, np.frombuffer(row["pool"])):
                    yield out.assign(series_id=row["series_id"])

    return deals.repartitionById(tasks, "task").drop("task").mapInPandas(every, f"{schema}, series_id string")


def simulate_history(trades: DataFrame, model: str, config: Config) -> DataFrame:
    """Reduced paths of each series under ``model``: bootstrap, permutation, blocks,
    regimes, parametric or garch; as long as the series, unless ``config`` names the steps.
    A null regime is the regime 'default'."""

    def run(kernel: Kernel, own: Config, part: int, parts: int, pool: np.ndarray):
        return paths_of(range(part, blocks_of(own.paths, block_size(kernel, own.steps)), parts), kernel, own)

    return _each_history(trades, model, config, run, SUMMARY)


def _drawn(kernel: Kernel, config: Config, ids: np.ndarray, begin: int, end: int):
    """The draws of some paths by counters, (steps, paths), from step ``begin`` to ``end``, with
    the number of their first step, in chunks."""
    source = Counters(config.seed, ids, config.steps)
    state, step = kernel.begin(source, config.steps), max(1, CHUNK // len(ids))
    for t in range(begin, end, step):
        yield t + 1, kernel.draw(source, state, t, min(step, end - t))


def _steps(kernel: Kernel, config: Config, ids: np.ndarray, begin: int = 0, end: int | None = None, before: np.ndarray | float = 0.0):
    """The balances of some paths, (steps, paths), as _drawn; ``before``: what they had won
    before step ``begin``."""
    out = Walk(len(ids), config)
    out.sum += before
    for t, draws in _drawn(kernel, config, ids, begin, config.steps if end is None else end):
        yield t, out.balances(draws)


def path_durations(trades: DataFrame, config: Config) -> DataFrame:
    """Time under water of each bootstrap path: series_id, sim_id, longest and total steps of a
    fall with its recovery (the last step, which recovers nothing, is none), steps."""

    def run(kernel: Kernel, own: Config, part: int, parts: int, pool: np.ndarray):
        for first in range(part * PART, own.paths, parts * PART):
            ids = np.arange(first, min(own.paths, first + PART))
            peak, fell = np.full(len(ids), float(own.capital)), np.zeros(len(ids), np.int64)
            longest, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for t, balance in _steps(kernel, own, ids):
                top = balance.copy()
                np.maximum(top[0], peak, out=top[0])
                running(np.maximum, top)
                peak = top[-1].copy()
                under = balance < top
                at = np.arange(t, t + len(balance))[:, None]
                before = np.where(under, 0, at)
                np.maximum(before[0], fell, out=before[0])
                running(np.maximum, before)  # the last step that was not under water
                fell = before[-1].copy()
                use = slice(0, len(at) - (t + len(balance) > own.steps))
                longest = np.maximum(longest, (at - before)[use].max(0, initial=0))
                total += under[use].sum(0)
            yield pd.DataFrame({"sim_id": ids, "longest": longest, "total": total, "steps": own.steps})

    return _each_history(trades, "bootstrap", config, run, "sim_id long, longest long, total long, steps long")


def _curves(trades: DataFrame, config: Config, ids: np.ndarray, run, schema: str) -> DataFrame:
    """The Arrow columns of ``run(steps, pool, config, begin, part)`` for each series and piece of time;
    ``steps``: the balances of the bootstrap paths ``ids`` in the piece, as _steps gives them.

    Counters name any draw, so pieces need nothing of each other but what the paths had won
    before them: a first pass adds up the draws of each piece, and a number a piece and path is
    sent out. Where balances are no sums (a session's rule, multiplicative results) a series is one piece."""
    specs = _histories(trades, "bootstrap")
    deals, parts = _dealt(specs)
    if config.session or config.multiplicative:
        deals, parts = deals.where("part = 0"), 1
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                kernel, own = _kernel_of(row, "bootstrap"), replace(config, steps=config.steps or row["n"])
                begin, end = (own.steps * (row["part"] + k) // parts for k in (0, 1))
                yield row, kernel, own, begin, end

    def sums(batches):
        for row, kernel, own, begin, end in each(batches):
            won = sum((draws.sum(0) for _, draws in _drawn(kernel, own, ids, begin, end)), np.zeros(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([row["series_id"]]), pa.array([row["part"]], pa.int32()), pa.array([won.tolist()])], ["series_id", "part", "won"])

    def every(batches):
        for row, kernel, own, begin, end in each(batches):
            before = np.array(row["before"] or 0.0)
            for columns in run(_steps(kernel, own, ids, begin, end, before), np.frombuffer(row["pool"]), own, begin, row["part"]):
                columns = [pa.repeat(pa.scalar(row["series_id"]), len(columns[0])), *map(pa.array, columns)]
                yield pa.RecordBatch.from_arrays(columns, ["series_id", *names])

    if parts > 1:
        tasks = parts
        won = shared(deals.repartitionById(tasks, "task").mapInArrow(sums, "series_id string, part int, won array<double>"))
        added = [F.sum(F.col("won")[i]).over(Window.partitionBy("series_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)) for i in range(len(ids))]
        deals = deals.join(F.broadcast(won.select("series_id", "part", F.array(*(F.coalesce(x, F.lit(0.0)) for x in added)).alias("before"))), ["series_id", "part"])
    else:
        tasks, deals = deals.sparkSession.sparkContext.defaultParallelism, deals.withColumn("before", F.lit(None).cast("array<double>"))
    return deals.repartitionById(tasks, F.pmod("task", F.lit(tasks))).drop("task").mapInArrow(every, f"series_id string, {schema}")


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Rounded as SQL does, halves away from 0."""
    if digits is None:
        return x
    x = x * 10.0**digits
    out = np.rint(x)
    whole = np.trunc(x)
    half = np.abs(x - whole) == 0.5
    out[half] = whole[half] + np.sign(x[half])
    out /= 10.0**digits
    return out


def path_curves(trades: DataFrame, config: Config, stride: int, digits: int | None = None) -> DataFrame:
    """(series_id, sim_id, t, balance) of each step, from 1, of every ``stride``-th bootstrap path."""
    shown = np.arange(0, config.paths, stride)

    def run(steps, pool: np.ndarray, own: Config, begin: int, part: int):
        for t, balance in steps:
            k = len(balance)
            yield np.tile(shown, k), np.repeat(np.arange(t, t + k), len(shown)), _rounded(balance, digits).ravel()

    return _curves(trades, config, shown, run, "sim_id long, t long, balance double")


def wide_curves(trades: DataFrame, config: Config, ids: list[int], digits: int | None = None) -> DataFrame:
    """For each step, from 0: series_id, trade, original (the balance of the history) and
    path_0, path_1, ... of the bootstrap paths ``ids``."""

    def run(steps, pool: np.ndarray, own: Config, begin: int, part: int):
        history = Walk(1, own)
        history.sum += pool[:begin].sum()
        if not part:
            yield np.zeros(1, np.int64), *np.full((1 + len(ids), 1), float(own.capital))
        for t, balance in steps:
            some = history.balances(pool[t - 1 : t - 1 + len(balance), None].copy())
            yield np.arange(t, t + len(balance)), *np.ascontiguousarray(_rounded(np.concatenate((some, balance), axis=1), digits).T)

    return _curves(trades, config, np.array(ids), run, "trade long, original double, " + ", ".join(f"path_{i} double" for i in range(len(ids))))


#: Paths of a portfolio that advance side by side: many parts for all cores.
PART = 32


def _legs(rows: DataFrame, paths: int, run, schema: str, order: tuple[str, ...] = ("trade_idx",)) -> DataFrame:
    """The frames of ``run(pools, ids)`` for PART paths at a time of each ``seg`` of ``rows(seg,
    series_id, trade_idx, pnl)``: the results of its strategies, by name, in ``order``.

    A task holds the results of one segment's strategies, 8 bytes a row, and no path."""

    def packed(past: pa.Table) -> pa.Table:
        keys = [past.column(c).to_numpy() for c in reversed(order)]
        pool = past.column("pnl").to_numpy()[np.lexsort(keys)].tobytes()
        return pa.table({"seg": past.column("seg")[:1], "series_id": past.column("series_id")[:1], "pool": pa.array([pool], pa.binary())})

    rows = rows.select(F.col("seg").cast("string").alias("seg"), F.col("series_id").cast("string").alias("series_id"), "trade_idx", F.col("pnl").cast("double").alias("pnl"))
    specs = shared(rows.groupBy("seg", "series_id").applyInArrow(packed, "seg string, series_id string, pool binary"))
    parts = blocks_of(paths, PART)
    deals = specs.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    deals = deals.withColumn("task", F.pmod(F.xxhash64("seg") % parts + F.col("part"), F.lit(parts)).cast("int"))

    def every(frames):
        def done(legs: dict, part: int, seg: str):
            pools = [np.frombuffer(legs[k]) for k in sorted(legs)]
            for out in run(pools, np.arange(part * PART, min(paths, (part + 1) * PART))):
                yield out.assign(seg=seg)

        key, legs = None, {}
        for frame in frames:
            for seg, part, name, pool in zip(frame["seg"], frame["part"], frame["series_id"], frame["pool"], strict=True):
                if key not in (None, (seg, part)):
                    yield from done(legs, key[1], key[0])
                    legs = {}
                key = seg, part
                legs[name] = pool
        if legs:
            yield from done(legs, key[1], key[0])

    return deals.repartitionById(parts, "task").sortWithinPartitions("seg", "part").drop("task").mapInPandas(every, f"{schema}, seg string")


def _walked(kernel: Kernel, config: Config, source: Source, ids: np.ndarray) -> pd.DataFrame:
    state, out = kernel.begin(source, config.steps), Walk(len(ids), config)
    step = max(1, CHUNK // len(ids))
    for t in range(0, config.steps, step):
        out.go(kernel.draw(source, state, t, min(step, config.steps - t)))
    return out.frame(ids)


def resample_legs(rows: DataFrame, config: Config) -> DataFrame:
    """Reduced paths, with ``seg``, of the strategies of each segment of ``rows(seg, series_id,
    trade_idx, pnl)`` together, each drawing from its own trades at every step up to the
    longest one's, by counters."""

    def run(pools: list[np.ndarray], ids: np.ndarray):
        own = replace(config, steps=max(map(len, pools)))
        yield _walked(independent(pools), own, Counters(own.seed, ids, own.steps), ids)

    return _legs(rows, config.paths, run, SUMMARY)


#: Strategies of a portfolio whose correlations, one number a pair, are held on the driver.
MOST_STRATEGIES = 512


def _matrix(rows: list, names: list[str]) -> np.ndarray:
    at, out = {x: i for i, x in enumerate(names)}, np.eye(len(names))
    for r in rows:
        out[at[r["i"]], at[r["j"]]] = out[at[r["j"]], at[r["i"]]] = r["value"]
    return cholesky(repaired(out))


def simulate_portfolio(trades: DataFrame, config: Config, df: float | None = None, dynamic: bool = False) -> DataFrame:
    """Reduced paths of all series together under a copula, ``dynamic`` for one whose
    correlations follow a Markov chain of regimes; as long as the longest series, unless
    ``config`` names the steps.

    Only the correlations reach the driver. Some paths advance side by side in a task, which
    holds the results of all strategies by size, 8 bytes each, and a chunk of time."""
    spark = trades.sparkSession
    trades = trades.select("series_id", "trade_idx", "pnl")
    names = sorted(r[0] for r in trades.select("series_id").distinct().limit(MOST_STRATEGIES + 1).collect())
    if not 2 <= len(names) <= MOST_STRATEGIES:
        raise ValueError(f"a portfolio has 2 to {MOST_STRATEGIES} strategies")
    initial = transitions = None
    if dynamic:
        model = portfolio.PLANS["dynamic_copula_model"].run(spark, trades=trades).collect()
        regimes = sorted(r["regime"] for r in model if r["kind"] == "initial")
        low = {x: _matrix([r for r in model if r["kind"] == "correlation" and r["regime"] == x], names) for x in regimes}
        initial = np.array([next(r["value"] for r in model if r["kind"] == "initial" and r["regime"] == x) for x in regimes])
        transitions = np.array([[next(r["value"] for r in model if r["kind"] == "transition" and (r["regime"], r["i"]) == (x, y)) for y in regimes] for x in regimes])
    else:
        low = {"all": _matrix([{"i": r["i"], "j": r["j"], "value": r["rho"]} for r in portfolio.PLANS["correlation_matrix"].run(spark, trades=trades).collect()], names)}
    steps = config.steps or trades.agg(F.countDistinct("trade_idx")).first()[0]
    factors = np.stack(list(low.values()))

    def run(pools: list[np.ndarray], ids: np.ndarray):
        source = Generators(lambda stream: np.random.Generator(np.random.SFC64([config.seed, stream, int(ids[0])])), len(ids))
        yield _walked(copula_draws(pools, factors, df, initial, transitions), replace(config, steps=steps), source, ids)

    # ranks carry: the results of a strategy by size
    return _legs(trades.withColumn("seg", F.lit("all")), config.paths, run, SUMMARY, ("pnl", "trade_idx")).drop("seg")


#: Scales to search between, and halvings of what is between them.
LEAST_SCALE, HALVINGS = 0.05, 12


def _courses(trades: DataFrame, config: Config) -> DataFrame:
    """series_id, total and lowest: what each parametric path at full size has won in the end, and
    the least on its way, from 0. The draws are those of simulate_history."""

    def run(kernel: Kernel, own: Config, part: int, parts: int, pool: np.ndarray):
        for block in range(part, blocks_of(own.paths, size := block_size(kernel, own.steps)), parts):
            ids = np.arange(block * size, min(own.paths, (block + 1) * size))
            source = source_of(own, block, ids)
            state, step = kernel.begin(source, own.steps), max(1, CHUNK // len(ids))
            total, lowest = np.zeros(len(ids)), np.zeros(len(ids))
            for t in range(0, own.steps, step):
                draws = kernel.draw(source, state, t, min(step, own.steps - t))
                draws[0] += total
                running(np.add, draws)
                total = draws[-1].copy()
                np.minimum(lowest, draws.min(0), out=lowest)
            yield pd.DataFrame({"total": total, "lowest": lowest})

    return _each_history(trades, "parametric", config, run, "total double, lowest double")


def _prober(trades: DataFrame, config: Config):
    """``probe(scales)``: risk of each series at its scale, over its parametric paths.

    A law at a scale is the law times the scale, and so is what a path has won: the paths are
    drawn once for all scales. Only if balances are no sums each probe draws its own."""
    courses = None if config.session or config.multiplicative else shared(_courses(trades, config))

    def drawn(scales: DataFrame) -> DataFrame:
        if courses is not None:
            ruined = config.capital + F.col("scale") * F.col("lowest") <= config.capital * (1 - config.ruin_percent / 100)
            return courses.join(F.broadcast(scales), "series_id").select("series_id", (F.col("scale") * F.col("total")).alias("pnl"), ruined.alias("ruined"))
        scaled = trades.join(scales.select("series_id", "scale"), "series_id").select("series_id", "trade_idx", (F.col("pnl") * F.col("scale")).alias("pnl"), F.lit("").alias("regime"))
        return simulate_history(scaled, "parametric", replace(config, rules=None)).select("series_id", (F.col("final_balance") - config.capital).alias("pnl"), "ruined")

    def probe(scales: DataFrame) -> DataFrame:
        ranked = drawn(scales).withColumn("r", F.row_number().over(Window.partitionBy("series_id").orderBy("pnl")))
        tail = max(1, int(config.paths * (1 - 0.95)))
        risk = ranked.groupBy("series_id").agg((100 * F.avg(F.col("ruined").cast("double"))).alias("ruin_percent"), F.avg(F.when(F.col("r") <= tail, F.col("pnl"))).alias("cvar95"), F.avg("pnl").alias("mean"), F.coalesce(F.stddev_samp("pnl"), F.lit(0.0)).alias("std"))
        good = (F.col("ruin_percent") < 2) & (F.col("cvar95") >= -0.3 * config.capital) & (F.col("std") < 1.5 * F.greatest(F.abs("mean"), F.lit(1.0)))
        return risk.withColumn("passes", good)

    return probe


def position_size(trades: DataFrame, config: Config, halvings: int = HALVINGS) -> DataFrame:
    """The largest scale from LEAST_SCALE to 1 at which each series keeps its guardrails
    (ruin below 2 %, CVaR95 at least -0.3 of the capital, spread below 1.5 times the
    mean), and its risk there: full size if that keeps them, LEAST_SCALE with ``passes``
    false if not even that does, else found by halving.

    All series are searched side by side; what is known of each stays on Spark, and only
    whether any is still open reaches the driver."""
    trades = trades.select("series_id", "trade_idx", "pnl")
    risks = ("ruin_percent", "cvar95", "mean", "std", "passes")
    ids, probe = trades.select("series_id").distinct(), _prober(trades, config)
    full = probe(ids.withColumn("scale", F.lit(1.0))).withColumn("scale", F.lit(1.0))
    done, left = _split(full.select("series_id", "scale", *risks))
    least = probe(left.select("series_id").withColumn("scale", F.lit(LEAST_SCALE)))
    state = shared(least.withColumn("scale", F.lit(LEAST_SCALE)).select("series_id", "scale", *risks))
    never, state = state.where("not passes"), state.where("passes").withColumn("low", F.lit(LEAST_SCALE)).withColumn("high", F.lit(1.0))
    state = shared(state)
    for _ in range(halvings if not state.isEmpty() else 0):
        middle = state.select("series_id", ((F.col("low") + F.col("high")) / 2).alias("scale"))
        found = probe(middle).join(middle, "series_id")
        found = found.select("series_id", *(F.col(c).alias(f"new_{c}") for c in ("scale", *risks)))
        better = F.col("new_passes")
        chosen = [F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("scale", *risks)]
        state = shared(state.join(found, "series_id").select("series_id", *chosen, F.when(better, F.col("new_scale")).otherwise(F.col("low")).alias("low"), F.when(better, F.col("high")).otherwise(F.col("new_scale")).alias("high")))
    return done.unionByName(never).unionByName(state.select("series_id", "scale", *risks))


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    df = shared(df)
    return df.where("passes"), df.where("not passes")


__all__ = ["SUMMARY", "garch_models", "position_size", "simulate_history", "simulate_portfolio"]
