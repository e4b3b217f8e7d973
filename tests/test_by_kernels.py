"""Reports over every step of every path, by kernels that keep a row a path."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from riskloom.operators import models
from riskloom.operators.kernels import Config, counter_uniform
from riskloom.plans import catalog

SF = "/root/testdata/sf0.001"
ROWS, PATHS = 3000, 40  # more steps than a chunk of time


@pytest.fixture(scope="module")
def history():
    return np.round(np.random.default_rng(5).normal(0.5, 40, ROWS), 2)


def table(spark, pools):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": k, "trade_idx": np.arange(len(v)), "pnl": v}) for k, v in pools.items()]).sample(frac=1, random_state=1))


def curves(pool):
    counters = np.arange(PATHS)[:, None] * len(pool) + np.arange(len(pool)) + 1
    return 10_000 + np.cumsum(pool[(counter_uniform(42, counters) * len(pool)).astype(int)], axis=1)


@pytest.mark.parametrize("name", sorted(set(catalog.BY_KERNELS) - {"validation_report"}))
def test_no_row_for_each_step_of_each_path(spark, name):
    """The SQL forms crossed the history with the numbers of 200 paths, and shuffled that."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0, 200" not in plan


def test_time_under_water_over_chunks(spark, history):
    config = Config(paths=PATHS, counter=True, rules=None)
    got = models.path_durations(table(spark, {"a": history}), config).toPandas().sort_values("sim_id")
    balance = curves(history)
    under = balance < np.maximum(10_000, np.maximum.accumulate(balance, axis=1))
    for i, row in enumerate(got.itertuples()):
        runs, n = [], 0
        for t, below in enumerate(under[i]):
            n = n + 1 if below else 0
            runs.append(n if t < ROWS - 1 else 0)
        assert (row.longest, row.total, row.steps) == (max(runs), under[i, :-1].sum(), ROWS)


def test_curves_over_chunks(spark, history):
    config = Config(paths=PATHS, counter=True, rules=None)
    long = models.path_curves(table(spark, {"a": history}), config, 2).toPandas().sort_values(["sim_id", "t"])
    assert np.allclose(long["balance"].to_numpy().reshape(PATHS // 2, ROWS), curves(history)[::2])
    wide = models.wide_curves(table(spark, {"a": history}), config, [0, 7]).toPandas().sort_values("trade")
    assert wide["trade"].tolist() == list(range(ROWS + 1))
    assert np.allclose(wide[["original", "path_0", "path_1"]].to_numpy()[1:].T, [10_000 + np.cumsum(history), *curves(history)[[0, 7]]])


def test_portfolio_of_unequal_legs(spark, history):
    pools = {"a": history, "b": history[:700] * 20}
    config = Config(paths=PATHS, counter=True, rules=None, capped=False)
    got = models.resample_legs(table(spark, pools).selectExpr("'x' AS seg", "*"), config).toPandas().sort_values("sim_id")
    at = np.arange(PATHS)[:, None] * ROWS + np.arange(ROWS)
    balance = 10_000 + np.cumsum(sum(p[(counter_uniform(42, at * 2 + j + 1) * len(p)).astype(int)] for j, p in enumerate(pools.values())), axis=1)
    peak = np.maximum(10_000, np.maximum.accumulate(balance, axis=1))
    assert np.allclose(got["final_balance"], balance[:, -1]) and np.allclose(got["max_drawdown"], ((peak - balance) / peak).max(1))
    assert got["max_drawdown"].max() > 1


def test_permutations_of_short_blocks(spark, history):
    """Each path holds every result once; the counters' order is that of their uniforms."""
    from riskloom.operators.kernels import Counters, Generators, permutation

    for source in (Counters(42, np.arange(3), ROWS), Generators(lambda s: np.random.default_rng(s), 3)):
        kernel = permutation(history)
        state = kernel.begin(source, ROWS)
        drawn = np.concatenate([kernel.draw(source, state, t, 1000) for t in range(0, ROWS, 1000)])
        assert all((np.sort(path) == np.sort(history)).all() for path in drawn.T) and (drawn[:, 0] != drawn[:, 1]).any()
    u = counter_uniform(42, np.arange(3)[:, None] * ROWS + np.arange(ROWS) + 1)
    source = Counters(42, np.arange(3), ROWS)
    assert (source.order(ROWS) == np.argsort(u, axis=1, kind="stable")).all()


def test_copula_paths_are_no_groups_of_rows(spark, history):
    """A path's steps were joined with the trades and gathered in one pandas frame."""
    df = table(spark, {"a": history[:300], "b": -history[:200]})
    for kind in ({}, {"df": 5.0}, {"dynamic": True}):
        got = models.simulate_portfolio(df, Config(paths=70), **kind)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroups" not in plan and "Join" not in plan
        assert sorted(r["sim_id"] for r in got.select("sim_id", "steps").where("steps = 300").collect()) == list(range(70))


def test_paths_are_looked_at_step_by_step_only_where_it_counts(monkeypatch):
    """Every step of every path was compared with its peak, also of paths whose fall could get no deeper."""
    from riskloom.operators import kernels

    looked, rng = [], np.random.default_rng(3)
    look = kernels.Walk._look
    monkeypatch.setattr(kernels.Walk, "_look", lambda self, balance, paths: (looked.append(balance.size), look(self, balance, paths))[1])
    for drift, capped in ((-2, True), (2, True), (0, True), (0, False)):
        draws, config = np.round(rng.normal(drift, 50, (20_000, 70)), 2), Config(capped=capped, rules=(600, 400, 40))
        out, looked[:] = kernels.Walk(70, config), []
        for t in range(0, len(draws), 128):
            out.go(draws[t : t + 128].copy())
        balance = 10_000 + np.cumsum(draws, axis=0)
        peak = np.maximum(10_000, np.maximum.accumulate(balance, axis=0))
        fall = ((peak - balance) / peak).max(0)
        got = out.frame(np.arange(70))
        assert np.allclose(got["final_balance"], balance[-1]) and np.allclose(got["max_drawdown"], np.minimum(fall, 1) if capped else fall)
        assert (got["ruined"] == (balance.min(0) <= 5000)).all()
        event = ((peak - balance >= 600) | (balance >= 10_400)).argmax(0) + 1
        assert (got["event_step"] == event).all() and sum(looked) < draws.size / 2


def test_values_of_long_histories_by_their_frequency():
    """A long history was read at random places: drawing its values keeps how often each stands there."""
    from riskloom.operators.kernels import Generators, bootstrap, regime_switching

    pool = np.repeat(np.arange(1000.0), np.arange(1000))
    n = len(pool)
    for kernel in (bootstrap(pool), regime_switching({"a": pool[: n // 3], "b": pool[n // 3 :]}, np.array([[2 / 3, 1 / 3], [1 / 6, 5 / 6]]))):
        source = Generators(lambda s: np.random.default_rng(s), 512)
        state = kernel.begin(source, 4000)
        drawn = kernel.draw(source, state, 0, 4000)
        assert np.isin(drawn, pool).all()
        counts = np.bincount(drawn.ravel().astype(int), minlength=1000)
        assert counts[0] == 0
        expected = drawn.size * np.arange(1000) / n
        assert abs(((counts - expected)[1:] ** 2 / expected[1:]).mean() - 1) < 3


def test_curves_in_pieces_of_time(spark, history):
    """A series' curves were one task: now each task has a piece of time, whose paths go on from the pieces before."""
    config = Config(paths=PATHS, counter=True, rules=None)
    wide = models.wide_curves(table(spark, {"a": history, "b": history[:5]}), config, list(range(PATHS)), digits=2)
    tasks = wide.selectExpr("spark_partition_id() as task", "series_id", "trade").where("series_id = 'a'").groupBy("task").count().collect()
    assert len(tasks) == models.TASKS_A_CORE * spark.sparkContext.defaultParallelism and max(r["count"] for r in tasks) < ROWS / 4
    got = wide.where("series_id = 'a'").toPandas().sort_values("trade")
    assert (got[[f"path_{i}" for i in range(PATHS)]].to_numpy()[1:].T == np.round(curves(history), 2)).all()
    assert sorted(r["trade"] for r in wide.where("series_id = 'b'").collect()) == list(range(6))
    assert models._rounded(np.array([0.5, -0.5, 2.5, 1.25]), 0).tolist() == [1, -1, 3, 1]
    long = models.path_curves(table(spark, {"a": history[:50]}), Config(paths=4, counter=True, rules=None, multiplicative=True, capital=1), 1)
    assert long.count() == 200


def test_sizing_draws_its_paths_once(spark, history, monkeypatch):
    """Each of up to 14 scales fitted the scaled history and drew all paths anew."""
    passes, one = [], models._each_history
    monkeypatch.setattr(models, "_each_history", lambda *a, **b: (passes.append(1), one(*a, **b))[1])
    df = table(spark, {"a": history[:400] + 3, "b": history[:50] / 100 + 5, "c": -history[:300] - 9})
    config = Config(paths=600)
    rows = {r["series_id"]: r for r in models.position_size(df, config, 3).collect()}
    assert len(passes) == 1 and rows["b"]["scale"] == 1 and 0.05 < rows["c"]["scale"] < 1
    for k, row in rows.items():  # what the paths of the scaled history come to
        own = df.where(f"series_id = '{k}'").selectExpr("series_id", "trade_idx", f"pnl * {row['scale']} as pnl")
        paths = models.simulate_history(own, "parametric", Config(paths=600, rules=None)).toPandas()
        assert np.allclose([row["mean"], row["std"], row["ruin_percent"]], [paths["final_balance"].mean() - 10_000, paths["final_balance"].std(), 100 * paths["ruined"].mean()])


class InRows:
    """A generator that leaves what it is to mix as it stands, and counts it."""

    def __init__(self, seed: int) -> None:
        self.integers, self.mixed = np.random.default_rng(seed).integers, 0

    def permutation(self, x: np.ndarray) -> np.ndarray:
        self.mixed += len(x)
        return x


@pytest.mark.parametrize("config", [Config(), Config(rules=None), Config(capped=False), Config(ruin_percent=100, rules=(5000, 8000, 20)), Config(capital=300, ruin_percent=0)])
def test_long_permutations_are_put_in_order_only_where_it_counts(config):
    """Every path mixed its whole history; now only parts of it whose order can change a result."""
    from riskloom.operators import kernels

    rng, mixed = np.random.default_rng(8), {}
    for drift in (-3, -0.3, 0, 0.3, 3):
        n = kernels.MANY + 1001
        pool = np.round(rng.exponential(50, n) - 50 + drift, 2)
        config = replace(config, steps=n)
        sides = kernels.permutation(pool).once.sides
        for seed in range(8):
            part = np.concatenate([kernels._random_bits(source, len(x), (n // kernels.PART).bit_length() - 1) for source in [InRows(seed)] for x in sides])
            path = np.concatenate(sides)[np.argsort(part, kind="stable")]
            whole = kernels.Walk(1, config)
            whole.go(path[:, None].copy())
            source = InRows(seed)
            fall, ruined, outcome, event = kernels._arranged(source, sides, config)
            mixed[drift, seed] = source.mixed / n
            assert (ruined, outcome, event) == (whole.ruined[0], whole.outcome[0], whole.event[0]) and np.isclose(fall, whole.fall[0], rtol=1e-9)
    if config == Config(steps=n):
        assert max(x for (drift, _), x in mixed.items() if abs(drift) == 3) < 1 / 2


def test_long_permutations_have_the_law_of_whole_ones(monkeypatch):
    from riskloom.operators import kernels

    pool = np.round(np.random.default_rng(9).exponential(50, 20_000) - 49.8, 2)
    config, kernel = Config(paths=1000, steps=len(pool)), kernels.permutation(pool)
    blocks = range(kernels.blocks_of(config.paths, kernels.block_size(kernel, config.steps)))
    whole = pd.concat(kernels.paths_of(blocks, kernel, config))
    monkeypatch.setattr(kernels, "MANY", 1000)
    cells = pd.concat(kernels.paths_of(blocks, kernel, config))
    assert cells["sim_id"].tolist() == whole["sim_id"].tolist() and np.allclose(cells["final_balance"], 10_000 + pool.sum()) and np.allclose(cells["ev"], pool.mean())
    for column in ("max_drawdown", "event_step"):
        a, b = (np.sort(x[column].dropna().astype(float)) for x in (whole, cells))
        at = np.concatenate((a, b))
        apart = np.abs(np.searchsorted(a, at, side="right") / len(a) - np.searchsorted(b, at, side="right") / len(b)).max()
        assert apart < 1.95 * np.sqrt(1 / len(a) + 1 / len(b))
    for kind in ("passed", "drawdown", "consistency"):
        assert abs((cells["outcome"] == kind).mean() - (whole["outcome"] == kind).mean()) < 0.06
    strange = pool.copy()
    strange[7] = np.nan
    assert not kernels._in_cells(kernels.permutation(strange), config) and not kernels._in_cells(kernel, Config(steps=3000)) and kernels._in_cells(kernel, config)


@pytest.mark.parametrize("df", [1.0, 2.5, 4.5, 12.0, 200.0])
def test_student_draws_by_layers(df):
    """Each draw was a normal one over the root of a gamma one. The law is that of the distribution function, far out as well."""
    from riskloom.operators.kernels import Generators, student_law
    from riskloom.operators.simulate import student_cdf

    def source():
        return Generators(lambda s: np.random.Generator(np.random.SFC64([7, s])), 50)

    one, other = source(), source()
    x = one.student(0, 0, 30_000, df)
    assert (x == np.concatenate([other.student(0, t, 600, df) for t in range(0, 30_000, 600)])).all()
    edges = np.concatenate((-np.geomspace(1e4, 1e-3, 100), np.geomspace(1e-3, 1e4, 100)))
    expected = np.diff(np.concatenate(([0.0], student_cdf(edges, df), [1.0]))) * x.size
    counts = np.histogram(x, np.concatenate(([-np.inf], edges, [np.inf])))[0]
    use = expected > 20
    assert abs(((counts - expected)[use] ** 2 / expected[use]).sum() - use.sum()) < 5 * np.sqrt(2 * use.sum())
    law = student_law(df)
    beyond = 2 * student_cdf(np.array(-law.begin), df) * x.size
    assert student_law(df) is law and abs((np.abs(x) > law.begin).sum() - beyond) < 5 * np.sqrt(beyond) + 1


@pytest.mark.parametrize("alpha", [0.1, 1e-9, 8.673617379884035e-19])
@pytest.mark.parametrize("df", [None, 4.5])
def test_garch_draws_are_those_of_the_recursion(alpha, df):
    """Also where draws cannot move the variance, for which no recursion is run."""
    from riskloom.operators.kernels import Generators, garch

    omega, beta, mu, n = 300.0, 0.85, 0.3, 900
    kernel = garch(omega, alpha, beta, mu, df)
    source, again = (Generators(lambda s: np.random.Generator(np.random.SFC64([3, s])), 80) for _ in range(2))
    state = kernel.begin(source, n)
    got = np.concatenate([kernel.draw(source, state, t, 100) for t in range(0, n, 100)])
    z = again.normal(0, 0, n) if df is None else again.student(0, 0, n, df) / np.sqrt(df / (df - 2))
    h = np.full(80, omega / (1 - alpha - beta))
    for x, row in zip(z, got):
        assert np.allclose(row, mu + x * np.sqrt(h), rtol=1e-10, atol=1e-10)
        h = omega + alpha * h * x * x + beta * h


def test_fits_pass_blocks_side_by_side():
    """A call for each row of each block, for all candidates, was most of a fit."""
    rng, calls = np.random.default_rng(4), []
    frame = pd.DataFrame({"series_id": ["a"] * 20 + ["b"] * 5, "block": [*range(20), *range(5)], "rows": [64] * 19 + [30] + [64] * 5})
    frame["e2"] = [rng.gamma(0.5, 2, n) for n in frame["rows"]]
    frame["alpha"], frame["beta"] = np.where(frame["series_id"] == "a", 0.02, np.nan), np.where(frame["series_id"] == "a", 0.8, np.nan)
    a, b = zip(*(models._candidates(row) for _, row in frame.iterrows()))
    frame["h"] = [1 + rng.random(len(x)) for x in a]

    def run(e2, *args):
        calls.append(e2.shape)
        return models._fit_of_block(e2, *args)

    fits = models._block_rows(frame, run)["values"]
    ends = models._block_rows(frame.drop(columns="h"), models._ends)["values"]
    assert sorted(calls) == [(30, 1, 1), (64, 3, 1), (64, 5, 1), (64, 16, 1)]
    for i, row in frame.iterrows():
        use = models._usable(a[i], b[i])
        w, h, total, end = 1 - a[i] - b[i], row["h"], 0.0, 0.0
        with np.errstate(all="ignore"):
            for x in row["e2"]:
                total = total - 0.5 * (np.log(h) + x / h)
                h, end = w + a[i] * x + b[i] * h, w + a[i] * x + b[i] * end
        assert np.allclose(fits[i][use], total[use], rtol=1e-12, atol=1e-9) and np.allclose(ends[i][use], end[use], rtol=1e-12)
        assert (fits[i][~use] == 0).all()
