"""Runs from a file to an export, settings, kernels by chunks, and blocked fits."""

import os

import numpy as np
import pandas as pd
import pytest

from riskloom.operators import kernels, models, reorder, reports, run, simulate
from riskloom.operators.kernels import Config, counter_uniform

TRADE = "series_id string, trade_idx long, pnl double, regime string"


def history(spark, **series):
    return spark.createDataFrame([(s, i, float(x), "up" if x > 0 else "down") for s, xs in series.items() for i, x in enumerate(xs)], TRADE)


@pytest.mark.parametrize("model", ["bootstrap", "permutation"])
def test_from_a_file_to_an_export(spark, tmp_path, model):
    rng = np.random.default_rng(1)
    lines = ["Trade number,Instrument,Entry time,Profit"] + [f"{i},{'ES' if i % 3 else 'NQ'},1/{i % 28 + 1}/2024 9:30,\"${x:,.2f}\"" for i, x in enumerate(rng.normal(20, 300, 120), 1)]
    (tmp_path / "grid.csv").write_text("\n".join(lines))
    done = run.run_file(spark, str(tmp_path / "grid.csv"), model, Config(paths=300, capital=5000))
    out = f"file://{tmp_path}/out"
    done.export(out)
    fields = {(r["series_id"], r["field"]): r["value"] for r in spark.read.csv(f"{out}/metadata", header=True).collect()}
    paths = spark.read.csv(f"{out}/paths", header=True, inferSchema=True).toPandas()
    assert set(paths["series_id"]) == {"ES", "NQ"} and len(paths) == 600 and (paths["terminal_pnl"] - paths["final_balance"] + 5000).abs().max() < 0.011
    assert (fields["ES", "n_simulations"], fields["ES", "trades"], fields["NQ", "trades"], fields["ES", "model"]) == ("300", "80", "40", model)
    valid = model == "bootstrap"
    assert (fields["ES", "terminal_pnl_metrics_valid"] == "true") == valid and (fields["ES", "var_95"] == "N/A") != valid
    if valid:
        own = np.sort(done.paths.where("series_id = 'ES'").toPandas()["final_balance"])
        assert float(fields["ES", "var_95"]) == pytest.approx(own[int(300 * (1 - 0.95))] - 5000, abs=1e-3)
    assert os.listdir(tmp_path / "out" / run.COMPLETE) and {"history", "regimes"} <= set(os.listdir(tmp_path / "out"))


def test_settings_change_reports(spark):
    df = history(spark, A=np.random.default_rng(2).normal(5, 100, 200))
    paths = models.simulate_history(df, "bootstrap", Config(paths=400, capital=1000, ruin_percent=20)).persist()
    other = reports.plans(reports.Settings(capital=1000, ruin_percent=20, periods=50, checkpoints=(10, 20)))
    got, default = (p["risk_metrics"].run(spark, paths=paths).first() for p in (other, reports.PLANS))
    x = np.sort(paths.toPandas()["final_balance"])
    assert got["var95"] == pytest.approx(x[20 - 1 if int(400 * (1 - 0.95)) == 19 else 20] - 1000, abs=1e-4) and default["var95"] == pytest.approx(got["var95"] - 9000, abs=1e-4)
    assert (got["years"], default["years"]) == (4, 1)
    assert sorted(r["n"] for r in other["convergence"].run(spark, paths=paths).collect()) == [10, 20, 400]
    paths.unpersist()


def plain_path(draws, config):
    """A path step by step, as the rules say it."""
    balance = peak = config.capital
    fall, outcome, event, best, ruined = 0.0, "time", None, -np.inf, False
    losses = lost = 0.0
    drawdown, target, share = config.rules
    for t, x in enumerate(draws):
        if config.session and t % config.session.trades == 0:
            losses = lost = 0.0
        before = balance
        if not config.session or (losses < config.session.max_losses and lost > -config.session.max_loss):
            balance = max(balance * (1 + x), 0) if config.multiplicative else balance + x
        losses, lost = losses + (balance < before), lost + balance - before
        peak, best = max(peak, balance), max(best, balance - before)
        fall = max(fall, min(1, (peak - balance) / max(peak, 1e-8)))
        ruined |= balance <= config.capital * (1 - config.ruin_percent / 100)
        if outcome == "time":
            if peak - balance >= drawdown:
                outcome, event = "drawdown", t + 1
            elif balance - config.capital >= target:
                outcome, event = ("passed" if best <= (balance - config.capital) * share / 100 else "consistency"), t + 1
    return balance, fall, ruined, outcome, event


@pytest.mark.parametrize("config", [Config(paths=60), Config(paths=60, multiplicative=True), Config(paths=60, session=kernels.Session(4, 2, 90.0)), Config(paths=60, counter=True, rules=(150, 120, 60))])
def test_walks_equal_single_steps(config):
    rng = np.random.default_rng(3)
    pool = rng.normal(0.001, 0.05, 300) if config.multiplicative else rng.normal(3, 40, 300)
    config = kernels.Config(**{**config.__dict__, "steps": 500})
    kernel = kernels.block_bootstrap(pool, 4)
    got = kernels.walk(0, kernel, config, chunk=60 * 7)
    whole = kernels.walk(0, kernel, config)
    pd.testing.assert_frame_equal(got, whole)
    ids = np.arange(60)
    source = kernels.Counters(config.seed, ids, 500) if config.counter else kernels.Generators(lambda s: np.random.Generator(np.random.SFC64([config.seed, s, 0])), 60)
    draws = kernel.draw(source, kernel.begin(source, 500), 0, 500)
    for i, row in got.iterrows():
        final, fall, ruined, outcome, event = plain_path(draws[:, i], config)
        assert (row.outcome, row.ruined, None if pd.isna(row.event_step) else row.event_step) == (outcome, ruined, event)
        assert [row.final_balance, row.max_drawdown] == pytest.approx([final, fall], rel=1e-9)


def test_kernels_do_not_depend_on_chunks():
    pool = np.random.default_rng(4).normal(0, 10, 400)
    made = {"bootstrap": kernels.bootstrap(pool), "permutation": kernels.permutation(pool), "regimes": kernels.regime_switching({"a": pool[:100], "b": pool[100:]}, np.array([[0.7, 0.3], [0.2, 0.8]])), "normal": kernels.parametric(0, 5, None), "student": kernels.parametric(0, 5, 4.0), "garch": kernels.garch(1.0, 0.1, 0.8, 0.0, 6.0)}
    for name, kernel in made.items():
        for counter in (True, False):
            config = Config(paths=30, steps=400, counter=counter)
            pd.testing.assert_frame_equal(kernels.walk(0, kernel, config, chunk=30 * 13), kernels.walk(0, kernel, config), obj=name)


def test_counter_draws_have_their_laws():
    source = kernels.Counters(1, np.arange(100), 2000)
    t = source.student(0, 0, 2000, 5.0).ravel()
    z = source.normal(4, 0, 2000).ravel()
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs(t.std() - np.sqrt(5 / 3)) < 0.02 and abs(np.quantile(t, 0.95) - 2.015048) < 0.03
    assert counter_uniform(42, np.arange(1, 5)).max() < 1


def test_blocked_garch_fits_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS", 128)
    rng = np.random.default_rng(5)
    series = {"A": simulate.garch(1.0, 0.1, 0.8, 0.3)(rng, 1500), "B": simulate.garch(1.0, 0.2, 0.5, 0.0)(rng, 300), "C": rng.normal(0, 1, 12), "D": np.ones(50)}
    got = {r["series_id"]: r for r in models.garch_models(history(spark, **series)).collect()}
    for name, x in series.items():
        plain = models.fit_garch(pd.DataFrame({"series_id": name, "trade_idx": range(len(x)), "pnl": x})).iloc[0]
        assert [got[name][c] for c in ("n", "mu", "omega", "alpha", "beta")] == pytest.approx([plain[c] for c in ("n", "mu", "omega", "alpha", "beta")], abs=1e-9)
        assert got[name]["log_likelihood"] == pytest.approx(plain.log_likelihood, abs=1e-6, nan_ok=True)


def test_reordering_keeps_values_and_takes_ranks(spark):
    rng = np.random.default_rng(6)
    series = {"A": rng.normal(0, 5, 400), "B": rng.gamma(2, 3, 400)}
    z = rng.normal(0, 1, 400)
    scores = spark.createDataFrame([(s, i, float(z[i] + rng.normal(0, 0.3))) for s in series for i in range(400)], "series_id string, trade_idx long, score double")
    out = reorder.reorder(history(spark, **series), scores).toPandas()
    wide = out.pivot(index="trade_idx", columns="series_id", values="pnl")
    assert all(np.array_equal(np.sort(wide[s]), np.sort(x)) for s, x in series.items()) and wide.corr("spearman").iloc[0, 1] > 0.8
    kept = scores.toPandas()
    for s, x in series.items():
        mine = kept[kept["series_id"] == s].sort_values("trade_idx")["score"].rank()
        assert (wide[s].rank().to_numpy() == mine.to_numpy()).all()


