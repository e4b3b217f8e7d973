"""Exact fixtures of the operators."""

import math

import numpy as np
import pytest

from riskloom.operators import ingest, models, performance, portfolio, simulate, stats, stress, validation
from riskloom.plans import catalog
from riskloom.plans.engine import Plan
from riskloom.sources import trades as sources


def trades(spark, pnl, regime=None, series="A"):
    rows = [(series, i, float(x), (regime or ["r"] * len(pnl))[i], 0.0) for i, x in enumerate(pnl)]
    return spark.createDataFrame(rows, "series_id string, trade_idx long, pnl double, regime string, benchmark double")


def one(df):
    return df.first().asDict()


def test_historical_stats(spark):
    got = one(performance.PLANS["historical_stats"].run(spark, trades=trades(spark, [100, -50, 200, -30, 150, -80, 50, -20, 300, -100])))
    assert (got["total_trades"], got["win_rate"], got["expectancy"], got["max_consecutive_losses"]) == (10, 50, 52, 1)
    assert got["profit_factor"] == round(800 / 280, 6) and got["sharpe"] > 0 and 0 < got["kelly"] < 1


def test_only_losses_and_only_wins(spark):
    got = one(performance.PLANS["historical_stats"].run(spark, trades=trades(spark, [-10, -20, -30, -40, -50])))
    assert (got["win_rate"], got["kelly"], got["max_consecutive_losses"], got["profit_factor"]) == (0, 0, 5, 0)
    assert one(performance.PLANS["historical_stats"].run(spark, trades=trades(spark, [1, 2])))["profit_factor"] == math.inf


def test_no_trades(spark):
    assert performance.PLANS["historical_stats"].run(spark, trades=trades(spark, [1]).limit(0)).count() == 0


def test_drawdown_periods(spark):
    # 10000, 9000, 8000, 9500, 10500, 9500, 11000
    df = trades(spark, [-1000, -1000, 1500, 1000, -1000, 1500])
    rows = sorted((r["start_t"], r["end_t"], r["duration"], r["recovered"]) for r in performance.PLANS["drawdown_periods"].run(spark, trades=df).collect())
    assert rows == [(1, 4, 3, 1), (5, 6, 1, 1)]
    got = one(performance.PLANS["time_under_water"].run(spark, trades=df))
    assert (got["max_duration"], got["current_duration"]) == (3, 0)


def test_regime_transitions(spark):
    df = trades(spark, range(8), ["n"] * 4 + ["c"] * 4)
    got = {(r["from_regime"], r["to_regime"]): r["p"] for r in stats.PLANS["regime_transitions"].run(spark, trades=df).collect()}
    assert got["n", "c"] == 0.25 and got["c", "c"] == 1
    assert np.allclose(models.transition_matrix(["n"] * 4 + ["c"] * 4, ["n", "c"]), [[0.75, 0.25], [0, 1]])


def test_calendar(spark):
    rows = [("A", i, x, "r", 0.0, f"2024-01-0{d} 10:00:00") for i, (x, d) in enumerate([(100.0, 1), (-50.0, 1), (30.0, 2), (40.0, 2), (50.0, 2)])]
    df = spark.createDataFrame(rows, "series_id string, trade_idx long, pnl double, regime string, benchmark double, ts string").selectExpr("*", "cast(ts as timestamp_ntz) as t2").drop("ts").withColumnRenamed("t2", "ts")
    got = one(stats.PLANS["calendar_report"].run(spark, trades=df))
    assert (got["trading_days"], got["best"], got["worst"], got["limit_breaches"], got["win_streak"], got["loss_streak"]) == (2, 120, 50, 0, 2, 0)


def test_stress(spark):
    got = {r["scenario"]: r for r in stress.PLANS["stress_scenarios"].run(spark, trades=trades(spark, [10, -5, 20, -10, 15, -2, -3, -5, 10, -8])).collect()}
    assert got["black_swan"]["capital_after"] == 10000 + 22 - 150 and got["losses_2"]["capital_after"] == 10000 + 22 - 33
    assert got["worst_5"]["capital_after"] == 10000 - 8 and (got["worst_20"]["capital_after"], got["worst_20"]["max_drawdown"]) == (10000, 0)


def test_parsing(spark):
    cells = ["150", "-20", "($50)", "$1,234.5", "", "n/a", "$", " 7 ", "1e3", "NaN", "1d", None]
    raw = spark.createDataFrame([(i, "x", c, "y") for i, c in enumerate(cells)], "event_id long, instrument string, profit string, in_regime string")
    got = [r["pnl"] for r in ingest.PLANS["parse_financial"].run(spark, raw=raw).orderBy("event_id").collect()]
    assert got == [150, -20, -50, 1234.5, None, None, 0, 7, 1000, None, None, None]


def test_columns(spark):
    df = spark.createDataFrame([(0, 0, "1", None, "x")], f"{sources.ORDER} long, Idx int, ` Profit ` string, Instrument string, ` In Regime` string")
    assert sources.find_column(df, "profit") == " Profit " and not sources.is_platform_grid(df)
    assert sources.find_in_regime_column(df) == " In Regime" and sources.find_in_regime_column(df.drop(" In Regime")) is None


def test_wide_csv(spark, tmp_path):
    """Sleeves from numeric columns, in the order of the file, blanks closing up."""
    head = ["trade", "Qty", *(f"S{i}" for i in range(9)), "note"]
    lines = [",".join(head)] + [",".join([str(i), "7", *("" if i == 1 and k == 0 else f'"$1,{i}0{k}.5"' if k == 1 else f"({i + k})" for k in range(9)), "n/a"]) for i in range(60)]
    (tmp_path / "wide.csv").write_text("\n".join(lines) + "\n\n")
    table = sources.csv_scan(spark, str(tmp_path / "wide.csv"))
    assert table.count() == 60
    roles = sources.roles_of(table)
    assert [name for name, _, _ in roles.sleeves] == ["trade", *(f"S{i}" for i in range(9))] and sum(on for _, _, on in roles.sleeves) == 4
    assert sum(w for _, w, _ in roles.sleeves) == pytest.approx(1)
    got = sources.trades_of(table, roles).orderBy("series_id", "trade_idx").toPandas()
    s0 = got[got["series_id"] == "S0"]
    assert list(s0["trade_idx"]) == list(range(59)) and list(s0["pnl"][:3]) == [-0.0, -2.0, -3.0]
    assert list(got[got["series_id"] == "S1"]["pnl"][:2]) == [1001.5, 1101.5]
    assert sources.column_roles(table.select("note", sources.ORDER)).sleeves == () and sources.numeric_columns(table.limit(0)) == []


def test_grid_csv(spark, tmp_path):
    rows = ["Trade number,Instrument,Profit,Entry time,In_Regime,Bench", "1,ES,($11.90),1/15/2024 09:30:00,yes,1.5", "2,NQ,$909.24,2024-01-15T09:30:00Z,no,x", "3,ES,,1/16/2024,no,2", "4,ES,7,bad,no,", "5, ,7,0,no,1"]
    (tmp_path / "grid.csv").write_text("\n".join(rows))
    table = sources.csv_scan(spark, str(tmp_path / "grid.csv"))
    roles = sources.roles_of(table)
    assert sources.is_platform_grid(table) and roles.sleeves == (("ES", 0.5, True), ("NQ", 0.5, True)) and roles.data_format == "absolute" and roles.commission == 0
    out = sources.trades_of(table, sources.replace(roles, benchmark="Bench", benchmark_percent=True)).orderBy("series_id", "trade_idx").collect()
    assert [(r["series_id"], r["trade_idx"], r["pnl"], r["benchmark"]) for r in out] == [("ES", 0, -11.9, 0.015), ("ES", 1, 7.0, None), ("NQ", 0, 909.24, None)]
    assert out[0]["ts"] == out[2]["ts"] and str(out[0]["ts"]) == "2024-01-15 09:30:00" and out[1]["ts"] is None


def test_special_functions(spark):
    def value(sql):
        return Plan(f"WITH x AS (SELECT 1 AS one FROM $trades) SELECT {sql} AS v FROM x").run(spark, trades=trades(spark, [1])).first()[0]

    for x in (1.0, 5.0, 0.5):
        assert value(stats.log_gamma(f"CAST({x} AS DOUBLE)")) == pytest.approx(math.lgamma(x), abs=1e-10)
    assert value(stats.chi_square_upper("CAST(18.307 AS DOUBLE)", 10)) == pytest.approx(0.05, abs=1e-5)
    assert value(stats.normal_cdf("CAST(1.96 AS DOUBLE)")) == pytest.approx(0.975, abs=1e-4)
    assert value(stats.ad_p("CAST(2.492 AS DOUBLE)")) == pytest.approx(0.05)


def test_cholesky():
    low = portfolio.cholesky(np.array([[1, 0.8], [0.8, 1]]))
    assert np.allclose(low @ low.T, [[1, 0.8], [0.8, 1]])
    assert portfolio.cholesky(np.array([[1, 1.5], [1.5, 1]])) is None
    assert portfolio.cholesky(portfolio.repaired(np.array([[1, 1.5], [1.5, 1]]))) is not None


def test_kernels_ignore_partitions(spark):
    config = simulate.Config(paths=300, steps=20)
    kernel = simulate.block_bootstrap(np.array([10.0, -5, 3, -20, 8]), 3)
    first = simulate.simulate(spark, kernel, config).orderBy("sim_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert simulate.simulate(spark, kernel, config).repartition(3).orderBy("sim_id").collect() == first
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_permutation_keeps_the_sum(spark):
    rows = simulate.simulate(spark, simulate.permutation(np.arange(10.0)), simulate.Config(paths=20, steps=10)).collect()
    assert {r["final_balance"] for r in rows} == {10045.0}


def test_session_rule_and_outcomes():
    config = simulate.Config(session=simulate.Session(trades=4, max_losses=1, max_loss=1000), rules=(100, 50, 100))
    balance = simulate._balances(np.array([[-10.0, 99, 99, 99, 60, 0, 0, 0]]), config)
    assert balance[0].tolist() == [10000, 9990, 9990, 9990, 9990, 10050, 10050, 10050, 10050]
    row = simulate.reduce_paths(np.array([0]), balance, config).iloc[0]
    assert row.outcome == "consistency"


def test_garch_recovers_persistence(spark):
    rng = np.random.default_rng(5)
    x = simulate.garch(1.0, 0.1, 0.8, 0.0)(rng, 2000)
    fit = models.fit_garch(__import__("pandas").DataFrame({"series_id": "A", "trade_idx": range(2000), "pnl": x})).iloc[0]
    assert fit.alpha + fit.beta < 1 and abs(fit.alpha + fit.beta - 0.9) < 0.1


def test_paths_are_as_long_as_the_history(spark):
    pnl = {"A": [float(i % 7 - 3) for i in range(300)], "B": [float(i % 5) for i in range(140)]}
    df = trades(spark, pnl["A"]).union(trades(spark, pnl["B"], series="B"))
    rows = simulate.PLANS["permutation_paths"].run(spark, pool=df).collect()
    assert {(r["series_id"], r["final_balance"]) for r in rows} == {(s, 10000 + sum(x)) for s, x in pnl.items()}
    last = simulate.PLANS["spaghetti_sample"].run(spark, pool=df).groupBy("series_id").agg({"t": "max"}).collect()
    assert {tuple(r) for r in last} == {("A", 300), ("B", 140)}
    for model in ("permutation", "regimes", "garch"):
        rows = models.simulate_history(df, model, simulate.Config(paths=40)).collect()
        assert sorted((r["series_id"], r["sim_id"]) for r in rows) == [(s, i) for s in "AB" for i in range(40)]
        if model == "permutation":
            assert {(r["series_id"], r["final_balance"]) for r in rows} == {(s, 10000 + sum(x)) for s, x in pnl.items()}
    sizes = {r["series_id"]: r for r in models.position_size(df, simulate.Config(paths=50), halvings=2).collect()}
    assert sizes["B"]["passes"] and sizes["B"]["scale"] == 1 and abs(sizes["B"]["mean"] - 280) < 60
    assert sizes["A"]["scale"] < 1
    bad = one(models.position_size(trades(spark, [100.0, -100.0] * 100), simulate.Config(paths=50), halvings=2))
    assert not bad["passes"] and bad["scale"] == 0.05


def test_size_is_found_by_halving(spark):
    """Full size is too much risk of ruin, a part of it is not."""
    x = np.random.default_rng(2).normal(120, 300, 250)
    got = one(models.position_size(trades(spark, x), simulate.Config(paths=400, capital=1500), halvings=4))
    assert got["passes"] and 0.05 < got["scale"] < 1 and got["ruin_percent"] < 2


def test_fitted_degrees_of_freedom():
    rng = np.random.default_rng(5)
    assert models.fitted_df(50 + 15 * rng.standard_t(4, 500)) < 15 and models.fitted_df(rng.normal(0, 3, 2000)) is None and models.fitted_df(np.ones(9)) is None


def test_portfolio_copulas(spark):
    """Two legs that move together: their joint result spreads as both do, not less."""
    base = np.random.default_rng(6).normal(0, 10, 120)
    df = trades(spark, base).union(trades(spark, base * 2, series="B"))
    for kind in ({}, {"df": 5.0}, {"dynamic": True}):
        got = models.simulate_portfolio(df, simulate.Config(paths=60, steps=5), **kind).toPandas()
        assert sorted(got["sim_id"]) == list(range(60)) and 45 < got["final_balance"].std() < 95
    assert np.allclose(simulate.normal_cdf(np.array([-1.96, 0.0, 1.96])), [0.025, 0.5, 0.975], atol=1e-4)


def test_series_that_are_short_or_fall_to_nothing(spark):
    """No series is lost: 10 trades, one loss of everything, and only gains."""
    df = trades(spark, [5.0] * 10, series="gains").union(trades(spark, [10.0, -100000.0, 10.0], series="lost")).union(trades(spark, list(range(-30, 30)), series="long"))
    for name in ("auto_regime", "time_under_water", "worst_window", "worst_survivable", "equity_curve_multiplicative"):
        plan = performance.PLANS.get(name) or stress.PLANS[name]
        assert {r["series_id"] for r in plan.run(spark, trades=df).collect()} == {"gains", "lost", "long"}, name
    assert {r["regime"] for r in performance.PLANS["auto_regime"].run(spark, trades=df).where("series_id <> 'long'").collect()} == {"Dispersed"}
    equity = {(r["series_id"], r["t"]): r["equity"] for r in performance.PLANS["equity_curve_multiplicative"].run(spark, trades=df).collect()}
    assert equity["lost", 1] == 10001 and equity["lost", 2] == 0 and equity["lost", 3] == 0
    under = {r["series_id"]: r["max_duration"] for r in performance.PLANS["time_under_water"].run(spark, trades=df).collect()}
    assert under["gains"] == 0 and under["lost"] == 1
    worst = {r["series_id"]: r for r in stress.PLANS["worst_survivable"].run(spark, trades=df).collect()}
    assert worst["lost"]["surviving"] < 10 and worst["gains"]["scenario"] is not None


def test_tails_of_any_degrees_of_freedom(spark):
    df = spark.createDataFrame([(i, x, k) for i, (x, k) in enumerate([(3.841459, 1), (16.918978, 9), (18.307038, 10), (0.0, 3), (-1.0, 1), (500.0, 2), (5.991465, 2)])], "id long, stat double, df long")
    got = [r["p"] for r in Plan("WITH " + validation.upper_tail("spark", "t", "$src", "id, df", "stat", "df") + " SELECT id, p FROM t", {"src": "src"}).run(spark, src=df).orderBy("id").collect()]
    assert got == pytest.approx([0.05, 0.05, 0.05, 1, 1, 0, 0.05], abs=1e-6)


def test_validation_report(spark):
    """A well-behaved history passes; one whose size of moves comes in waves fails its VaR."""
    rng = np.random.default_rng(8)
    calm, waves = rng.normal(0, 9, 600), rng.normal(0, 1, 600) * np.repeat([1, 40, 1, 40, 1, 40], 100)
    df = trades(spark, calm).union(trades(spark, waves, series="waves")).union(trades(spark, [1.0, -1.0] * 10, series="short")).cache()
    got = {r["series_id"]: r for r in validation.PLANS["validation_report"].run(spark, trades=df, pool=df).collect()}
    assert got["A"]["overall"] != "fail" and got["waves"]["var_backtest"] == "fail" and got["waves"]["overall"] == "fail"
    assert got["short"]["var_backtest"] == got["short"]["calibration"] == got["short"]["serial_dependence"] == "not run"
    back = {r["series_id"]: r for r in validation.PLANS["var_backtest"].run(spark, trades=df).collect()}
    assert back["A"]["kupiec_p"] > 0.05 and set(back) == {"A", "waves"}


def test_bound_to_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    count = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name, column in (("preview_stats", "total_trades"), ("garch_variance", "1"), ("special_functions", "1")):
        assert catalog.QUERIES[name](spark, sf_dir).selectExpr(f"sum({column})").first()[0] == count


def test_garch_variance_of_a_long_series(spark):
    pnl = np.random.default_rng(3).normal(1, 20, 9000)
    h, expected = pnl.var(ddof=1), []
    for x in pnl:
        expected.append(h)
        h = 0.02 * pnl.var(ddof=1) + 0.08 * (x - pnl.mean()) ** 2 + 0.9 * h
    got = performance.PLANS["garch_variance"].run(spark, trades=trades(spark, pnl)).orderBy("trade_idx").toPandas()
    assert np.allclose(got["variance"], expected, atol=1e-4)


def test_backtests_judge_every_trade(spark):
    pnl = np.round(np.random.default_rng(8).normal(0, 9, 1300), 1)
    df = trades(spark, pnl)
    expected = [int(x < np.sort(pnl[i - 100 : i])[5]) for i, x in enumerate(pnl) if i >= 100]
    rows = stats.PLANS["var_breaches"].run(spark, trades=df).orderBy("trade_idx").collect()
    assert [(r["trade_idx"], r["breach"]) for r in rows] == list(enumerate(expected, 100))
    got = one(stats.PLANS["kupiec"].run(spark, trades=df))
    assert (got["n"], got["x"]) == (1200, sum(expected))
    got = one(stats.PLANS["christoffersen"].run(spark, trades=df))
    assert got["n00"] + got["n01"] + got["n10"] + got["n11"] == 1199
    u = [max(0, ((pnl[i - 100 : i] <= pnl[i]).sum() - 0.5) / 100) for i in range(100, 1300)]
    bins = {r["bin"]: r["n"] for r in stats.PLANS["pit_calibration"].run(spark, trades=df).collect()}
    assert bins == {b: n for b, n in enumerate(np.bincount(np.minimum(9, np.floor(np.array(u) * 10).astype(int)), minlength=10)) if n}
