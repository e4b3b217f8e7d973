"""Statistics against plain Python written from their rules, at the places where they break."""

import math

import numpy as np
import pytest

from riskloom.operators import ingest, performance, reports, simulate, stats, stress
from riskloom.plans import catalog
from riskloom.plans.engine import Plan
from riskloom.operators.orderstats import first, order_stats, position

TRADE = "series_id string, trade_idx long, pnl double, regime string, benchmark double"


def table(spark, series, regime=None, benchmark=None):
    rows = [(s, i, float(x), regime(i) if regime else "r", float(benchmark(i)) if benchmark else None) for s, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, TRADE)


def by_series(plan, spark, **inputs):
    return {r["series_id"]: r for r in plan.run(spark, **inputs).collect()}


def hill(losses):
    x = sorted(v for v in losses if v > 0)
    n, k = len(x), max(20, min(250, len(x) // 10))
    if n < 20 or k >= n:
        return None
    mean = sum(math.log(x[n - 1 - i]) - math.log(x[n - k - 1]) for i in range(k)) / k
    return 1 / mean if mean > 1e-9 else None


def test_tail_report_keeps_series_without_a_fit(spark):
    rng = np.random.default_rng(1)
    series = {"long": rng.pareto(3, 400) + 1, "forty": rng.pareto(3, 40) + 1, "equal": [5.0] * 60, "few": [1.0] * 29, "twenty": list(range(1, 21))}
    df = table(spark, series)
    got = by_series(stats.PLANS["evt_report"], spark, trades=df)
    assert set(got) == {"long", "forty", "equal"}
    assert got["long"]["var95"] is not None and got["forty"]["var95"] is None and got["forty"]["note"].startswith("too few")
    for name in got:
        x = sorted(series[name])
        assert got[name]["empirical_var95"] == pytest.approx(x[min(len(x) - 1, int(len(x) * 0.95))], abs=1e-5)
        tail = x[max(1, int(len(x) * 0.95)) :]
        assert got[name]["empirical_cvar95"] == pytest.approx(sum(tail) / len(tail), abs=1e-5)
        assert got[name]["alpha"] == (pytest.approx(hill(x), abs=1e-5) if hill(x) else None)
        assert got[name]["heavy_tail"] == int((hill(x) or 99) < 4 or name == "long" and got[name]["heavy_tail"])
    alphas = by_series(stats.PLANS["hill_index"], spark, trades=df)
    assert {k: (v["k"], v["alpha"] is None) for k, v in alphas.items()} == {"long": (40, False), "forty": (20, False), "equal": (20, True), "few": (20, True), "twenty": (20, True)}


def ks(a, b):
    if not a or not b:
        return 1.0
    pooled, i, j, d = sorted([(v, 0) for v in a] + [(v, 1) for v in b]), 0, 0, 0.0
    for _, s in pooled:
        i, j = i + (s == 0), j + (s == 1)
        d = max(d, abs(i / len(a) - j / len(b)))
    return d


def test_two_samples_of_which_one_is_empty(spark):
    rng = np.random.default_rng(2)
    rows = [("both", i, float(round(v, 1)), "a" if i % 3 else "z", None) for i, v in enumerate(rng.normal(0, 5, 90))]
    rows += [("one", i, float(i), "a", None) for i in range(30)] + [("single", 0, 1.0, "z", None), ("nearly", 0, 1.0, "z", None), ("nearly", 1, 2.0, "a", None)]
    df = spark.createDataFrame(rows, TRADE)
    got = by_series(stats.PLANS["ks_two_sample"], spark, trades=df)
    for name in ("both", "one", "single", "nearly"):
        a, b = ([r[2] for r in rows if r[0] == name and (r[3] < "m") == low] for low in (True, False))
        assert got[name]["d"] == pytest.approx(ks(a, b), abs=1e-7), name
    assert got["one"]["p"] == got["single"]["p"] == 0 and 0 <= got["both"]["p"] <= 1
    ad = by_series(stats.PLANS["ad_two_sample"], spark, trades=df)
    assert all(ad[n]["a2"] is None and ad[n]["p"] == 1 for n in ("one", "single", "nearly")) and ad["both"]["a2"] > 0


def test_regression_of_columns_that_do_not_vary(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(2, 5, 50)
    flat = by_series(stats.PLANS["ols_robust"], spark, trades=table(spark, {"A": y}, benchmark=lambda i: 0.01))["A"]
    assert (flat["beta"], flat["alpha"], flat["r_squared"]) == (0, pytest.approx(y.mean(), abs=1e-6), 0) and flat["beta_se"] is flat["alpha_p"] is None
    still = by_series(stats.PLANS["ols_robust"], spark, trades=table(spark, {"A": [0.1] * 50}, benchmark=lambda i: i * 0.1))["A"]
    assert (still["r_squared"], still["beta"]) == (0, 0) and still["beta_se"] is None
    x = np.arange(50) * 0.1
    good = by_series(stats.PLANS["ols_robust"], spark, trades=table(spark, {"A": y}, benchmark=lambda i: i * 0.1))["A"]
    design = np.stack([np.ones(50), x], 1)
    coef = np.linalg.solve(design.T @ design, design.T @ y)
    e = y - design @ coef
    inverse = np.linalg.inv(design.T @ design)
    cov = inverse @ (design.T * e**2) @ design @ inverse
    assert [good["alpha"], good["beta"], good["alpha_se"], good["beta_se"]] == pytest.approx([*coef, *np.sqrt(np.diag(cov))], abs=1e-4)
    report = by_series(stats.PLANS["attribution_report"], spark, trades=table(spark, {"A": y}, benchmark=lambda i: 0.01))["A"]
    assert (report["correlation"], report["down_capture"]) == (0, 0) and report["alpha_annualized"] == pytest.approx(y.mean() * 50, abs=1e-3)


def test_short_series_under_stress(spark):
    got = stress.PLANS["stress_scenarios"].run(spark, trades=table(spark, {"A": [-900.0] * 7})).collect()
    severity = {r["scenario"]: r["severity"] for r in got}
    assert severity["worst_5"] == "extreme" and severity["worst_10"] == severity["worst_20"] == "low"


def test_null_keys_and_other_columns(spark):
    rows = [(s, i, float(i % 5 - 2), r, None, 7, 8.0) for s in ("A", None) for i, r in enumerate(["x", None, "y"] * 20)]
    df = spark.createDataFrame(rows, TRADE + ", n int, equity double")
    for name in ("historical_stats", "time_under_water", "loss_streaks", "running_drawdown", "rolling_win_rate"):
        assert {r["series_id"] for r in performance.PLANS[name].run(spark, trades=df).collect()} == {"A", "default"}, name
    regimes = performance.PLANS["historical_stats_by_regime"].run(spark, trades=df).collect()
    assert {(r["series_id"], r["regime"], r["total_trades"]) for r in regimes} == {(s, x, 20) for s in ("A", "default") for x in ("x", "y", "default")}
    assert sum(r["n"] for r in stats.PLANS["regime_transitions"].run(spark, trades=df).collect()) == 2 * 59


def plain_stats(x):
    equity = np.concatenate(([10000.0], 10000 + np.cumsum(x)))
    peak = np.maximum.accumulate(equity)
    streak = longest = 0
    for v in x:
        streak = streak + 1 if v < 0 else 0
        longest = max(longest, streak)
    year = math.sqrt(min(252, len(x)))
    down = math.sqrt((x[x < 0] ** 2).mean()) if (x < 0).any() else 0
    return [len(x), longest, ((peak - equity) / peak).max(), x.sum() / (peak - equity).max(), x.mean() / x.std(ddof=1) * year, x.mean() / down * year]


def test_statistics_over_blocks_and_within_one(spark):
    """Series of many blocks, of one, and with numbers far apart, against whole arrays."""
    rng = np.random.default_rng(5)
    series = {"long": np.round(rng.normal(0.3, 20, 20_000), 2), "short": np.round(rng.normal(0.3, 20, 90), 2)}
    df = table(spark, series)
    far = df.where("series_id = 'short'").selectExpr("'far' AS series_id", "trade_idx * 1000003 AS trade_idx", "pnl", "regime", "benchmark")
    got = by_series(performance.PLANS["historical_stats"], spark, trades=df.union(far))
    for name, x in (*series.items(), ("far", series["short"])):
        r = got[name]
        assert [r[c] for c in ("total_trades", "max_consecutive_losses", "max_drawdown", "recovery_factor", "sharpe", "sortino")] == pytest.approx(plain_stats(x), abs=2e-6)
    curve = performance.PLANS["running_drawdown"].run(spark, trades=df.where("series_id = 'long'")).orderBy("t").toPandas()
    equity = np.concatenate(([10000.0], 10000 + np.cumsum(series["long"])))
    peak = np.maximum.accumulate(equity)
    assert np.allclose(curve["peak"], peak, atol=1e-3) and np.allclose(curve["drawdown"], (peak - equity) / peak, atol=1e-7)
    under = by_series(performance.PLANS["time_under_water"], spark, trades=df)["long"]
    runs, begin = [], None
    for t, low in enumerate([*(equity < peak), False]):
        if low and begin is None:
            begin = t
        if not low and begin is not None:
            runs.append((begin, min(t, len(equity) - 1)))
            begin = None
    assert under["max_duration"] == max(e - b for b, e in runs) and under["share_under"] == pytest.approx(sum(e - b for b, e in runs) / 20_000, abs=1e-7)


def test_no_task_holds_a_long_series(spark):
    """Windows over a series' rows are parted by blocks as well."""
    for name in ("equity_curve", "running_drawdown", "historical_stats", "time_under_water"):
        plan = performance.PLANS[name].run(spark, trades=table(spark, {"A": range(10)}))._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line and "specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())" in line]
        assert windows and all("blk" in line for line in windows), name


@pytest.mark.parametrize("values", ["spread", "ties", "outlier"])
def test_order_statistics_without_sorting_a_group(spark, values):
    rng = np.random.default_rng(7)
    x = {"spread": rng.normal(0, 1, 5000), "ties": rng.integers(0, 4, 5000).astype(float), "outlier": np.append(rng.normal(0, 1, 999), 1e12)}[values]
    df = spark.createDataFrame([("A", float(v)) for v in x] + [("B", 3.0), ("B", None)], "g string, v double").repartition(5)
    shares = {"a": "0.05", "b": "0.5", "c": "0.999"}
    text = order_stats("spark", "os", "$t", "g", "v", {k: position(f"CAST({p} AS DOUBLE)") for k, p in shares.items()}, {"m": first("CAST(0.05 AS DOUBLE)"), "q": first("CAST(0.6 AS DOUBLE)")})
    got = {r["g"]: r for r in Plan(f"WITH {text} SELECT * FROM os", {"t": "t"}).run(spark, t=df).collect()}
    s = np.sort(x)
    assert [got["A"][k] for k in "abc"] == [s[min(len(s) - 1, int(len(s) * float(p)))] for p in shares.values()]
    assert [got["A"]["m"], got["A"]["q"]] == pytest.approx([s[: int(len(s) * 0.05)].mean(), s[: int(len(s) * 0.6)].mean()], rel=1e-9)
    assert (got["B"]["n"], got["B"]["a"], got["B"]["m"]) == (1, 3, 3)


def paths(spark, finals, **more):
    base = {"max_drawdown": 0.1, "ruined": False, "steps": 100, "outcome": "time", "event_step": None} | more
    return spark.createDataFrame([("A", i, float(f), base["max_drawdown"], base["ruined"], base["steps"], base["outcome"], base["event_step"]) for i, f in enumerate(finals)], "series_id string, sim_id long, final_balance double, max_drawdown double, ruined boolean, steps long, outcome string, event_step long")


def test_reports_of_paths_that_do_not_vary(spark):
    got = by_series(reports.PLANS["risk_metrics"], spark, paths=paths(spark, [10250.1] * 300))["A"]
    assert (got["skewness"], got["excess_kurtosis"], got["var95"], got["probability_of_loss"]) == (0, 0, 250.1, 0)


def test_risk_metrics_against_numpy(spark):
    x = np.random.default_rng(11).gamma(2, 900, 10_000) + 8000
    got = by_series(reports.PLANS["risk_metrics"], spark, paths=paths(spark, x))["A"]
    s, c = np.sort(x), x - x.mean()
    want = [s[int(10_000 * (1 - 0.95))] - 10_000, s[: int(10_000 * (1 - 0.99))].mean() - 10_000, s[5000], (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2 - 3, 100 * (x < 10_000).mean()]
    assert [got[k] for k in ("var95", "cvar99", "median_balance", "skewness", "excess_kurtosis", "probability_of_loss")] == pytest.approx(want, abs=1e-5)


def test_convergence_of_few_and_of_many_paths(spark):
    x = np.random.default_rng(12).normal(10_000, 5, 3000)
    few = reports.PLANS["convergence"].run(spark, paths=paths(spark, x[:200])).collect()
    assert sorted(r["n"] for r in few) == [100, 200]
    assert by_series(reports.PLANS["convergence_status"], spark, paths=paths(spark, x[:200]))["A"]["status"] == "not_converged"
    many = {r["n"]: r for r in reports.PLANS["convergence"].run(spark, paths=paths(spark, x)).collect()}
    assert sorted(many) == [100, 200, 500, 1000, 2000, 3000]
    for n, r in many.items():
        assert r["var95"] == pytest.approx(np.sort(x[:n])[int(n * (1 - 0.95))] - 10_000, abs=1e-5) and r["mean_balance"] == pytest.approx(x[:n].mean(), abs=1e-5)


def test_prop_evaluation_of_outcomes(spark):
    df = paths(spark, range(60), outcome="passed", event_step=5).union(paths(spark, range(60, 100))).union(paths(spark, range(100, 140), outcome="drawdown", event_step=9))
    got = {r["outcome"]: (r["paths"], r["median_trades"]) for r in reports.PLANS["prop_evaluation"].run(spark, paths=df).collect()}
    assert got == {"passed": (60, 5), "time": (40, None), "drawdown": (40, 9)}


def test_student_distribution_to_nine_places(spark):
    """Closed forms, and the density added up for other degrees of freedom."""
    x = np.array([-30.0, -4.0, -1.5, -0.2, 0.0, 0.3, 1.0, 2.5, 12.0])
    closed = {1.0: 0.5 + np.arctan(x) / np.pi, 2.0: 0.5 + x / (2 * np.sqrt(2 + x * x)), 4.0: 0.5 + 0.375 * (x / np.sqrt(1 + x * x / 4)) * (1 - x * x / (1 + x * x / 4) / 12)}
    for df, want in closed.items():
        assert np.abs(simulate.student_cdf(x, df) - want).max() < 1e-12
    for df in (0.5, 3.3, 5.0, 30.0, 200.0):
        for end in (0.7, 2.5):
            t, w = np.polynomial.legendre.leggauss(200)
            u = (t + 1) * end / 2
            density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(u * u / df))
            assert simulate.student_cdf(np.array(end), df) == pytest.approx(0.5 + (w * density).sum() * end / 2, abs=1e-11)
    rows = [(i, float(v), df) for i, (v, df) in enumerate((v, df) for v in x for df in (0.5, 1.0, 2.0, 4.0, 17.0, 200.0))]
    df = spark.createDataFrame(rows, "id long, x double, df double")
    got = [r["p"] for r in Plan(f"WITH a AS (SELECT * FROM $t) SELECT id, {stats.student_t_exact('spark', 'x', 'df')} AS p FROM a", {"t": "t"}).run(spark, t=df).orderBy("id").collect()]
    assert np.abs(np.array(got) - [float(simulate.student_cdf(np.array(v), d)) for _, v, d in rows]).max() < 1e-10


def test_times_past_the_year_9999_and_past_every_timestamp(spark):
    """Five digits without a sign, as in the oracle's SQL; what no timestamp holds is null."""
    rows = [(0, "518400006000000"), (1, "253402300799999"), (2, "9300000000000000"), (3, "-9223372036854775808"), (4, "0")]
    got = ingest.PLANS["parse_timestamp"].run(spark, times=spark.createDataFrame(rows, "event_id long, raw string")).orderBy("event_id").collect()
    assert [r["ts"] for r in got] == ["18397-06-11 01:40:00", "9999-12-31 23:59:59", None, None, "1970-01-01 00:00:00"]


def test_convergence_queries_look_at_150_paths(spark):
    """200 paths have three points, so that the status can say more than 'not_converged'."""
    got = catalog.QUERIES["convergence"](spark, "/root/testdata/sf0.001").collect()
    assert {r["n"] for r in got} == {100, 150, 200}
    assert "array(100, 150, 200" in catalog.PLANS["convergence_status"].text("spark") and "[100, 150, 200" in catalog.ORACLE_SQL["convergence_status"]
