"""Statistics of long series that no task holds."""

import numpy as np
import pandas as pd

from riskloom.operators import simulate, stats, stress
from riskloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_autocorrelation_over_blocks(spark):
    """Each lag was a window of its own over the whole series."""
    x = np.random.default_rng(2).normal(0, 10, 9000).cumsum()
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "trade_idx": 3 * np.arange(len(x)), "pnl": x}).sample(frac=1, random_state=1))
    out = stats.PLANS["autocorrelation"].run(spark, trades=df)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    e = x - x.mean()
    got = {r["k"]: r["rho"] for r in out.collect()}
    assert sorted(got) == list(range(1, stats.LAGS + 1))
    assert all(abs(got[k] - (e[:-k] * e[k:]).sum() / (e * e).sum()) < 1e-7 for k in got)


def test_special_functions_in_batches(spark):
    """Fractions were worked out by a lambda for each row, all rows of a series in one task."""
    plan = catalog.QUERIES["special_functions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "MapInPandas" in plan
    assert np.allclose(simulate.log_gamma(np.array([0.5, 1.0, 5.0])), [np.log(np.pi) / 2, 0, np.log(24)])
    assert np.allclose(simulate.student_cdf(np.array([1.0, 1.0]), np.array([1.0, 2.0])), [0.75, 0.5 + 1 / (2 * np.sqrt(3))])


def test_stress_over_blocks(spark):
    """Each scenario was a copy of the series that one task sorted. Gaps, equal wins and windows across blocks keep the SQL's rows."""
    import duckdb

    rng = np.random.default_rng(1)
    across = np.zeros(9000)
    across[4094:4104] = -100
    histories = {"ties": (np.where(rng.random(9000) < 0.6, 10.0, -12.0), 1), "gaps": (rng.integers(-50, 60, 3000), 3), "far": (rng.integers(-50, 60, 300), 1000), "short": ([5, -3, 2], 1), "across": (across, 1), "wins": (np.ones(4097), 1)}
    trades = pd.concat([pd.DataFrame({"series_id": k, "trade_idx": step * np.arange(len(x)), "pnl": np.asarray(x, float)}) for k, (x, step) in histories.items()]).sample(frac=1, random_state=1)  # the oracle reads it by name
    for name, plan in stress.PLANS.items():
        out = plan.run(spark, trades=spark.createDataFrame(trades))
        assert "RepartitionByExpression [series_id" in out._jdf.queryExecution().optimizedPlan().toString()
        got, expected = (sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy())) for df in (out.toPandas(), duckdb.sql(plan.text("duckdb").replace("$trades", "trades")).df()))
        assert got == expected
