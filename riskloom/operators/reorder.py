"""Rank reordering: a history put into the order of correlated scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .kernels import STREAM
from .scan import numbered
from .simulate import SEED, TINY, uniform

#: Correlation of the scores of any two series in the test query.
RHO = "CAST('0.6' AS DOUBLE)"


def reorder(history: DataFrame, scores: DataFrame) -> DataFrame:
    """Each series of ``history(series_id, trade_idx, pnl)`` put into the order of its
    ``scores(series_id, trade_idx, score)``: at the step with the k-th lowest score stands the
    k-th lowest result, so every series keeps its values to the row, and takes the ranks'
    dependence from the scores. Ties stand by trade_idx. Steps without a score, and results
    beyond the number of scores, are left out.

    Ranks come from ranges of values and carried counts; no task holds a series."""
    low = numbered(history.select("series_id", "trade_idx", "pnl"), ["series_id"], ["pnl", "trade_idx"], "rank").select("series_id", "rank", "pnl")
    at = numbered(scores.select("series_id", "trade_idx", "score"), ["series_id"], ["score", "trade_idx"], "rank").select("series_id", "rank", "trade_idx")
    return at.join(low, ["series_id", "rank"]).select("series_id", "trade_idx", "pnl")


def scores_sql(d: str) -> str:
    """CTE ``sc``: normal scores of each row of ``$trades``, tied by one common factor for each
    step; counters tell series apart by their place among all."""
    ids = "si AS (SELECT series_id, row_number() OVER (ORDER BY series_id) AS j FROM (SELECT DISTINCT series_id FROM $trades) x), rw AS (SELECT t.series_id, t.trade_idx, j FROM $trades t JOIN si ON si.series_id = t.series_id), ro AS (SELECT DISTINCT trade_idx FROM $trades)"
    own, common = "series_id, trade_idx", "trade_idx"
    draws = ", ".join(
        uniform(d, source, k, keep, SEED + STREAM * (3 + i), tag)
        for i, (source, k, keep, tag) in enumerate((("rw", "j * 1000003 + trade_idx", own, "a"), ("rw", "j * 1000003 + trade_idx", own, "b"), ("ro", "trade_idx + 1", common, "c"), ("ro", "trade_idx + 1", common, "e")))
    )
    normal = lambda u, v: f"sqrt(-2 * ln(greatest({u}, {TINY}))) * cos(2 * pi() * {v})"
    return f"""{ids}, {draws}, fa AS (SELECT c.trade_idx, {normal("c.u", "e.u")} AS f FROM cr5 c JOIN er5 e ON c.trade_idx = e.trade_idx),
sc AS (SELECT a.series_id, a.trade_idx, round(sqrt({RHO}) * f + sqrt(1 - {RHO}) * {normal("a.u", "b.u")}, 9) AS score FROM ar5 a JOIN br5 b ON a.series_id = b.series_id AND a.trade_idx = b.trade_idx JOIN fa ON fa.trade_idx = a.trade_idx)"""


def reorder_sql(d: str) -> str:
    return f"""WITH {scores_sql(d)}, lo AS (SELECT series_id, pnl, row_number() OVER (PARTITION BY series_id ORDER BY pnl, trade_idx) AS r FROM $trades),
hi AS (SELECT series_id, trade_idx, row_number() OVER (PARTITION BY series_id ORDER BY score, trade_idx) AS r FROM sc)
SELECT hi.series_id, hi.trade_idx, round(lo.pnl, 6) AS pnl FROM hi JOIN lo ON lo.series_id = hi.series_id AND lo.r = hi.r"""
