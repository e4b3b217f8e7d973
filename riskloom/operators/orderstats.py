"""Exact order statistics of groups of any size, as SQL.

On Spark no task sorts a group: an approximate sketch cuts it into bins, equal values are
counted once, the counts of the bins say which bin holds a rank, and only that bin is put in
order. The oracle numbers all rows instead."""

from __future__ import annotations

from ..plans.engine import SPARK

#: Bins of a group, and the accuracy of the sketch that places them; neither changes a result.
BINS, ACCURACY = 32, 2000


def position(share: str, n: str = "n") -> str:
    """The rank, from 0, of a share of ``n`` values, without interpolation."""
    return f"least({n} - 1, greatest(0, CAST(floor({n} * {share}) AS BIGINT)))"


def first(share: str, n: str = "n") -> str:
    """How many of ``n`` values are a share of them: one at least."""
    return f"greatest(1, CAST(floor({n} * {share}) AS BIGINT))"


def order_stats(d: str, name: str, source: str, by: str, value: str, picks: dict[str, str], means: dict[str, str] | None = None) -> str:
    """CTE ``name`` (and others that begin with it): for each group ``by`` of ``source`` the
    number ``n`` of its values, those at the ranks ``picks``, and the means of the first
    ``means``, both in terms of n. Null values are left out."""
    means, keys = means or {}, [k.strip() for k in by.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    values = f"{name}v AS (SELECT {by}, {value} AS v FROM {source} WHERE {value} IS NOT NULL)"
    if d != SPARK:
        columns = [f"max(CASE WHEN r = {rank} THEN v END) AS {alias}" for alias, rank in picks.items()] + [f"avg(CASE WHEN r < {upto} THEN v END) AS {alias}" for alias, upto in means.items()]
        return f"""{values}, {name}r AS (SELECT {by}, v, row_number() OVER (PARTITION BY {by} ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {name}v),
{name} AS (SELECT {by}, max(n) AS n{"".join(", " + c for c in columns)} FROM {name}r GROUP BY {by})"""
    cuts = ", ".join(f"{i}D / {BINS}" for i in range(1, BINS))
    holds = lambda rank: f"(p.before <= {rank} AND {rank} < p.before + p.c)"
    wanted = " OR ".join([holds(rank) for rank in picks.values()] + [holds(f"({upto} - 1)") for upto in means.values()])
    columns = [f"max(CASE WHEN r <= {rank} AND {rank} < r + c THEN v END) AS {alias}" for alias, rank in picks.items()]
    for alias, upto in means.items():
        here = f"b0 <= {upto} - 1 AND {upto} - 1 < b0 + bc"
        columns.append(f"(max(CASE WHEN {here} THEN below END) + sum(CASE WHEN {here} THEN v * least(c, greatest(0, {upto} - r)) ELSE 0 END)) / max({upto}) AS {alias}")
    return f"""{values}, {name}q AS (SELECT {by}, count(*) AS n, percentile_approx(v, array({cuts}), {ACCURACY}) AS cuts FROM {name}v GROUP BY {by}),
{name}d AS (SELECT {by}, bin, v, count(*) AS c FROM (SELECT {of("s")}, s.v, size(filter(q.cuts, x -> x < s.v)) AS bin FROM {name}v s JOIN {name}q q ON {same("s", "q")}) x GROUP BY {by}, bin, v),
{name}b AS (SELECT {by}, bin, sum(c) AS c, sum(c * v) AS t FROM {name}d GROUP BY {by}, bin),
{name}p AS (SELECT {by}, bin, c, coalesce(sum(c) OVER w, 0) AS before, coalesce(sum(t) OVER w, 0) AS below FROM {name}b WINDOW w AS (PARTITION BY {by} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}w AS (SELECT {of("p")}, p.bin, p.before AS b0, p.c AS bc, p.below, q.n FROM {name}p p JOIN {name}q q ON {same("p", "q")} WHERE {wanted}),
{name}x AS (SELECT {of("w")}, w.n, w.b0, w.bc, w.below, x.v, x.c, w.b0 + coalesce(sum(x.c) OVER (PARTITION BY {of("w")}, w.bin ORDER BY x.v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM {name}d x JOIN {name}w w ON {same("x", "w")} AND x.bin = w.bin),
{name} AS (SELECT {by}, max(n) AS n{"".join(", " + c for c in columns)} FROM {name}x GROUP BY {by})"""
