"""Prefix scans over ordered rows of groups of any size, as SQL.

On Spark a group is cut into blocks of its order: each block is scanned by itself, the blocks'
totals are scanned (a row a block), and what stands before a block is put to its rows. So no
task holds a group. The oracle scans the group in one window."""

from __future__ import annotations

from .engine import SPARK

#: Numbers of the order that a block holds: at most as many rows, if no number repeats.
BLOCK = 4096


def scan(d: str, name: str, source: str, by: str, keep: str, terms: dict[str, tuple[str, str]], order: str = "trade_idx") -> str:
    """CTE ``name`` (and others that begin with it): columns ``by``, ``order`` and ``keep`` of
    ``source``, and for each of ``terms``, alias to (``sum`` or ``max``, expression), that of
    all rows of the group up to and with this one, by ``order``, a whole number that grows
    about as fast as rows do."""
    keys = [k.strip() for k in by.split(",")]
    columns = ", ".join(x for x in (by, order, keep) if x)
    if d != SPARK:
        window = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
        return f"{name} AS (SELECT {columns}{''.join(f', {f}({x}) {window} AS {a}' for a, (f, x) in terms.items())} FROM {source})"
    window = f"OVER (PARTITION BY {by}, blk ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    before = f"OVER (PARTITION BY {by} ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    same = " AND ".join(f"i.{k} = c.{k}" for k in [*keys, "blk"])
    put = lambda a, f: f"coalesce(c.{a}, 0) + i.{a}" if f == "sum" else f"greatest(c.{a}, i.{a})"
    own = ", ".join(f"i.{x.strip()}" for x in columns.split(","))
    return f"""{name}b AS (SELECT *, CAST(floor({order} / {BLOCK}) AS BIGINT) AS blk FROM {source}),
{name}i AS (SELECT {columns}, blk{''.join(f', {f}({x}) {window} AS {a}' for a, (f, x) in terms.items())} FROM {name}b),
{name}t AS (SELECT {by}, blk{''.join(f', {f}({x}) AS {a}' for a, (f, x) in terms.items())} FROM {name}b GROUP BY {by}, blk),
{name}c AS (SELECT {by}, blk{''.join(f', {f}({a}) {before} AS {a}' for a, (f, _) in terms.items())} FROM {name}t),
{name} AS (SELECT {own}{''.join(f', {put(a, f)} AS {a}' for a, (f, _) in terms.items())} FROM {name}i i JOIN {name}c c ON {same})"""
