"""Exact top-k inner-product search by the three-phase uniform threshold method.

The dimensions are cut into FRAGMENTS lists. Phase one gathers each list's best for a
query, with their whole scores; the k-th best of these is a score that the answer
reaches. A vector reaches it only if it has a FRAGMENTS-th of it in some list: phase two
sends that cutoff out and collects the entries at or above a uniform threshold, which is no
more than that. Phase three resolves the
whole score of those whose known and possible parts can still reach it, and of no others.
Vectors and
queries meet in blocks of bounded size, where both are whole; each phase runs inside the
blocks, and a block returns a few rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, runs, small_batches, table

FRAGMENTS = 4
#: Components of the vectors and of the queries that meet in one block, and scores that
#: are held at once.
BLOCK_OF_VECTORS, BLOCK_OF_QUERIES, AT_ONCE = 1 << 20, 1 << 17, 1 << 20
SCALE = 1024
LONG = (1 << 63) - 1
#: Below every inner product of doubles.
NOTHING = -(10**700)
ROWS = "query long, rep long, score long, key binary"


def quantized(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v array<double>)``: floor(SCALE * x) / SCALE of each component as double,
    which holds it exactly at any size. Vectors that are null, or hold null or non-finite
    components, and rows without an id are left out."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)
    # from 2 ** 42 on a double has no part below 1 / SCALE
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**42), F.floor(x * F.lit(float(SCALE))).cast("double") / F.lit(float(SCALE))).otherwise(x)
    return kept.select(F.col("vec_id").cast("long"), F.transform(v, whole).alias("v"))


def of_one_length(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, v)`` with zeros behind the shorter ones, so that each meets all others:
    products of their shared components are unchanged."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    return vectors.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))))


def sort_key(score: int) -> bytes:
    """Bytes in the order of whole numbers of any size."""
    size = (abs(score).bit_length() + 7) // 8
    raw = b"\x80" + size.to_bytes(2) + abs(score).to_bytes(size)
    return raw if score >= 0 else bytes(255 - x for x in raw)


def from_key(key: bytes) -> int:
    low = key[0] < 128
    raw = bytes(255 - x for x in key) if low else key
    return -int.from_bytes(raw[3:]) if low else int.from_bytes(raw[3:])


def _cuts(dims: int) -> list[slice]:
    return [slice(-(-dims * f // FRAGMENTS), -(-dims * (f + 1) // FRAGMENTS)) for f in range(FRAGMENTS)]


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """``scale`` times ``x``, as whole numbers of any size."""
    return np.vectorize(lambda v: int(v) * scale if abs(v) >= 2.0**53 else int(v * scale), otypes=[object])(x) if x.size else x.astype(object)


def _parts(a: np.ndarray, b: np.ndarray, scale: int) -> list[np.ndarray]:
    """Inner products of each list, a row for each query of ``a``: worked out as doubles
    where those hold every sum exactly, else as whole numbers of any size."""
    most = lambda x: scale * float(abs(x).max(initial=1.0 / scale))
    with np.errstate(over="ignore"):
        small = most(a) * most(b) * max(1, a.shape[1]) < 2.0**53
    a, b = (x * scale if small else _whole(x, scale) for x in (a, b))
    kind = np.dtype(np.int64 if small else object)
    return [(a[:, c] @ b[:, c].T if c.stop > c.start else np.zeros((len(a), len(b)), np.int64)).astype(kind) for c in _cuts(a.shape[1])]


def _pieces(left: pd.DataFrame, right: pd.DataFrame, scale: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, list[np.ndarray]]]:
    """Vectors and queries of one length, AT_ONCE scores at a time, with the parts of
    their scores."""
    for size, queries in right.groupby(right["v"].map(len)):
        vectors = left[left["v"].map(len) == size]
        step = max(1, AT_ONCE // len(queries))
        a = np.array(queries["v"].tolist(), float).reshape(len(queries), size)
        for i in range(0, len(vectors), step):
            some = vectors.iloc[i : i + step]
            yield some, queries, _parts(a, np.array(some["v"].tolist(), float).reshape(len(some), size), scale)


def _resolve(parts: list[np.ndarray], q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The whole scores of some pairs."""
    return sum(part[q, at] for part in parts)


def _found(vectors: pd.DataFrame, queries: pd.DataFrame, q: np.ndarray, at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    return queries["rep"].to_numpy()[q], vectors["rep"].to_numpy()[at], score, vectors["least"].to_numpy()[at]


def _rows(found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], keep: int) -> pd.DataFrame:
    """The ``keep`` best (query, rep, score) of each query; of equal scores those with the
    least id first."""
    query, rep, score, least = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 4))
    order = {x: i for i, x in enumerate(sorted(set(score.tolist())))} if score.dtype == object else None  # numpy sorts no whole numbers of any size
    place = np.array([order[x] for x in score], np.int64) if order is not None else score.astype(np.int64)
    by = np.lexsort((least, -place, query))
    begin, end = runs(query[by])
    by = by[np.arange(len(by)) - np.repeat(begin, end - begin) < keep]
    scores = [int(x) for x in score[by]]
    return pd.DataFrame({"query": query[by], "rep": rep[by], "score": np.array([max(-LONG, min(LONG, x)) for x in scores], np.int64), "key": [sort_key(x) for x in scores]})


def _local_best(keep: int, scale: int = 1):
    """Phase one in a block: the best of each list, with their whole scores."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for vectors, queries, parts in _pieces(left, right, scale):
            n = min(keep, len(vectors))
            gathered = np.zeros(parts[0].shape, bool)
            for part in parts:
                at = np.argpartition(-part, n - 1, axis=1)[:, :n] if part.dtype != object else np.argsort(-part, axis=1)[:, :n]
                np.put_along_axis(gathered, at, True, axis=1)
            q, at = np.nonzero(gathered)
            found.append(_found(vectors, queries, q, at, _resolve(parts, q, at)))
        return _rows(found, keep)

    return best


def survivors(parts: list[np.ndarray], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase two: entries of at least a uniform threshold in some list are collected; pairs
    stay whose known parts, with the threshold for each other list, still reach the cutoff.

    Any threshold up to the cutoff's share of a list is safe. Half of it, for a cutoff above
    0, collects more entries and leaves far fewer pairs to resolve."""
    share = np.where(cutoff > 0, 2, 1) * FRAGMENTS
    known, lists = np.zeros(parts[0].shape, parts[0].dtype), np.zeros(parts[0].shape, np.int64)
    for part in parts:
        entry = (share * part >= cutoff).astype(bool)
        known, lists = known + np.where(entry, part, 0), lists + entry
    return np.nonzero((lists > 0) & (share * known + (FRAGMENTS - lists) * cutoff >= share * cutoff).astype(bool))


def _resolved(keep: int, scale: int = 1):
    """Phases two and three in a block: the whole scores of the survivors."""

    def resolve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for vectors, queries, parts in _pieces(left, right, scale):
            # a null cutoff: fewer vectors than wanted, nothing may be cut
            cutoff = np.array([NOTHING if x is None or x != x else from_key(x) for x in queries["cutoff"]], object)
            if parts[0].dtype != object:  # beyond every score of this kind
                cutoff = cutoff.clip(-(1 << 56), 1 << 56).astype(np.int64)
            q, at = survivors(parts, cutoff[:, None])
            score = _resolve(parts, q, at)
            enough = (score >= cutoff[q]).astype(bool)
            found.append(_found(vectors, queries, q[enough], at[enough], score[enough]))
        return _rows(found, keep)

    return resolve


def _top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1) -> DataFrame:
    """The ``k`` best rows of ``vectors(vec_id, v)`` for each row of ``queries(vec_id,
    v)``, its own vec_id excepted: query_id, rank (from 1), vec_id, score; ties go to
    the smaller vec_id; all, if there are fewer than ``k``.

    ``scale`` times each component of the arrays ``v`` is a whole number, and scores are those
    numbers' products; a query meets vectors of its own length only. Equal vectors are one class, so copies are scored once; an id that occurs on
    several rows is that many candidates, and as many queries. Scores are whole numbers of any
    size; one beyond a long is ranked by its value and given as the nearest long. Columns of
    other names are ignored. Empty inputs give no rows."""
    vectors, queries = (df.select(F.col("vec_id").cast("long"), F.transform("v", lambda x: x.cast("double") + F.lit(0.0)).alias("v")) for df in (vectors, queries))
    ids = vectors.select("vec_id", "v", F.xxhash64("v").alias("h"))
    # the ids that a class can give to one query: k rows of an id at most, then, as one id may be the query's own, its least 2 * k rows
    ids = _top(_top(ids, ["h", "v", "vec_id"], [F.lit(0)], k, "n"), ["h", "v"], [F.col("vec_id")], 2 * k, "n")
    classes = materialize(ids.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids", F.col("ids")[0].alias("least"), F.monotonically_increasing_id().alias("rep")))
    asked = materialize(queries.select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("h")).join(classes.select("v", "rep", F.xxhash64("v").alias("h")), ["h", "v"]).select("query_id", "v", "rep"))
    distinct = asked.groupBy("rep").agg(F.first("v").alias("v"))
    blocks = lambda df, most: max(1, -(-(df.agg(F.sum(F.size("v"))).first()[0] or 0) // most))
    n, m = blocks(classes, BLOCK_OF_VECTORS), blocks(distinct, BLOCK_OF_QUERIES)
    wanted = k + 1  # classes; one may be the query's own row alone

    def met(run, *more: str, right: DataFrame) -> DataFrame:
        """Both sides dealt to the cells of a grid: each block of vectors meets each block of queries.
        The sides' keys are of one type, as those of equal value but other types hash apart."""
        own = lambda blocks: F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
        each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        left = classes.select("rep", "v", "least", own(n).alias("vb"), each(m).alias("qb"))
        right = right.select("rep", "v", *more, own(m).alias("qb"), each(n).alias("vb"))
        found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(run, ROWS)
        return _top(found.join(classes.select("rep", "least"), "rep"), ["query"], [F.desc("key"), F.col("least")], wanted, "n")

    seen = met(_local_best(wanted, scale), right=distinct).groupBy("query").agg(F.min("key").alias("cutoff"), F.count("*").alias("n"))
    cutoff = materialize(seen.select(F.col("query").alias("rep"), F.when(F.col("n") >= wanted, F.col("cutoff")).alias("cutoff")))
    best = met(_resolved(wanted, scale), "cutoff", right=distinct.join(cutoff, "rep", "left")).join(classes.select("rep", "ids"), "rep")
    best = best.select(F.col("query").alias("rep"), "score", "key", "ids")
    rows = asked.select("query_id", "rep", F.monotonically_increasing_id().alias("asked")).join(best, "rep").select("asked", "query_id", "score", "key", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    out = _top(rows, ["asked"], [F.desc("key"), F.col("vec_id")], k, "rank")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    vectors = of_one_length(quantized(table(spark, sf_dir, "embeddings")))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), scale=SCALE)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
