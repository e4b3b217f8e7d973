"""Row numbers of long ordered tables, without a task that holds a whole group.

Two levels: rows are dealt to tasks by ranges of their order, numbered there, and the
counts of groups that go on in the next task are carried over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared

#: Rows of a task, about; there are at least as many tasks as cores.
ROWS = 1 << 20
HELPERS = ["_task", "_row", "_place", "_leading"]


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows, before their last column ``_key``: the task, the row's number in
    it and in the run of equal keys, and whether the run is the task's first."""
    task, key, rows, seen, leading = TaskContext.get().partitionId(), None, 0, 0, True
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        keys = batch.column(batch.num_columns - 1)
        new = np.ones(n, bool)
        new[0] = rows > 0 and keys[0].as_py() != key
        new[1:] = ~pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.arange(n)
        place = np.where(np.cumsum(new) > 0, at - np.maximum.accumulate(np.where(new, at, 0)), at + seen)
        first = leading & (np.cumsum(new) == 0)
        columns = [*batch.columns[:-1], pa.array(np.full(n, task, np.int32)), pa.array(rows + at), pa.array(place), pa.array(first), keys]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *HELPERS, "_key"])
        key, rows, seen, leading = keys[n - 1].as_py(), rows + n, int(place[-1]) + 1, bool(first[-1])


def carried(ends: list[tuple]) -> list[tuple[int, int]]:
    """(task, rows) for the tasks whose first group began before them, with its rows there.
    ``ends``: of each task its number, first group, rows of that, last group, rows of that."""
    out, key, n, task_seen = [], None, 0, False
    for task, first, n_first, last, n_last in sorted(ends):
        before = n if task_seen and first == key else 0
        if before:
            out.append((task, before))
        key, n, task_seen = last, n_last + (before if last == first else 0), True
    return out


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "idx", rows: int = ROWS, select: list[str | Column] | None = None) -> DataFrame:
    """``df`` with a column ``name``: each row's number, from 0, among the rows of equal
    ``keys`` (null equals null) by ``order`` (Spark's: nulls first); without keys, among all.
    ``select``: the columns to keep, worked out behind the sort.

    Rows that are equal in keys and order are numbered as they come, and cut between tasks
    like any others. The rows are written once, with their numbers in their tasks; a row for
    each task then passes the driver and goes out again by broadcast."""
    spark = df.sparkSession
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    tasks = max(-(-df.count() // rows), spark.sparkContext.defaultParallelism)
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    sort = [*keys, *order, "_tie"]
    ordered = df.repartitionByRange(tasks, *sort).sortWithinPartitions(*sort).select(*(select or [c for c in df.columns if c != "_tie"]), key.alias("_key"))
    kept = ordered.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "_task int, _row long, _place long, _leading boolean, _key string"])
    placed = shared(ordered.mapInArrow(_positions, schema))
    ends = placed.groupBy("_task").agg(F.min_by("_key", "_row").alias("first"), F.sum(F.col("_leading").cast("long")).alias("n"), F.max_by(F.struct("_key", "_place"), "_row").alias("last"))
    carries = carried([tuple(r) for r in ends.select("_task", "first", "n", "last._key", F.col("last._place") + 1).collect()])
    place = F.col("_place")
    if carries:
        placed = placed.join(F.broadcast(spark.createDataFrame(carries, "_task int, _carry long")), "_task", "left")
        place += F.when(F.col("_leading"), F.coalesce("_carry", F.lit(0))).otherwise(0)
    return placed.select(*(F.col(f"`{f.name}`") for f in kept), place.alias(name))
