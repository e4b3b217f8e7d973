"""Helpers shared by the corpus operators: batches, word hashes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared as materialize

#: Odd multiplier of the polynomial hash, its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Each byte with ASCII capitals made small.
SMALL = bytes(range(256)).lower()
#: Text bytes that one vectorised step holds; about 40 bytes of scratch each.
BLOCK_BYTES = 1 << 20
#: Bytes that Spark puts into one Arrow batch for Python, and text bytes worked on at once.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 4 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand texts to Python in batches of BATCH_BYTES, not of ten thousand
    rows of any length, unless the session has a limit of its own."""
    if int(spark.conf.get(BATCH_KEY, "64m").rstrip("bBmMkKgG") or 0) in (64, 64 << 20, 65536):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def give_back() -> None:
    """Hands freed memory back to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run``, a function over Arrow batches, that gives memory back at its end: Python
    workers outlive their tasks, and two share an executor's memory."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        for begin, end in zip(*runs(part), strict=True):
            yield batch.slice(begin, end - begin)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to the size of a block."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK_BYTES)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII capitals made small, all other bytes kept."""
    return np.frombuffer(buf.tobytes().translate(SMALL), np.uint8)


def word_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf)), out=total[1:])
    return mix((total[ends] - total[begins]) * powers(BASE_INVERSE, len(buf) + 1)[begins])


def is_space(buf: np.ndarray) -> np.ndarray:
    """Space and the bytes 9 to 13."""
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))


def whole_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables cut between values of ``keys`` of a sorted stream, so that no value
    is split. Only a value's own rows are ever held together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            same &= values == values[-1]
        changed = np.flatnonzero(~same)
        begin = int(changed[-1]) + 1 if len(changed) else 0
        if held and not begin:
            before = held[-1]
            begin_is_new = any(before.column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
            if begin_is_new:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        if begin:
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
            held = []
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the least by ``order``; combines before it shuffles."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
