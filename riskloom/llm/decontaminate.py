"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, blocks, lowered, mix, sliced, small_batches, spans, table, tidy, word_hashes

#: Word positions that each seed reads; it ignores the one between. Any
#: stretch of 13 equal words or more, with up to a fifth of it replaced, holds one of the
#: two (a search over all patterns of equal and replaced words shows it).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 5))
SALTS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)
#: An overlap has this many equal words (or all of a shorter item) and this share.
MIN_WORDS, MIN_SHARE = 13, 0.8
#: Equal words that one replaced word needs beside it.
MISS = round(MIN_SHARE / (1 - MIN_SHARE))
#: Benchmark words in one broadcast (17 bytes each with their index); more go in further blocks.
BLOCK_WORDS = 1_000_000
#: Pairs of places of a seed, and shifts, that are held at once.
HITS_AT_ONCE = 1 << 20
SCHEMA = "doc_id long, item_id long, doc_word long, item_word long, words long, matched long"


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's begin.

    Words are runs of letters and digits; ASCII case is ignored, and every byte
    from 0x80 counts as a letter."""
    buf = lowered(np.frombuffer(b"\n".join(texts), np.uint8))
    begin, end = spans((buf >= 128) | ((buf >= 97) & (buf <= 122)) | ((buf >= 48) & (buf <= 57)))
    starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return word_hashes(buf, begin, end), np.searchsorted(begin, starts)


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the words that ``mask`` reads, at every position where it fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix(sum(words[o : o + n] * np.uint64(SALTS[i % 5] + 2 * (i // 5)) for i, o in enumerate(mask)) + np.uint64(len(mask)))


class Index:
    """Seed hashes of a block of benchmark items, sorted."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words, self.bounds = words_of([t for _, t in items])
        found: dict[tuple[int, ...], list[np.ndarray]] = {}
        for b, e in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            if e - b > MASKS[0][-1]:
                own = MASKS
            else:  # too short for a seed: all its words, or nothing
                own = (tuple(range(e - b)),) if e > b else ()
            for mask in own:
                found.setdefault(mask, []).append(np.arange(b, e - mask[-1]))
        self.tables = []
        for mask, at in found.items():
            where = np.concatenate(at)
            hashes = seeds(self.words, mask)[where]
            order = np.lexsort((where, hashes))
            first, length = _runs_of(hashes[order], where[order], self.bounds)
            sieve = np.zeros(1 << 20, bool)
            sieve[hashes & np.uint64((1 << 20) - 1)] = True
            self.tables.append((mask, hashes[order][first], where[order][first], length, sieve))

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Stretches on which one seed recurs, in ``words`` and in the block, where they agree:
        begin and length of each, HITS_AT_ONCE pairs at a time."""
        for mask, hashes, where, length, sieve in self.tables:
            own = seeds(words, mask)
            at = np.flatnonzero(sieve[own & np.uint64((1 << 20) - 1)])
            first, size = _runs_of(own[at], at, bounds)
            low, high = (np.searchsorted(hashes, own[at[first]], side) for side in ("left", "right"))
            upto = np.concatenate(([0], np.cumsum(high - low)))
            for begin in range(0, int(upto[-1]), HITS_AT_ONCE):
                number = np.arange(begin, min(begin + HITS_AT_ONCE, int(upto[-1])))
                run = np.searchsorted(upto, number, "right") - 1
                other = low[run] + number - upto[run]
                yield at[first[run]], size[run], where[other], length[other]

    def diagonals(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (text, item, shift), in order and each once, that some seed lies on. Of two
        stretches of one seed these are all shifts by which they meet, so a text of one word
        costs its length, not the product."""
        shifts = len(words) + len(self.words) + 1
        found, parts, held = np.zeros(0, np.int64), [], 0
        for here, size, there, length in self.hits(words, bounds):
            text, item = np.searchsorted(bounds, here, "right") - 1, np.searchsorted(self.bounds, there, "right") - 1
            base = (text * len(self.ids) + item) * shifts + (here - there - length + 1) + len(self.words)
            upto = np.cumsum(size + length - 1)
            begin = 0
            while begin < len(base):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS_AT_ONCE, "right")))
                many = (size + length - 1)[begin:end]
                parts.append(np.unique(np.repeat(base[begin:end] - np.cumsum(many) + many, many) + np.arange(many.sum())))
                held, begin = held + len(parts[-1]), end
                if held > HITS_AT_ONCE:
                    found, parts, held = np.unique(np.concatenate([found, *parts])), [], 0
        found = np.unique(np.concatenate([found, *parts]))
        pair, shift = found // shifts, found % shifts - len(self.words)
        return np.stack((pair // max(1, len(self.ids)), pair % max(1, len(self.ids)), shift), 1)


def _runs_of(hashes: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one hash at neighbouring places of one text begin, and their lengths."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(bounds, at, "right")
    first = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]))))
    return first, np.diff([*first, len(at)])


def best_stretch(equal: np.ndarray, least: int = 0) -> tuple[int, int, int]:
    """Begin, length and equal words of the stretch of ``equal`` with most equal words
    among all that hold at least ``least`` and the share MIN_SHARE; the shortest, then
    the first, if there are several; (0, 0, 0) if there is none.

    A match is worth 1 and a miss -MIN_SHARE / (1 - MIN_SHARE), so the share holds
    where the sum is 0 or more. For each end the stretch reaches back to the first
    begin whose prefix sum is no higher; a stretch with most equal words begins and
    ends with one."""
    hits = np.flatnonzero(equal)
    if not len(hits) or len(hits) < least:
        return 0, 0, 0
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -MISS))))
    # lowest prefix sum up to each begin: it never rises, so the first one low enough is found by halving
    low = np.minimum.accumulate(total[hits])
    first = np.searchsorted(-low, -total[hits + 1], "left")
    matched = np.arange(len(hits)) - first + 1
    most = int(matched.max())
    if most < max(1, least):
        return 0, 0, 0
    ends = np.flatnonzero(matched == most)
    length = hits[ends] + 1 - hits[first[ends]]
    end = ends[int(np.argmin(length))]
    begin = int(hits[first[end]])
    return begin, int(hits[end]) + 1 - begin, most


def overlaps(texts: list[bytes], index: Index) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, first word in each, words, equal words) of every verified overlap."""
    words, bounds = words_of(texts)
    for t, i, shift in index.diagonals(words, bounds).tolist():
        low = max(index.bounds[i], bounds[t] - shift)
        high = min(index.bounds[i + 1], bounds[t + 1] - shift)
        if high <= low:
            continue
        whole = index.bounds[i + 1] - index.bounds[i]
        begin, n, matched = best_stretch(index.words[low:high] == words[low + shift : high + shift], min(MIN_WORDS, whole))
        if matched:
            yield t, i, int(low + begin + shift - bounds[t]), int(low + begin - index.bounds[i]), n, matched


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of at most BLOCK_WORDS words, one at a time. Items with
    a null id or text are left out."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()
    block, held = [], 0
    for row in rows:
        if row["text"] is not None and row["item_id"] is not None:
            block.append((row["item_id"], row["text"].encode()))
            held += len(block[-1][1]) // 2 + 1  # at most so many words
        if held >= BLOCK_WORDS:
            yield Index(block)
            block, held = [], 0
    if block:
        yield Index(block)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Overlaps of ``docs(doc_id, text)`` with ``benchmark(item_id, text)``: for each
    row and item the longest, as (doc_id, item_id, doc_word, item_word, words,
    matched); positions and lengths in words.

    An overlap is a stretch on which the texts agree word by word but for
    replacements: at least MIN_WORDS equal words (all of an item that has fewer) and
    MIN_SHARE of the stretch. Null texts are empty and overlap nothing; an item
    without words overlaps nothing; repeated rows are reported each. The benchmark
    goes out in blocks of bounded size, each against all documents."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for index in indexes(benchmark):
        known = docs.sparkSession.sparkContext.broadcast(index)

        @tidy
        def scan(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                ids, texts, out = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), []
                for b, e in blocks(texts):
                    best: dict = {}
                    for t, i, *rest in overlaps(texts[b:e], known.value):
                        rest = (ids[b + t], int(known.value.ids[i]), *rest)
                        if (t, i) not in best or best[t, i][-1] < rest[-1]:
                            best[t, i] = rest
                    out += best.values()
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])

        found = found.union(docs.mapInArrow(scan, SCHEMA))
    return found


def _clean(known: Broadcast):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        texts, out = [(t or "").encode() for t in texts], np.ones(len(texts), bool)
        for b, e in blocks(texts):
            for t, *_ in overlaps(texts[b:e], known.value):
                out[b + t] = False
        return pd.Series(out)

    return clean


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``text`` overlaps with no item, all columns kept."""
    for index in indexes(benchmark):
        clean = _clean(docs.sparkSession.sparkContext.broadcast(index))
        docs = docs.where(clean(F.col("text").cast("string")))
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
