"""Exact set-similarity join: prefix, positional and length filters find the candidates
for a Jaccard similarity of at least NUMERATOR / DENOMINATOR, and whole sets decide.

A set is what a reader finds in a text: the words of a line (linededup), or the shingles
of a document (simhash). Its place is the document's id and its number there."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, materialize, mix, runs, sliced, tidy, whole_runs

#: Sets match from this Jaccard similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Counters of word rarity: a fixed number, whatever the vocabulary.
RANK, CHUNKS = 18, 16
COUNTERS = 1 << RANK
#: Pairs compared in one step, and partners that a set names at first for each word.
PAIRS_AT_ONCE, PARTNERS = 1 << 20, 4
#: Bits of the filters by document and by set: a fixed number.
MARKS = 1 << 20
#: One block of texts in so many is looked at to guess how often a word stands in the
#: index, and index rows of a word that stay together: more are dealt to block pairs.
#: Both only balance tasks.
GUESS_FROM, TOGETHER = 16, 20_000
#: Index rows that a task packs at once, and that a bucket holds, about.
PACK, BUCKET = 400_000, 50_000
#: Words of a set from which two halves of parities are kept, and from which counts of
#: words are too: in COUNTS buckets in the index, in SKETCH buckets beside the whole set.
WIDE, BIG, COUNTS, SKETCH = 64, 128, 32, 256
POSTING = "word long, line_set long, doc_id long, line long, size int, at int, bits0 long, bits1 long, bits2 long, bits3 long, side int"
EVENT = "line_set long, doc_id long, line long, partner long, partner_doc long, partner_line long, far int, " + POSTING.replace("line_set long, doc_id long, line long, ", "")
KINDS = {n: np.dtype({"long": np.int64, "int": np.int32}[kind]) for n, kind in (x.split() for x in POSTING.split(", "))}
#: Index rows by the bucket of their word: each column's values together.
PACKED = "bucket int, " + ", ".join(f"{n} binary" for n in KINDS)


@dataclass(frozen=True)
class Reader:
    """``words(texts)``: of all texts in a row the word hashes, the item of each word, and
    where each text's items begin. ``items(text)``: the bytes of each item of a text."""

    words: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]
    items: Callable[[bytes], list[bytes]]


def slot(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(COUNTERS - 1)).astype(np.int64)


def _summed(docs: DataFrame, count: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
    """The sum of ``count(texts)``, COUNTERS numbers, over all texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in sliced(batches):
            yield count(as_bytes(batch.column("text")))

    return _added(docs.select("text"), of, COUNTERS)


def _added(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """The sum of ``size`` numbers, as ``of`` gives them for the batches of a task; added up
    on Spark, CHUNKS at a time."""
    width = size // CHUNKS

    @tidy
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for found in of(batches):
            sums += found
        parts = sums.astype("<u4" if sums.max(initial=0) < 1 << 32 else "<u8").reshape(CHUNKS, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([x.tobytes() for x in parts])], ["chunk", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(n, "<u4" if len(n) == 4 * width else "<u8")
                sums[chunk] = sums.get(chunk, 0) + part.astype("<u8")
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "n"])

    summed = rows.mapInArrow(local, "chunk int, n binary").repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, n binary")
    out = np.zeros((CHUNKS, width), np.uint64)
    for row in summed.collect():
        out[row["chunk"]] = np.frombuffer(row["n"], "<u8")
    return out.reshape(-1)


def rarity(docs: DataFrame, reader: Reader) -> np.ndarray:
    """How often words of each counter occur in all sets of ``docs``. They only order
    words, so words that share a counter cost speed and nothing else."""

    def count(texts: list[bytes]) -> np.ndarray:
        sums = np.zeros(COUNTERS, np.int64)
        for b, e in blocks(texts):
            sums += np.bincount(slot(reader.words(texts[b:e])[0]), minlength=COUNTERS)
        return sums

    return _summed(docs, count)


def index_load(docs: DataFrame, reader: Reader, counts: Broadcast) -> np.ndarray:
    """About how many index rows each counter's words have."""

    def count(texts: list[bytes]) -> np.ndarray:
        sums = np.zeros(COUNTERS, np.int64)
        for b, e in blocks(texts):
            words, items, _ = reader.words(texts[b:e])
            words, begin, end, _, _ = word_sets(words, items, counts.value)
            near = np.arange(len(words)) - np.repeat(begin, end - begin) < np.repeat(prefix(end - begin), end - begin)
            sums += GUESS_FROM * np.bincount(slot(words[near]), minlength=COUNTERS)
        return sums

    return _summed(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(GUESS_FROM)) == 0), count)


def set_ids(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set of words, whatever their order."""
    return mix(np.add.reduceat(mix(words), begin) + (end - begin).astype(np.uint64)).view(np.int64)


def word_sets(words: np.ndarray, items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each item's distinct words, rarest first (by ``counts``, their counters' ranks): words,
    begin and end of each item that has any, its number, and an id of its set."""
    # in one key the item, the rank and as much of the word as fits; words that this does not tell apart go the long way
    rank, top = counts[slot(words)].astype(np.uint64), int(items.max(initial=1)).bit_length()
    left = np.uint64(64 - RANK - top)
    key = items.astype(np.uint64) << np.uint64(64 - top) | rank << left | words >> (np.uint64(64) - left)
    order = np.argsort(key)
    key, sort = key[order], words[order]
    if ((key[1:] == key[:-1]) & (sort[1:] != sort[:-1])).any():
        order = np.lexsort((words, rank, items))
    words, items = words[order], items[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (items[1:] != items[:-1])
    words, items = words[new], items[new]
    begin, end = runs(items)
    if not len(begin):
        return words, begin, end, items, np.zeros(0, np.int64)
    return words, begin, end, items[begin], set_ids(words, begin, end)


def prefix(size: np.ndarray) -> np.ndarray:
    """How many of its rarest words a set shares one of with any set it matches."""
    return size - -(-NUMERATOR * size // DENOMINATOR) + 1


def counted(mixed: np.ndarray, begin: np.ndarray, end: np.ndarray, which: np.ndarray, buckets: int) -> np.ndarray:
    """How many words of the sets ``which`` fall into each of ``buckets``, by ``mixed``
    hashes. Sets differ by at least as many words as these counts together."""
    size = (end - begin)[which]
    row = np.repeat(np.arange(len(which)), size)
    at = np.repeat(begin[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
    bucket = ((mixed[at] >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64)
    return np.bincount(row * buckets + bucket, minlength=len(which) * buckets).reshape(len(which), buckets)


def _between_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far sixteen counts of four bits are apart, going round."""
    total = np.zeros(len(a), np.int64)
    for k in range(16):
        x, y = ((v >> np.uint64(4 * k)).astype(np.int8) & 15 for v in (a, b))
        d = (x - y) & 15
        total += np.minimum(d, 16 - d)
    return total


def _postings(reader: Reader, counts: Broadcast, load: Broadcast, buckets: int):
    """PACKED rows for the rarest words of each set of a batch, at its first place. A word with
    more than TOGETHER rows gets a row for each pair of blocks that the set's block is in;
    ``side`` then says which of the two it is, as only sets of two sides meet."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in sliced(batches):
            ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), as_bytes(batch.column("text"))
            for b, e in blocks(texts):
                words, items, starts = reader.words(texts[b:e])
                words, begin, end, number, sets = word_sets(words, items, counts.value)
                if not len(begin):
                    continue
                doc = np.searchsorted(starts, number, "right") - 1
                line, doc_id = number - starts[doc], ids[b:e][doc].astype(np.int64)
                order = np.lexsort((line, doc_id, sets))
                first = order[np.concatenate(([True], sets[order][1:] != sets[order][:-1]))]
                size = (end - begin)[first]
                many = prefix(size)
                owner = np.repeat(np.arange(len(first)), many)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                m = mix(words)
                one = np.uint64(1) << ((m >> np.uint64(8)) & np.uint64(63))
                bits = np.zeros((4, len(begin)), np.uint64)
                for k in range(2):  # parities: sets differ by at least as many words as these by bits
                    bits[k] = np.bitwise_xor.reduceat(np.where((m & np.uint64(1)) == k, one, np.uint64(0)), begin)
                bits[1, end - begin < WIDE] = 0  # a big set keeps both: it is held against ones of no counts
                big = np.flatnonzero(end - begin >= BIG)
                if len(big):  # counts of words, four bits each
                    part = ((counted(m, begin, end, big, COUNTS) & 15).astype(np.uint64).reshape(len(big), 2, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)
                    bits[2, big], bits[3, big] = part.T
                bits = bits.view(np.int64)
                pick = first[owner]
                word = words[begin[pick] + at]
                blocks_of = -(-load.value[slot(word)].astype(np.int64) // TOGETHER).clip(1)
                side = np.zeros(len(word), np.int32)
                if blocks_of.max(initial=1) > 1:
                    copy = np.repeat(np.arange(len(word)), blocks_of)
                    other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks_of) - blocks_of, blocks_of)
                    n = blocks_of[copy].astype(np.uint64)
                    own = (mix(sets[pick].view(np.uint64))[copy] % n).astype(np.int64)
                    side = (np.sign(other - own) % 3).astype(np.int32)  # 0: its own block, 1 and 2: the lower and the higher of a pair
                    pair = mix((np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64))
                    word = np.where(n > 1, mix(word[copy] + pair), word[copy])
                    pick, at, owner = pick[copy], at[copy], owner[copy]
                columns = [word.view(np.int64), sets[pick], doc_id[pick], line[pick], size[owner], at, *(x[pick] for x in bits), side]
                yield {n: c.astype(kind, copy=False) for (n, kind), c in zip(KINDS.items(), columns, strict=True)}

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for columns in post(batches):
            held.append(columns)
            n += len(columns["word"])
            if n >= PACK:
                yield _packed(held, buckets)
                held, n = [], 0
        if n:
            yield _packed(held, buckets)

    return pack


def _packed(held: list[dict[str, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Index rows as one row for each bucket: a shuffle of few rows, in which what the rows of a
    bucket have in common lies together however many tasks there are."""
    bucket = np.concatenate([(c["word"].view(np.uint64) >> np.uint64(32)) % np.uint64(buckets) for c in held]).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    begin, end = runs(bucket[order])
    columns = [pa.array(bucket[order][begin])]
    for n, kind in KINDS.items():
        values = np.concatenate([c[n] for c in held])[order]
        offsets = (np.concatenate((begin, end[-1:])) * kind.itemsize).astype(np.int32)
        columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays(columns, ["bucket", *KINDS])


def _parts(batches: Iterator[pa.RecordBatch], packed: bool) -> Iterator[dict[str, np.ndarray]]:
    """The columns of all index rows of some words, from a sorted stream."""
    for part in whole_runs(batches, "bucket" if packed else "word"):
        if packed:
            buckets = part["bucket"].to_numpy()
            for b, e in zip(*runs(buckets), strict=True):
                yield {n: np.frombuffer(b"".join(part[n].slice(b, e - b).to_pylist()), kind) for n, kind in KINDS.items()}
        else:
            yield {n: part[n].to_numpy() for n in part.column_names}


def _one_each(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The index rows by word, size and set: of each word and set the one at the first place."""
    order = np.lexsort((c["line_set"], c["size"], c["word"]))
    new = np.ones(len(order), bool)
    word, sets = c["word"][order], c["line_set"][order]
    new[1:] = (word[1:] != word[:-1]) | (sets[1:] != sets[:-1])
    group = np.cumsum(new) - 1
    more = np.flatnonzero(~new | np.append(~new[1:], False))
    own = order[more]
    more = more[np.lexsort((c["line"][own], c["doc_id"][own], c["side"][own], group[more]))]
    first = more[runs(group[more])[0]]
    each = order[new]
    each[group[first]] = order[first]
    return {n: v[each] for n, v in c.items()}


def _closest(y: np.ndarray, x: np.ndarray, far: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """The ``keep`` nearest x of each y; and those left out, as y and x."""
    order = np.lexsort((x, far, y))
    y, x, far = y[order], x[order], far[order]
    begin, end = runs(y)
    kept = np.arange(len(y)) - np.repeat(begin, end - begin) < keep
    return y[kept], x[kept], far[kept], y[~kept], x[~kept]


def _meet(keep: int, with_places: bool, grouped: bool, packed: bool):
    """For the postings of each word, three kinds of rows: if asked, the place of each set
    (at its rarest word; ``partner`` is the set itself); for each set the ``keep`` nearest
    earlier ones that the filters leave; and, without ``partner``, the postings of sets
    that had more, and of those left out.

    Later postings have a column ``mark``. ``grouped``: sets of one mark don't look at
    each other; else only sets with mark 1 look for partners."""

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _parts(batches, packed):
            c = _one_each(c)
            sets, side, mark, doc_id, line = c["line_set"], c["side"], c.get("mark"), c["doc_id"], c["line"]
            size, at = c["size"].astype(np.int64), c["at"].astype(np.int64)
            b0, b1, b2, b3 = (c[f"bits{k}"].view(np.uint64) for k in range(4))
            begin, end = runs(c["word"])
            run = np.repeat(np.arange(len(begin)), end - begin)
            key = (run << 32) + size
            low = np.searchsorted(key, (run << 32) + -(-NUMERATOR * size // DENOMINATOR))
            count = np.arange(len(sets)) - low
            total = np.concatenate(([0], np.cumsum(count)))
            best, hold = [np.zeros(0, np.int64)] * 3, np.zeros(len(sets), bool)
            i = 0
            while i < len(sets):
                j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS_AT_ONCE, "right")) - 1)
                for lo in range(0, max(1, int(count[i])) if j == i + 1 else 1, PAIRS_AT_ONCE):  # one set with very many partners: in parts
                    if j == i + 1:
                        q = np.arange(low[i] + lo, min(i, low[i] + lo + PAIRS_AT_ONCE))
                        p = np.full(len(q), i)
                    else:
                        p = np.repeat(np.arange(i, j), count[i:j])
                        q = low[p] + np.arange(len(p)) - (total[p] - total[i])
                    needed = -(-NUMERATOR * (size[p] + size[q]) // (NUMERATOR + DENOMINATOR))
                    # at the first word that two sets share, all that they share is still to come
                    ok = (np.minimum(size[p] - at[p], size[q] - at[q]) >= needed) & ((side[p] == 0) | (side[p] != side[q]))
                    if grouped and mark is not None:
                        ok &= mark[p] != mark[q]
                    p, q, needed = p[ok], q[ok], needed[ok]
                    most = size[p] + size[q] - 2 * needed
                    wide = size[q] >= WIDE  # p is never the smaller one
                    far = np.bitwise_count(b0[p] ^ b0[q]).astype(np.int64) + np.where(wide, np.bitwise_count(b1[p] ^ b1[q]), 0)
                    ok = far <= most
                    p, q, far, most = p[ok], q[ok], far[ok], most[ok]
                    if len(big := np.flatnonzero(size[q] >= BIG)):
                        x, y = p[big], q[big]
                        far[big] = np.maximum(far[big], _between_counts(b2[x], b2[y]) + _between_counts(b3[x], b3[y]))
                        ok = far <= most
                        p, q, far = p[ok], q[ok], far[ok]
                    same, line_same = doc_id[p] == doc_id[q], line[p] == line[q]
                    later = np.where(same, np.where(line_same, sets[p] > sets[q], line[p] > line[q]), doc_id[p] > doc_id[q])
                    y, x = np.where(later, p, q), np.where(later, q, p)
                    if not grouped and mark is not None:
                        use = mark[y] == 1
                        y, x, far = y[use], x[use], far[use]
                    *best, y, x = _closest(*(np.concatenate(pair) for pair in zip(best, (y, x, far), strict=True)), keep)
                    hold[y] = hold[x] = True
                i = j
            y, x, far = best
            if with_places:
                own = np.flatnonzero((at == 0) & (side == 0))
                y, x, far = np.concatenate((own, y)), np.concatenate((own, x)), np.concatenate((np.zeros(len(own), np.int64), far))
            rest = np.flatnonzero(hold)
            n, none = len(y), len(rest)
            if n + none:
                both = np.concatenate((y, rest))
                named = np.arange(n + none) >= n
                blank = lambda v, kind: pa.array(np.concatenate((v, np.zeros(none, v.dtype))), kind, mask=named)
                columns = [pa.array(sets[both]), pa.array(c["doc_id"][both]), pa.array(c["line"][both]), *(blank(c[k][x], pa.int64()) for k in ("line_set", "doc_id", "line")), blank(far, pa.int32())]
                columns += [pa.array(c[k][both], mask=~named) for k in ("word", "size", "at", "bits0", "bits1", "bits2", "bits3", "side")]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in EVENT.split(", ")])

    return meet


def met(postings: DataFrame, keep: int, with_places: bool = False, grouped: bool = False) -> DataFrame:
    packed = "bucket" in postings.columns
    key = "bucket" if packed else "word"
    return materialize(postings.repartition(key).sortWithinPartitions(key).mapInArrow(_meet(keep, with_places, grouped, packed), EVENT))


def indexed(docs: DataFrame, reader: Reader) -> DataFrame:
    """The index of ``docs(doc_id, text)``: PACKED rows."""
    send = docs.sparkSession.sparkContext.broadcast
    ranks = np.empty(COUNTERS, np.uint32)
    ranks[np.argsort(rarity(docs, reader), kind="stable")] = np.arange(COUNTERS)
    counts = send(ranks)
    load = index_load(docs, reader, counts)
    return docs.mapInArrow(_postings(reader, counts, send(load), 1 + int(load.sum()) // BUCKET), PACKED)


def named(events: DataFrame) -> DataFrame:
    """Each pair (line_set, partner) that ``events`` name, once, with its smallest ``far``."""
    return events.where("line_set <> partner").groupBy("line_set", "partner").agg(F.min("far").alias("far"))


def places(events: DataFrame) -> DataFrame:
    """(line_set, doc_id, line) of every set that ``events`` name or hold back."""
    sides = events.where("partner is null or line_set <> partner").select("line_set", "doc_id", "line")
    return sides.union(events.where("line_set <> partner").select("partner", "partner_doc", "partner_line")).groupBy("line_set").agg(F.min(F.struct("doc_id", "line")).alias("p")).select("line_set", "p.*")


def _sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``: a filter of fixed size
    lets them stay where they are."""
    bit = lambda: F.expr(f"shiftleft(1L, cast(xxhash64(cast({key} as bigint)) & 63 as int))")
    at = F.shiftright(F.xxhash64(F.col(key).cast("long")).bitwiseAND(F.lit(MARKS - 1)), 6).cast("int")
    sieve = [0] * (MARKS >> 6)
    for place, bits in wanted.groupBy(at.alias("at")).agg(F.bit_or(bit())).collect():
        sieve[place] = bits
    return rows.where(F.element_at(F.lit(np.array(sieve, np.int64)), at + 1).bitwiseAND(bit()) != 0)


def whole_sets(places: DataFrame, docs: DataFrame, reader: Reader) -> DataFrame:
    """``places(line_set, doc_id, line)`` to ``(line_set, size, sketch, words)``, read from
    the texts; ``sketch``: counts of the words of a big set, a byte each (255: or more)."""
    wanted = materialize(places.groupBy("doc_id").agg(F.collect_list(F.struct("line", "line_set")).alias("wanted")))

    # native, so that no second Python worker stands beside the reader's
    docs = _sieved(docs, "doc_id", wanted)

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(COUNTERS, np.uint8)
        for batch in sliced(batches):
            asked, lines = [], []
            for text, wanted in zip(as_bytes(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                own = reader.items(text)
                for w in wanted:
                    if w["line"] < len(own):
                        asked.append(w["line_set"])
                        lines.append(own[w["line"]])
            for b, e in blocks(lines):
                words, line, _ = reader.words(lines[b:e])
                words, begin, end, number, sets = word_sets(words, line, nothing)
                if len(begin):
                    right = np.array(asked[b:e], np.int64)[number] == sets
                    found = pa.LargeListArray.from_arrays(np.concatenate((begin, end[-1:])), words.view(np.int64)).cast(pa.list_(pa.int64()))
                    big = np.flatnonzero(end - begin >= BIG)
                    sketch = np.full(len(begin), None, object)
                    sketch[big] = [x.tobytes() for x in np.minimum(counted(mix(words), begin, end, big, SKETCH), 255).astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([pa.array(sets), pa.array((end - begin).astype(np.int32)), pa.array(sketch, pa.binary()), found], ["line_set", "size", "sketch", "words"]).filter(pa.array(right))

    read_back = docs.join(wanted, "doc_id").select("text", "wanted").mapInArrow(read, "line_set long, size int, sketch binary, words array<long>")
    return materialize(read_back.dropDuplicates(["line_set"]))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(line_set, partner)`` whose ``sets`` are similar enough: by sizes and
    sketches first, then by the whole sets."""

    @F.pandas_udf("boolean")
    def may_be(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        n, m = n.to_numpy(np.int64), m.to_numpy(np.int64)
        most = n + m - 2 * -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))
        out = most >= abs(n - m)
        big = np.flatnonzero(out & (np.minimum(n, m) >= BIG))
        for at in range(0, len(big), 1024):
            i = big[at : at + 1024]
            one, two = (np.frombuffer(b"".join(v.iloc[i]), np.uint8).reshape(len(i), SKETCH).astype(np.int16) for v in (x, y))
            out[i] = abs(one - two).sum(1) <= most[i]
        return pd.Series(out)

    sketches = sets.select("line_set", "size", "sketch")
    near = pairs.select("line_set", "partner").join(sketches, "line_set").join(sketches.toDF("partner", "n", "other"), "partner")
    near = materialize(near.where(may_be("size", "n", "sketch", "other")).select("line_set", "partner"))
    whole = _sieved(sets.select("line_set", "words"), "line_set", near.select(F.explode(F.array("line_set", "partner")).alias("line_set")))
    joined = near.join(whole, "line_set").join(whole.toDF("partner", "other"), "partner")
    shared = F.size(F.array_intersect("words", "other"))
    return materialize(joined.where(DENOMINATOR * shared >= NUMERATOR * (F.size("words") + F.size("other") - shared)).select("line_set", "partner"))


def nearest(pairs: DataFrame) -> DataFrame:
    """The nearest partner of each set."""
    best = pairs.groupBy("line_set").agg(F.min(F.struct("far", "partner")).alias("best"))
    return best.select("line_set", "best.partner")
