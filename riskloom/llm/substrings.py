"""Removal of repeated substrings with suffix arrays.

Sorting every suffix of a corpus is out of reach, so only text that can repeat is
sorted. Winnowing picks an anchor in each window: two equal windows pick the same
one. Anchors that occur once end there. Of the others, equal surroundings are told
by hash, and only the first of each differing surrounding goes into suffix arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, as_bytes, blocks, materialize, mix, powers, runs, spans, table, whole_runs

#: Bytes that a repeat has at least, bytes of an anchor, and anchors in a window.
LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: Bytes of text in one suffix array, and windows looked up in earlier shards at once.
SHARD_BYTES, ROWS_AT_ONCE = 1 << 20, 1 << 16
ANCHOR = "key long, around long, doc_id long, at long, known boolean"


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` neighbours, from each position on."""
    have = 1
    while 2 * have <= width:
        x, have = best(x[:-have], x[have:]), 2 * have
    return best(x[: len(x) - width + have], x[width - have :]) if width > have else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of ``texts``: text, position, hash of the anchor, and hash of all the
    text that a window around it can hold.

    An anchor is the GRAM bytes with the least hash in some window of LENGTH bytes
    within a text (all of them, if several are least)."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    if len(buf) < LENGTH:
        return nothing
    sizes = np.array([len(x) for x in texts])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    h, have = buf.astype(np.uint64) + np.uint64(1), 1
    while have < GRAM:
        h = h[:-have] * np.uint64(pow(BASE, have, 1 << 64)) + h[have:]
        have *= 2
    h = mix(h) | np.uint64(1)
    least = _sliding(h, WINDOW, np.minimum)
    valid = np.zeros(len(least), bool)
    for b, n in zip(bounds[:-1], sizes, strict=True):
        if n >= LENGTH:
            valid[b : b + n - LENGTH + 1] = True
    least = np.where(valid, least, np.uint64(0))
    edge = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), WINDOW, np.maximum) == h)
    text = np.searchsorted(bounds, at, "right") - 1
    begin = np.maximum(bounds[text], at - WINDOW + 1)
    end = np.minimum(bounds[text + 1], at + LENGTH)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((mix(buf.astype(np.uint64))) * powers(BASE, len(buf)), out=total[1:])
    around = (total[end] - total[begin]) * powers(BASE_INVERSE, len(buf) + 1)[begin]
    around = mix(around + mix(((at - begin) << 32 | (end - begin)).astype(np.uint64)))
    return text, at - bounds[text], h[at], around


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ANCHOR.split(", ")]
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        texts, order = as_bytes(batch.column("text")), np.argsort(ids, kind="stable")
        ids, texts = ids[order], [texts[i] for i in order]
        parts = []
        for b, e in blocks(texts):
            text, at, h, around = anchors(texts[b:e])
            parts.append((ids[b + text], at, h, around))
        doc, at, h, around = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
        if not len(doc):
            continue
        both = mix(h.view(np.uint64) + mix(around.view(np.uint64)))
        order = np.argsort(both, kind="stable")  # rows stand by document and position
        begin, end = runs(both[order])
        first = order[np.repeat(begin, end - begin)]
        known = np.zeros(len(doc), bool)
        known[order] = first != order
        same = np.zeros(len(doc), bool)
        same[order] = (doc[first] == doc[order]) & (at[first] == at[order])
        use = ~(known & same)
        # what repeats in this batch needs no comparing and must not gather under one key
        key = np.where(known, mix(doc.view(np.uint64) * np.uint64(BASE) + at.view(np.uint64)), h.view(np.uint64))
        columns = [key.view(np.int64), around.view(np.int64), doc, at, known]
        yield pa.RecordBatch.from_arrays([pa.array(c[use]) for c in columns], names)


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the anchors with one hash: those whose surroundings occurred earlier, and
    the first of each surrounding if there are several (with the hash)."""
    for part in whole_runs(batches, "key"):
        key, around, doc, at, known = (part[x.split()[0]].to_numpy() for x in ANCHOR.split(", "))
        order = np.lexsort((at, doc, around, key))
        key, around, doc, at, known = (c[order] for c in (key, around, doc, at, known))
        begin, end = runs(key)
        group = np.repeat(np.arange(len(begin)), end - begin)
        new = np.ones(len(key), bool)
        new[1:] = (group[1:] != group[:-1]) | (around[1:] != around[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        repeat = known | ((doc != doc[first]) | (at != at[first]))
        several = np.bincount(group, new & ~known, minlength=len(begin))[group] > 1
        ask = new & several & ~known
        use = repeat | ask
        if use.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[use]) for c in (doc, at, key, ask)], ["doc_id", "at", "key", "ask"])


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``codes`` (0 to 256), by Larsson and Sadakane's
    refinement: sort by the first seven, then double the depth, looking only at
    suffixes that are still tied."""
    n, depth = len(codes), 7
    padded = np.concatenate((codes, np.zeros(depth, codes.dtype))).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key = key << 9 | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    begin, end = runs(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, end - begin)
    many = end - begin > 1
    tied = np.flatnonzero(np.repeat(many, end - begin))
    while len(tied):
        at = order[tied]
        next_rank = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)], -1)
        own = rank[at]
        again = np.lexsort((next_rank, own))
        at, own, next_rank = at[again], own[again], next_rank[again]
        order[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (next_rank[1:] != next_rank[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        rank[at] = np.repeat(tied[begin], size)
        tied = tied[np.repeat(size > 1, size)]
        depth *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """For each place in ``order``, how much its suffix shares with the one before: at
    most ``most``, within its own piece [begin, end) of the text.

    Kasai's rule, that the next suffix shares at least one less, run over all pieces
    side by side."""
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.arange(len(codes))
    shared = np.zeros(len(codes), np.int64)
    have = np.zeros(len(begin), np.int64)
    piece = np.arange(len(begin))
    for t in range(int((end - begin).max(initial=0))):
        piece = piece[begin[piece] + t < end[piece]]
        i = begin[piece] + t
        place = rank[i]
        j, n = order[place - 1], np.maximum(have[piece] - 1, 0)
        n[place == 0] = 0
        limit = np.minimum(most, end[piece] - i)
        go = np.flatnonzero((place > 0) & (n < limit))
        while len(go):
            a, b = i[go] + n[go], j[go] + n[go]
            go = go[(b < len(codes)) & (codes[a] == codes[np.minimum(b, len(codes) - 1)])]
            n[go] += 1
            go = go[n[go] < limit[go]]
        shared[place] = n
        have[piece] = n
    return shared


def _rows(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LENGTH bytes at each position as big-endian words, so they compare as text."""
    wide = -(-LENGTH // 8) * 8
    out = np.zeros((len(at), wide), np.uint8)
    out[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)[at]
    return out.view(">u8").astype(np.uint64)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    at = np.argmax(differ, axis=1)
    i = np.arange(len(a))
    return differ[i, at] & (a[i, at] < b[i, at])


def among(sorted_rows: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of ``rows`` binary search finds in ``sorted_rows``."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(sorted_rows))
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        less = _less(sorted_rows[middle], rows[open_])
        low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
    found = low < len(sorted_rows)
    found[found] = (sorted_rows[low[found]] == rows[found]).all(1)
    return found


def repeats_in(texts: list[bytes], doc: np.ndarray, at: np.ndarray, earlier: list[np.ndarray], keep: bool) -> tuple[np.ndarray, ...]:
    """Spans (doc, begin, end) of the pieces ``texts`` (from ``doc`` at ``at``) covered
    by LENGTH bytes that also start earlier in a piece, or are ``among`` the rows of
    an earlier shard; and, to ``keep``, this shard's own rows, sorted."""
    sizes = np.array([len(x) for x in texts])
    codes = np.zeros(int(sizes.sum()) + len(texts), np.int16)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    codes[:] = flat
    codes += 1
    codes[begin + sizes] = 0
    order = suffix_array(codes)
    shared = common_prefixes(codes, order, begin, begin + sizes, LENGTH)
    owner = np.searchsorted(begin, order, "right") - 1
    whole = begin[owner] + sizes[owner] - order >= LENGTH
    group = np.cumsum(shared < LENGTH)[whole]
    place, owner = order[whole], owner[whole]
    start = at[owner] + place - begin[owner]
    by = np.lexsort((start, doc[owner], group))
    group, place, owner, start = group[by], place[by], owner[by], start[by]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0)) if len(group) else np.zeros(0, np.int64)
    repeat = (doc[owner] != doc[owner[first]]) | (start != start[first])
    own = []
    if earlier or keep:
        distinct, found = place[new], np.zeros(len(group), bool)
        seen = []
        for i in range(0, len(distinct), ROWS_AT_ONCE):
            rows = _rows(flat, distinct[i : i + ROWS_AT_ONCE])
            seen.append(np.any([among(x, rows) for x in earlier], axis=0) if earlier else np.zeros(len(rows), bool))
            own += [rows] if keep else []
        found[new] = np.concatenate(seen) if seen else False
        repeat |= found[first]
    marked = np.zeros(len(codes) + 1, bool)
    marked[place[repeat]] = True
    low, high = spans(marked)
    piece = np.searchsorted(begin, low, "right") - 1
    shift = at[piece] - begin[piece]
    return doc[piece], low + shift, high + shift + LENGTH - 1, np.concatenate(own) if own else None


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over the surroundings of whole anchor groups. A group too large
    for one shard is cut between documents, and each shard is looked up in those
    before it."""

    def shard(rows: dict, earlier: list, keep: bool = False) -> tuple[pa.RecordBatch, np.ndarray | None]:
        *columns, own = repeats_in(rows["piece"], np.array(rows["doc_id"]), np.array(rows["begin"]), earlier, keep)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "begin", "end"]), own

    def empty() -> dict:
        return {"piece": [], "doc_id": [], "begin": []}

    held, size, earlier, last, own_from = empty(), 0, [], (None, None), 0
    for batch in batches:
        for key, doc, begin, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "begin", "piece")), strict=True):
            if key != last[0]:
                if earlier or size >= SHARD_BYTES:
                    yield shard(held, earlier)[0]
                    held, size, earlier = empty(), 0, []
                own_from = len(held["piece"])
            elif size >= SHARD_BYTES and doc != last[1]:
                if own_from:  # other groups need not be in order with this one
                    yield shard({k: v[:own_from] for k, v in held.items()}, [])[0]
                    held = {k: v[own_from:] for k, v in held.items()}
                    size, own_from = sum(map(len, held["piece"])), 0
                if size >= SHARD_BYTES:
                    out, own = shard(held, earlier, keep=True)
                    yield out
                    earlier += [own] if own is not None else []
                    held, size = empty(), 0
            held["piece"].append(piece)
            held["doc_id"].append(doc)
            held["begin"].append(begin)
            size, last = size + len(piece), (key, doc)
    if size:
        yield shard(held, earlier)[0]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: where documents hold bytes of an earlier equal string; spans
    overlap and stand in any order. Documents without any are absent."""
    by_id = docs.repartition("doc_id")
    sorted_out = (
        docs.mapInArrow(_find_anchors, ANCHOR).repartition("key").sortWithinPartitions("key")
        .mapInArrow(_sort_out, "doc_id long, at long, key long, ask boolean")
    )
    events = materialize(sorted_out)
    asked = events.where("ask").groupBy("doc_id").agg(F.collect_list(F.struct("at", "key")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, asked in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
                for a in asked:
                    begin = max(0, a["at"] - WINDOW + 1)
                    rows.append((a["key"], doc, begin, text[begin : a["at"] + LENGTH]))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "doc_id", "begin", "piece"])

    pieces = by_id.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(cut, "key long, doc_id long, begin long, piece binary")
    compared = pieces.repartition("key").sortWithinPartitions("key", "doc_id", "begin").mapInArrow(_compare, "doc_id long, begin long, end long")
    known = events.where("not ask").select("doc_id", F.greatest(F.lit(0), F.col("at") - WINDOW + 1).alias("begin"), (F.col("at") + LENGTH).alias("end"))
    return known.union(compared).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` without the bytes that LENGTH bytes cover which also start
    earlier (a smaller doc_id, or earlier in the same document): doc_id, n_bytes,
    ``removed`` (the maximal spans, begin and end in bytes) and ``kept`` (binary: what
    is left need not be whole characters). Strings are judged on the input.

    Every row stays. A null text is empty. Rows that share a doc_id count as one
    place: what starts at the same byte there is no repeat. Rows with a null doc_id
    are kept whole and compared with nothing."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = repeated_spans(docs.where("doc_id is not null"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n, removed, kept = [], [], []
            for text, found in zip(as_bytes(batch.column("text")), batch.column("spans"), strict=True):
                n.append(len(text))
                if not found.is_valid:
                    removed.append([])
                    kept.append(text)
                    continue
                begin, end = (found.values.field(k).to_numpy() for k in range(2))
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, begin, 1)
                np.subtract.at(depth, np.minimum(end, len(text)), 1)
                gone = np.cumsum(depth[:-1]) > 0
                removed.append([{"begin": b, "end": e} for b, e in zip(*(x.tolist() for x in spans(gone)), strict=True)])
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    joined = docs.repartition("doc_id").join(found, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<begin: long, end: long>>, kept binary")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
