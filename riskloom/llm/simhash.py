"""SimHash fingerprints and near-duplicate groups by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, blocks, is_space, lowered, materialize, mix, runs, sliced, small_batches, spans, table, tidy, whole_runs, word_hashes
from .components import components
from .setjoin import COUNTERS, PARTNERS, Reader, alike, indexed, met, named, nearest, places, whole_sets, word_sets

SEED = 42
HASHES_AT_ONCE = 1 << 18


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the ``width``-word shingles of lower-cased ``text``.

    Repeats count. Fewer words than ``width``: one shingle of them all; no word: 0.
    A bit is 1 if it is set in over half of the hashes."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    left = n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    while left:
        take = min(left, HASHES_AT_ONCE)
        block = np.fromiter(hashes, np.uint64, take)
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, take - take % 255, 255 * 256):
            part = bits[at : min(at + 255 * 256, take - take % 255)]
            ones += part.reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[take - take % 255 :].sum(0, dtype=np.int64)
        left -= take
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp long)``, a row for each row. A null
    text counts as empty; a null doc_id is kept."""

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fp = np.array([fingerprint(x, width) for x in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, fp long")


def segments_for(distance: int) -> int:
    """The fewest segments of which one differs by at most one bit."""
    return distance // 2 + 1


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of ``fps`` within ``distance`` bits, found by
    breadth-first search; never more edges than nodes."""
    rest, found = fps, []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ (here := frontier.pop())) <= distance
            if near.any():
                found += [(here, x) for x in rest[near]]
                frontier += list(rest[near])
                rest = rest[~near]
    return found


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``(fp)`` such that two are
    connected exactly if a chain of steps of at most ``distance`` bits joins them.

    Each fingerprint is cut into ``distance // 2 + 1`` segments, so a pair within
    ``distance`` agrees in one but for at most one bit. Each segment is indexed
    with each of its bits as a wildcard in turn; equal keys meet in a sorted
    stream, are verified on all 64 bits, and give a spanning forest, not pairs."""
    count = segments_for(distance)
    cuts = [round(i * 64 / count) for i in range(count + 1)]
    keys = []
    for s, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for i in range(high - low):
            mask = ((1 << (high - low)) - 1) & ~(1 << i)
            rest = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
            # a lone segment leaves no room beside it for the wildcard's place: those keys are hashed
            keys.append(F.xxhash64(F.lit(i), rest) if count == 1 else rest + F.lit((s * 64 + i) << 51))
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes become many rows: a number keeps Spark from joining tasks
    # by a hash of fp: a repartition by fp itself would fall away behind a grouping by fp
    variants = distinct.repartition(tasks, F.xxhash64("fp")).select("fp", F.explode(F.array(*keys)).alias("key"))

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, "key"):
            key, fp = part["key"].to_numpy(), part["fp"].to_numpy().view(np.uint64)
            begin, end = runs(key)
            two = begin[end - begin == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            more = [e for b, e in zip(*(x[end - begin > 2] for x in (begin, end)), strict=False) for e in _forest(fp[b:e], distance)]
            a, b = np.array(more, np.uint64).reshape(-1, 2).T
            pair = [np.concatenate(x).view(np.int64) for x in ((fp[two], a), (fp[two + 1], b))]
            if len(pair[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b"])

    met = variants.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Equal fingerprints are one class before anything is compared, so copies cost
    nothing; component_id is the least doc_id that links of at most ``distance``
    bits reach. Empty texts share fingerprint zero. Rows whose doc_id is null keep
    it, and count for no component_id unless all of theirs are null."""
    each = materialize(fingerprints(docs, width))
    least = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = components(links(least.select("fp"), distance)).toDF("fp", "root")
    classes = least.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    root = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    final = classes.join(root, "root").select("fp", "component_id")
    return each.join(final, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_words(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row: hashes of their ``width``-word shingles (of all words, if a
    text has fewer), the text of each, and a number for each text. Words are what white
    space parts, in ASCII small letters."""
    buf = lowered(np.frombuffer(b"\n".join(texts), np.uint8))
    begin, end = spans(~is_space(buf))
    words = word_hashes(buf, begin, end)
    bounds = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in texts)]))
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(texts)), n)
    take = np.minimum(width, n[text])
    whole = np.flatnonzero(np.arange(len(words)) - bounds[text] + take <= n[text])
    take, total = take[whole], np.zeros(len(whole), np.uint64)
    for k in range(width):
        part = mix(words[np.minimum(whole + k, len(words) - 1)] + np.uint64(k + 1))
        total += np.where(k < take, part * np.uint64(2 * k + 1), np.uint64(0))
    return mix(total + take.astype(np.uint64)), text[whole], np.arange(len(texts) + 1)


SHINGLES = Reader(shingle_words, lambda text: [text])


@tidy
def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: the id of its set of shingles (0: none) and its SimHash over them."""
    nothing = np.zeros(COUNTERS, np.uint8)
    for batch in sliced(batches):
        texts = as_bytes(batch.column("text"))
        sets, fps = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64)
        for b, e in blocks(texts):
            words, text, _ = shingle_words(texts[b:e])
            for at in range(0, len(words), HASHES_AT_ONCE):  # whole texts of a block, or parts of a long one
                bits = np.unpackbits(words[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                begin, _ = runs(text[at : at + HASHES_AT_ONCE])
                part = np.add.reduceat(bits, begin, axis=0, dtype=np.int32), text[at + begin]
                ones = np.zeros((e - b, 64), np.int64) if not at else ones
                ones[part[1]] += part[0]
            if len(words):
                n = np.bincount(text, minlength=e - b)
                fps[b:e] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            _, _, _, number, ids = word_sets(words, text, nothing)
            sets[b + number] = ids
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets), pa.array(fps.view(np.int64))], ["doc_id", "line_set", "fp"])


def sketch_pairs(classes: DataFrame, distance: int) -> DataFrame:
    """Candidates among ``classes(line_set, fp)`` by SimHash: (line_set, partner, far)."""
    least = classes.groupBy("fp").agg(F.min("line_set").alias("node"))
    same = classes.join(least, "fp").where("line_set <> node").select("line_set", F.col("node").alias("partner"), F.lit(0).alias("far"))
    ends = links(least.select("fp"), distance).join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b")
    return same.union(ends.select("x", "y", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("far")))


def verified_duplicates(docs: DataFrame, distance: int = 7, partners: int = PARTNERS) -> DataFrame:
    """``(doc_id, component_id)`` for every doc_id: the groups that links of verified
    similarity make, named by their least doc_id.

    A link joins two texts whose sets of five-word shingles have a Jaccard similarity of
    4/5 or more. SimHash variants find the candidates within ``distance`` bits; as a
    SimHash does not bound the similarity, the prefix filter of the exact set join then
    finds whatever pair between two groups is still unlinked, in rounds, until none is
    left. So no link is lost, up to 64-bit hash collisions.

    Equal sets are one class, so copies cost nothing. Rows that share a doc_id share its
    fate; texts without a word (null ones too) are one class; rows without a doc_id are
    left out."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    members = materialize(docs.mapInArrow(_described, "doc_id long, line_set long, fp long"))
    classes = materialize(members.where("line_set <> 0").groupBy("line_set").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp")))
    sketched = materialize(sketch_pairs(classes.select("line_set", "fp"), distance))
    now = met(indexed(docs.where("text is not null"), SHINGLES), partners, grouped=True)
    asked = sketched.select("line_set").union(sketched.select("partner")).distinct().join(classes, "line_set").select("line_set", "doc_id", F.lit(0).cast("long").alias("line"))
    sets = whole_sets(materialize(asked.union(places(now)).dropDuplicates(["line_set"])), docs, SHINGLES)
    own = members.groupBy("doc_id").agg(F.min("line_set").alias("a"), F.max("line_set").alias("b")).where("a <> b").select("doc_id", "a")
    copies = materialize(members.join(own, "doc_id").select("a", F.col("line_set").alias("b")).distinct())
    groups = components(copies.union(alike(nearest(sketched), sets)))
    pairs = sketched.union(named(now))
    while True:
        groups = components(groups.union(alike(_between(pairs, groups), sets)))
        held = _marked(now.where("partner is null").drop("partner", "partner_doc", "partner_line", "far"), groups)
        if held.isEmpty():
            break
        partners *= 16
        now = met(held, partners, grouped=True)
        pairs = named(now)
    root = members.join(groups.toDF("line_set", "root"), "line_set", "left").select("doc_id", F.coalesce("root", "line_set").alias("root"))
    root = materialize(root.groupBy("doc_id").agg(F.min("root").alias("root")))
    return root.join(root.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def _marked(rows: DataFrame, groups: DataFrame, key: str = "line_set", name: str = "mark") -> DataFrame:
    """``rows`` with the group of ``key`` as ``name``: its own, if it has none."""
    return rows.join(groups.toDF(key, name), key, "left").withColumn(name, F.coalesce(name, key))


def _between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The ``pairs`` whose ends are in different groups."""
    both = _marked(_marked(pairs.select("line_set", "partner"), groups), groups, "partner", "other")
    return both.where("mark <> other").select("line_set", "partner")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))
