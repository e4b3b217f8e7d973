"""Line deduplication: an exact set-similarity join of all lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_space, lowered, materialize, small_batches, spans, table, word_hashes
from .setjoin import PARTNERS, Reader, alike, indexed, met, named, nearest, places, whole_sets


def line_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row: word hashes, the line of each word, and where each
    text's lines begin. Lines end with a newline; words are what white space
    parts, in ASCII small letters."""
    buf = lowered(np.frombuffer(b"\n".join(texts), np.uint8))
    begin, end = spans(~is_space(buf))
    newline = np.flatnonzero(buf == 10)
    starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    words_before = np.concatenate(([0], np.searchsorted(begin, newline), [len(begin)]))
    line = np.repeat(np.arange(len(newline) + 1), np.diff(words_before))
    return word_hashes(buf, begin, end), line, np.searchsorted(newline, starts - 1, "left") + (starts > 0)


LINES = Reader(line_words, lambda text: text.split(b"\n"))


def kept_lines(docs: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """``(doc_id, line)`` of the lines of ``docs`` that have words and match no
    earlier line (by doc_id, then position).

    Each line set is held against its nearest candidate first, then against the others
    of the ``partners`` nearest under each word. Sets that had more, none of the first
    alike, look further, at 16 times as many each round, among the index rows that the
    round before held back; so no link is lost, and no text is read again."""
    events = met(indexed(docs, LINES), partners, with_places=True)
    first = events.where("line_set = partner").select("line_set", "doc_id", "line")
    sets = whole_sets(places(events), docs, LINES)
    matched, now = None, events
    while True:
        pairs = materialize(named(now))
        found = alike(nearest(pairs), sets).select("line_set").distinct()
        again = alike(pairs.join(found, "line_set", "left_anti"), sets).select("line_set").distinct()
        found = materialize(found.union(again))
        matched = found if matched is None else matched.union(found)
        held = now.where("partner is null").drop("partner", "partner_doc", "partner_line", "far")
        held = held.join(matched.select("line_set", F.lit(0).alias("mark")), "line_set", "left").withColumn("mark", F.coalesce("mark", F.lit(1)))
        if held.where("mark = 1").isEmpty():
            return first.join(matched, "line_set", "left_anti").select("doc_id", "line")
        partners *= 16
        now = met(held, partners)


def dedup_lines(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text)`` without the lines that match an earlier one: doc_id,
    text (what is left), n_lines, n_removed, and the columns to ``carry`` as a struct
    ``carried`` (so no name can clash); every row stays.

    Two lines match if the Jaccard similarity of their word sets is at least 4/5,
    judged on the input, whether or not the earlier line
    stays itself. Words are told apart by 64-bit hashes. Lines without a word match
    nothing and stay. A null text stays null and has no lines. Rows that share a
    doc_id count as one place: the same line number in them is not a repeat.
    Rows with a null doc_id are kept as they are and matched with nothing. No rows, no
    result."""
    extra = [F.struct(*carry).alias("carried")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra)
    known = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    kept = kept_lines(known).groupBy("doc_id").agg(F.collect_list("line").alias("kept"))

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(whole: pd.Series, text: pd.Series, kept: pd.Series) -> pd.DataFrame:
        rows = []
        for whole, text, kept in zip(whole, text, kept, strict=True):
            lines = [] if text is None else text.split("\n")
            stay = set(kept if kept is not None else ())
            left = [x for i, x in enumerate(lines) if i in stay or whole or not x.encode().split()]
            rows.append((None if text is None else "\n".join(left), len(lines), len(lines) - len(left)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])

    # rows without a doc_id are dealt out by their text: they must not gather in one task
    spread = F.coalesce("doc_id", F.xxhash64("text"))
    joined = docs.withColumn("_spread", spread).join(kept.withColumnRenamed("doc_id", "_spread"), "_spread", "left")
    out = joined.withColumn("cut", cut(F.isnull("doc_id"), "text", "kept"))
    return out.select("doc_id", "cut.*", *(["carried"] if carry else []))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
