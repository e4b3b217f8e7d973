"""Filter interaction audit: what each of five filters removes in any order of them.

Only native expressions: every document gets a mask of the filters that it fails, one
grouping counts the masks of each part, and all orders are worked out from those counts."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Fewest words; percent of words that differ at least; percent of capitals at most.
WORDS, DISTINCT, CAPITALS = 200, 50, 3
SPACE, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def own_failures(text: Column) -> Column:
    """The bits of the filters that a text fails by itself: all but E."""
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    return F.transform(
        F.array(F.struct(words.alias("words"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).alias("capitals"))),
        lambda x: F.when(F.size(x["words"]) < WORDS, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(x["words"])).cast("long") < DISTINCT * F.size(x["words"]).cast("long"), 2).otherwise(0)
        + F.when(100 * x["capitals"].cast("long") > CAPITALS * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike(MARKS), 8).otherwise(0),
    )[0]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: how many documents of each part fail just the
    filters of ``mask``.

    Texts leave as SHA-256 digests. Rows are counted by digest, part and doc_id, so copies
    of one row meet before they are shuffled; then the least doc_id of each digest and part,
    with its counts, and over the few parts of a digest the least of all. What stands there
    passes E, all else fails it, so no row is joined back to its text's group."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("own"))
    rows = rows.groupBy("digest", "part", "doc_id").agg(F.first("own").alias("own"), F.count("*").alias("n"))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    # rows without a doc_id have no label and are dealt out by their digests
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    rows = rows.join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").select("digest", "part", "doc_id", "own", "n", *((F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")))
    counts = ("n", "good", "toxic")
    # of each digest and part: all rows, and those of the least doc_id or of none, which fail E never
    null = F.col("doc_id").isNull()
    grouped = rows.groupBy("digest", "part").agg(
        F.first("own").alias("own"), F.min("doc_id").alias("least"),
        *(F.sum(c).alias(c) for c in counts),
        *(F.coalesce(F.sum(F.when(null, F.col(c))), F.lit(0)).alias(f"{c}_null") for c in counts),
        F.min_by(F.struct(*counts), F.when(~null, F.col("doc_id"))).alias("first"),
    )
    here = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    passing = [(F.col(f"{c}_null") + F.coalesce(F.when(here, F.col(f"first.{c}")), F.lit(0))).alias(f"{c}_pass") for c in counts]
    split = grouped.select("part", "own", *counts, *passing)
    summed = split.groupBy("part", "own").agg(*(F.sum(f"{c}_pass").alias(f"{c}_pass") for c in counts), *(F.sum(F.col(c) - F.col(f"{c}_pass")).alias(f"{c}_fail") for c in counts))
    both = F.explode(F.array(*(F.struct((F.col("own") + bit).alias("mask"), *(F.col(f"{c}_{name}").alias(c) for c in counts)) for bit, name in ((0, "pass"), (16, "fail")))))
    return summed.select("part", both.alias("cell")).select("part", "cell.*")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part of ``docs(doc_id, text, lang)``, order of the filters and step: part,
    filter_order, step, and of that step's filter kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    A part is a value of lang, null being the empty one. A null text is empty. Equal texts
    of one doc_id are no copies of each other; a row without a doc_id has no smaller one
    and is none, so it fails E never, and has no label. A doc_id with several rows in
    ``labels(doc_id, quality, toxic)`` is good or toxic if one of them says so; each of its
    documents counts. Extra columns are ignored; no documents give no rows."""
    cells = masks(docs, labels)
    order = F.explode(F.array(*map(F.lit, ORDERS)))
    steps = cells.select("*", order.alias("filter_order")).select("*", F.explode(F.array(*map(F.lit, range(1, 6)))).alias("step"))
    one = F.expr("shiftleft(1, locate(substr(filter_order, step, 1), 'ABCDE') - 1)")
    before = F.expr("aggregate(sequence(1, 5), 0, (sum, k) -> sum + if(k < step, shiftleft(1, locate(substr(filter_order, k, 1), 'ABCDE') - 1), 0))")
    mask = F.col("mask")
    steps = steps.select("*", one.alias("one"), before.alias("before"))
    fails, open_ = mask.bitwiseAND(F.col("one")) > 0, mask.bitwiseAND(F.col("before")) == 0
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).alias
    # a document that fails k filters is removed by each of them in 120 / k orders
    share = F.col("n") * F.floor(F.lit(len(ORDERS)) / F.bit_count("mask")).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total("n", open_ & ~fails)("kept"), total("n", open_ & fails)("removed"), total("n", ~open_ & fails)("redundant"),
        total("n", mask == F.col("one"))("unique_fails"), total("good", open_ & fails)("good_lost"), total("toxic", open_ & fails)("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).alias("shapley"),
    )


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
      || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
      || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS failed
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), h AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, failed),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x)
  JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), s AS (
  SELECT part, filter_order, step, n, good, toxic, failed, filter_order[step] AS x,
    contains(failed, filter_order[step]) AS fails, len(list_filter(range(1, step), lambda k: contains(failed, filter_order[k]))) = 0 AS still
  FROM h CROSS JOIN o CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), g AS (
  SELECT part, filter_order, step, x, sum(CASE WHEN still AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN still AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN NOT still AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN still AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN still AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM g
"""
