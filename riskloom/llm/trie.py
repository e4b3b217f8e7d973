"""Prefix trie of conversations, built level by level.

At each depth the conversations that still share their path are grouped by their node and
their next turn; the least conv_id of a group names the new node. A conversation that is
alone in its node shares nothing deeper, so the rest of its path is a chain and is written
down at once: levels are as many as the deepest shared node, not the longest conversation.
Joins from the deepest level up then add up what stands below each node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import numbered
from .common import materialize, small_batches, table

#: Most turns that are taken from the first conversation of a block, and conversations in a block.
SHARED, BLOCK = 5, 100
#: Members from which a node is hot, at least; and most hot nodes of a level, which are broadcast.
HOT, HOT_NODES = 10_000, 1_000
#: Nodes of a chain that one row grows into at once.
LINK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` to ``(conv_id, idx, said, chars)``: turns
    numbered from 0, a digest of role and text, and the code points of the text.

    Rows stand by turn, ties by role and text; a null turn comes first, null roles and texts
    are empty, rows without a conv_id are left out, repeated rows are repeated turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(" "), "role", "text"), 256))
    return numbered(rows, ["conv_id"], ["turn", "role", "text"], select=["conv_id", said.alias("said"), F.length("text").cast("long").alias("chars")])


def plain_paths(turns: DataFrame) -> DataFrame:
    """Each conversation of ``turns`` as it stands, as ``paths`` for ``trie``."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.col("conv_id").alias("base"), F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("head"), F.col("n").alias("length"))


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of the first one of its
    block, c - c % BLOCK (fewer, if that has fewer); h = crc32(c in decimal) % (SHARED + 1).
    Columns: conv_id, base, own (turns of its own that are skipped), head (turns taken from
    base) and length."""
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    block = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base")
    convs = size.select("conv_id", "n", block, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).alias("own"))
    head = F.least("own", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(size.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("head", head)
    return convs.select("conv_id", "base", "own", "head", (F.col("head") + F.greatest(F.col("n") - F.col("own"), F.lit(0))).alias("length"))


def _joined(rows: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to ``nodes(*keys, n, ...)``, one a key with its number of rows. Keys of
    very many rows, HOT_NODES at most, are broadcast, so their rows stay where they lie."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    at_least = max(HOT, -(-total // HOT_NODES))
    hot, cold = nodes.where(F.col("n") > at_least), nodes.where(F.col("n") <= at_least)
    if hot.isEmpty():
        return rows.join(nodes, keys)
    hot = F.broadcast(hot)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def _end_digests(ends: DataFrame) -> DataFrame:
    """``ends(depth, node, conv_id)`` to the SHA-256 of each node's ids in order, joined by
    commas; the ids stream past, so a node may have any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for depth, node, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "conv_id")), strict=True):
                if (depth, node) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (depth, node), hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["depth", "node", "ends_sha256"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], ["depth", "node", "ends_sha256"])

    return ends.repartition("depth", "node").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(run, "depth long, node long, ends_sha256 string")


def _chains(lone: DataFrame) -> DataFrame:
    """The nodes of conversations that are alone from ``depth`` on, to their last turn."""
    links = lone.select("*", F.explode(F.expr(f"sequence(0, (length - depth) div {LINK})")).alias("link"))
    links = links.repartition("conv_id", "link")  # a long chain is dealt out
    low = F.col("depth") + F.col("link") * LINK
    at = links.select("conv_id", "parent", "length", F.col("depth").alias("top"), F.explode(F.sequence(low, F.least(low + LINK - 1, F.col("length")))).alias("depth"))
    last = F.col("depth") == F.col("length")
    one = F.lit(1).cast("long")
    return at.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, 0).otherwise(one).alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )


def trie(turns: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``paths`` over ``turns``: conv_id (least member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over its
    subtree: members but one, times the code points of the last turn), ends_sha256 (ids of the
    members that end there).

    Two nodes are told apart by SHA-256 digests of turns. A path may be empty: it ends at the
    root. No paths give no nodes, not even a root."""
    turns = turns.select("conv_id", "idx", "said", "chars")
    top = paths.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).where("n > 0")
    nodes = [materialize(top.select("node", F.lit(None).cast("long").alias("parent"), "n", F.lit(0).cast("long").alias("chars")))]
    if (root := nodes[0].first()) is None:
        return nodes[0].sparkSession.createDataFrame([], NODE)
    live = materialize(paths.select("conv_id", "base", "own", "head", "length", F.lit(root["node"]).cast("long").alias("node")))
    ends, lone, depth = [live.where("length = 0").select(F.lit(0).cast("long").alias("depth"), "node", "conv_id")], [None], 0
    while True:
        depth += 1
        # the turn of each live conversation at this depth: one of the block's first, or of its own
        taken = F.col("head") >= depth
        wanted = live.where(F.col("length") >= depth).select(
            F.when(taken, F.col("base")).otherwise(F.col("conv_id")).alias("from"),
            F.when(taken, F.lit(depth - 1)).otherwise(F.col("own") + depth - 1 - F.col("head")).alias("idx"), F.col("node").alias("parent"), *live.columns[:-1],
        )
        said = turns.where(F.col("idx") < depth + SHARED).withColumnRenamed("conv_id", "from")
        here = materialize(wanted.join(said, ["from", "idx"]).select("parent", "said", "chars", *live.columns[:-1]))
        # one that is alone goes on as a chain: its length is the greatest of one
        groups = materialize(here.groupBy("parent", "said").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.first("chars").alias("chars"), F.max("length").alias("length")))
        lone.append(groups.where("n = 1").select(F.col("node").alias("conv_id"), "parent", F.lit(depth).cast("long").alias("depth"), "length"))
        shared = groups.where("n > 1")
        if shared.isEmpty():
            break
        nodes.append(shared.select("node", "parent", "n", "chars"))
        live = materialize(_joined(here.drop("chars"), shared.select("parent", "said", "node", "n"), ["parent", "said"]).select("conv_id", "base", "own", "head", "length", "node"))
        ends.append(live.where(F.col("length") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
    parts, below = [], None
    for depth in reversed(range(len(nodes))):
        alone = lone[depth + 1].select("parent", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        under = alone if below is None else alone.unionByName(below.select("parent", "leaves", "saved"))
        under = under.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        saved = (F.col("n") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))
        below = materialize(nodes[depth].join(under, "node", "left").select("node", "parent", "n", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), saved.alias("saved")))
        parts.append(below.select("*", F.lit(depth).cast("long").alias("depth")))
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    known = union(parts).join(_end_digests(union(ends)), ["depth", "node"], "left")
    known = known.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return known.unionByName(_chains(union(lone[1:])))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    turns = turns_of(table(spark, sf_dir, "conversations"))
    return trie(turns, rebuilt_paths(turns))
