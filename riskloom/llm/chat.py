"""Chat formatting: each assistant turn becomes an example of its own."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidy

#: The strings around the text of a turn, and those of any other role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[END]")
TARGET = "assistant"
#: Characters of examples that are sent on at once.
FLUSH = 1 << 21
EXAMPLE = "conv_id long, n_turns long, target boolean, formatted string, loss_begin long, loss_end long"

_rest = r"((?:/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|END\]))"
_plain, _escaped = re.compile(r"([<\[])(\\*)" + _rest), re.compile(r"([<\[])\\(\\*)" + _rest)
_control = re.compile("|".join(map(re.escape, (*(x for pair in MARKS.values() for x in pair), *OTHER))))


def escape(text: str) -> str:
    """``text`` without control strings: each gets a backslash behind its first
    character, and so does what would read as escaped."""
    return _plain.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends."""
    before, after = MARKS.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
    text = escape(text)
    return before + text + after, len(before), len(before) + len(text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted example."""
    opened = {before: role for role, (before, _) in MARKS.items()}
    turns, role, begin = [], None, 0
    for mark in _control.finditer(formatted):
        if mark[0] in opened:
            role, begin = opened[mark[0]], mark.end()
        elif mark[0] == OTHER[0]:
            begin = mark.end()
        elif mark[0] == OTHER[1]:
            role, begin = unescape(formatted[begin : mark.start()]), mark.end()
        else:
            turns.append((role, unescape(formatted[begin : mark.start()])))
    return turns


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """Examples of ``conversations(conv_id, turn, role, text)``: for every assistant
    turn all turns before it and itself, formatted; only its text is trainable
    (loss_begin to loss_end, in characters). Turns that no assistant turn follows
    make a last example without a target, so that nothing of a conversation is lost.

    Rows stand by turn, ties by role and text; a null turn comes first, null roles
    and texts are empty, rows with a null conv_id are one conversation, repeated rows
    are repeated turns. The rows of a conversation stream past in order; a task holds
    the text of one, which its last example is anyway, and FLUSH characters of examples."""

    @tidy
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in EXAMPLE.split(", ")]
        now, prefix, n, pending, started = None, "", 0, False, False
        out, held = [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c) for c in ("conv_id", "role", "text")), strict=True):
                conv, role, text = conv.as_py(), role.as_py(), text.as_py()
                if not started or conv != now:
                    if pending:
                        out.append((now, n, False, prefix, len(prefix), len(prefix)))
                        held += len(prefix)
                    now, prefix, n, started = conv, "", 0, True
                turn, begin, end = render(role or "", text or "")
                at, prefix, n = len(prefix), prefix + turn, n + 1
                pending = role != TARGET
                if not pending:
                    out.append((conv, n, True, prefix, at + begin, at + end))
                    held += len(prefix)
                if held > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                    out, held = [], 0
        if pending:
            out.append((now, n, False, prefix, len(prefix), len(prefix)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(build, EXAMPLE)


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them."""

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, loss, size = [], [], []
            ids = batch.column("conv_id").to_pylist()
            for i, (text, begin, end) in enumerate(zip(*(batch.column(c) for c in ("formatted", "loss_begin", "loss_end")), strict=True)):
                text, begin, end = text.as_py(), begin.as_py(), end.as_py()
                # an example that the next one extends says nothing that the next does not
                last = i + 1 == len(ids) or ids[i + 1] != ids[i]
                turns.append("".join(f"{role}\n{said}\n" for role, said in read_back(text)) if last else None)
                loss.append(unescape(text[begin:end]))
                size.append(len(text))
            columns = [batch.column("conv_id"), batch.column("n_turns"), pa.array(turns, pa.string()), pa.array(loss, pa.string()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns", "loss", "size"])

    back = examples.mapInArrow(read, "conv_id long, n_turns long, turns string, loss string, size long")
    grouped = back.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.sha2(F.max_by("turns", "n_turns"), 256).alias("turns_sha256"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("n_turns", "loss"))), lambda x: x["loss"])).alias("loss"),
        F.sum("size").alias("formatted_chars"),
    )
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(prefix_targets(rows.unionByName(extra)))


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 END
      + length(regexp_replace(text, '([<\[])(\\*)((?:/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|END\]))', '\1\\\2\3', 'g')) AS size,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_role
  FROM c
), p AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (WHERE role = 'assistant' OR next_role IS NULL) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
