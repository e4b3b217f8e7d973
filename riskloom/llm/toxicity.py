"""Toxicity: noisy-channel restoration of disguised words, then a word-evidence
classifier over the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, sliced, small_batches, table, tidy

#: What a sign may stand for when it is read as a letter.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l",
}
#: Letters of the language model: a-z, the Latin-1 small letters, one for all others, and the word's edge.
LETTERS = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100))]
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER, EDGE, SIZE = len(LETTERS) + 1, 0, len(LETTERS) + 2
#: Costs of the channel, in nats.
READ_LEET, DROP_SIGN, DROP_REPEAT, DROP_LEET, DROP_SPACE = 1.0, 0.5, 0.7, 3.0, 0.2
#: Bytes (about) of the tokens remembered, and of those before them.
CACHE_BYTES = 16 << 20
#: Restored words whose evidence is added up.
TOP_WORDS = 3
INPUTS = ("top", "total", "size")
#: Labelled rows that the classifier is fitted on (those least by a hash of their id;
#: all, if there are fewer).
TRAINING_ROWS = 20_000
#: Standard errors that a feature's weight is lowered by, and toxic texts it must stand in.
CAUTION, LEAST_TEXTS = 3.0, 3

_trim = re.compile(r"^[^\w@$!|+€£]+|(?:([^\w\s])\1{2,}|[^\w\s@$|+€£])+$|^(?:([^\w\s])\2{2,})+")
_tripled = re.compile(r"([^\W\d_])\1\1")
_spaced = re.compile(r"(?<!\S)\S{1,2}(?:[^\S\n]\S{1,2}){2,}(?!\S)")


def suspicious(token: str) -> bool:
    """Letters mixed with signs or digits, or a letter three times running."""
    return not token.isalpha() and any(map(str.isalpha, token)) or bool(_tripled.search(token))


def core(token: str) -> str:
    """``token`` without the punctuation around it."""
    return token if token.isalpha() else _trim.sub("", token)


def spelt_out(text: str) -> list[str]:
    """The parts of ``text`` that may be words spelt out with spaces: three tokens or
    more of one or two signs, at least half of them of one."""
    found = [run.split() for run in _spaced.findall(text)]
    return [" ".join(tokens) for tokens in found if 2 * sum(len(t) == 1 for t in tokens) >= len(tokens)]


def restore(token: str, lm: list) -> str:
    """The likeliest letters behind ``token``: Viterbi over the lattice of readings
    of each sign (itself, a letter it resembles, nothing), scored by ``lm``, which
    holds -log P(letter | the two before). A space is read as nothing or as the end of
    a word. Any length: time and memory are linear in it."""
    paths = {(EDGE, EDGE): (0.0, None)}
    for ch in token:
        if ch == " ":
            ahead = {key: (cost + DROP_SPACE, chain) for key, (cost, chain) in paths.items() if key != (EDGE, EDGE)}
            ahead[EDGE, EDGE] = min(((cost + (lm[a][b][EDGE] if b else 0.0), i, chain if not b else (" ", chain)) for i, ((a, b), (cost, chain)) in enumerate(paths.items())))[::2]
            paths = ahead
            continue
        code = CODE.get(ch, OTHER if ch.isalpha() else -1)
        options = [(code, ch, 0.0)] if code >= 0 else [(CODE[x], x, READ_LEET) for x in LEET.get(ch, "")]
        drop = None if code >= 0 else DROP_LEET if options else DROP_SIGN
        ahead: dict = {}
        for (a, b), (cost, chain) in paths.items():
            row = lm[a][b]
            steps = [((b, c), cost + extra + row[c], (x, chain)) for c, x, extra in options]
            if drop is not None:
                steps.append(((a, b), cost + drop, chain))
            elif chain and chain[0] == ch:
                steps.append(((a, b), cost + DROP_REPEAT, chain))
            for key, total, to in steps:
                if key not in ahead or total < ahead[key][0]:
                    ahead[key] = (total, to)
        paths = ahead
    chain = min(((cost + lm[a][b][EDGE], i, to) for i, ((a, b), (cost, to)) in enumerate(paths.items())))[2]
    letters = []
    while chain:
        letters.append(chain[0])
        chain = chain[1]
    return "".join(reversed(letters))


def letter_model(docs: DataFrame) -> list:
    """-log P(letter | two letters) from every plain word of every text, smoothed.

    Words are counted on Spark over the whole corpus; only the trigram table, whose
    size the fixed alphabet bounds, reaches the driver."""

    @tidy
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            count: Counter = Counter()
            for text in batch.column(0).to_pylist():
                count.update((text or "").lower().split())
            plain: Counter = Counter()
            for token, n in count.items():
                if (word := core(token)).isalpha():
                    plain[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(plain.keys(), pa.string()), pa.array(plain.values(), pa.int64())], ["word", "n"])

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = b = EDGE
                for c in [*(CODE.get(x, OTHER) for x in word), EDGE]:
                    counts[(a * SIZE + b) * SIZE + c] += n
                    a, b = b, c
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    counted = docs.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = counted.mapInArrow(trigrams, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3)
    for row in sums:
        counts[row["at"]] = row["n"]
    counts = counts.reshape(SIZE, SIZE, SIZE)
    back = counts.sum(0) + 0.1
    back /= back.sum(-1, keepdims=True)
    smooth = (counts + 2.0 * back) / (counts.sum(-1, keepdims=True) + 2.0)
    return (-np.log(smooth)).tolist()


def features(word: str) -> list[str]:
    """The word and its beginnings of 4 to 6 letters."""
    return [f"{word}$", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n)]


class Tokens:
    """What is known of each token of the texts, found once by ``about(word)`` from
    its restored word; keeps CACHE_BYTES of the newest, and those before them as long."""

    def __init__(self, lm: list, about) -> None:
        self.lm, self.about, self.known, self.older, self.held = lm, about, {}, {}, 0

    def _learn(self, token: str):
        if self.held > CACHE_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        self.held += 250 + len(token)
        found = self.older.get(token)
        if found is None:
            word = core(token)
            found = self.about(restore(word, self.lm) if suspicious(word) else word)
        self.known[token] = found
        return found

    def of(self, text: str | None) -> list:
        """One entry for each distinct token, and for each word that was spelt out with
        spaces between."""
        lower = (text or "").lower()
        tokens = list(set(lower.split()))
        found = list(map(self.known.get, tokens))
        if None in found:
            found = [self._learn(t) if x is None else x for t, x in zip(tokens, found, strict=True)]
        if sum(len(t) == 1 for t in tokens) > 1:
            found += [self.about(word) for run in spelt_out(lower) for word in restore(run, self.lm).split()]
        return found


def evidence_model(marked: DataFrame, lm: list) -> dict[str, float]:
    """Weights of the features that speak for toxicity, from ``marked(text, toxic)``.

    A weight is the log ratio of the shares of toxic and other texts that have the
    feature, less CAUTION standard errors; features of LEAST_TEXTS toxic texts or more,
    positive weights only. The bound on labelled rows bounds their number."""
    model = marked.sparkSession.sparkContext.broadcast(lm)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model.value, features)
        for batch in sliced(batches):
            sums: dict[str, list[int]] = {"": [0, 0]}
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                for f in {"", *(f for some in tokens.of(text.as_py()) for f in some)}:
                    sums.setdefault(f, [0, 0])[toxic] += 1
            n = np.array(list(sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])], ["f", "n0", "n1"])

    counted = marked.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = materialize(counted.where(f"n1 >= {LEAST_TEXTS} or f = ''"))
    total = counted.where("f = ''").first()
    if total is None or not total["n0"] or not total["n1"]:
        return {}
    weight = F.expr(
        f"ln((n1 + 0.5D) / {total['n1'] + 1.0}D) - ln((n0 + 0.5D) / {total['n0'] + 1.0}D) - {CAUTION}D * sqrt(1D / (n1 + 0.5D) + 1D / (n0 + 0.5D))"
    )
    best = counted.where("f not in ('', '$')").select("f", weight.alias("w")).where("w > 0")
    return {row["f"]: row["w"] for row in best.collect()}


class Scorer:
    """(top, total, size) of texts: the weight of the restored word that weighs most
    (by its heaviest feature), the sum over the TOP_WORDS heaviest, and the logarithm
    of one more than the distinct tokens."""

    def __init__(self, lm: list, weights: dict[str, float]) -> None:
        self.tokens = Tokens(lm, lambda word: (w, word) if (w := max(weights.get(f, 0.0) for f in features(word))) else ())

    def of(self, text: str | None) -> tuple[float, float, float]:
        found = self.tokens.of(text)
        best = sorted(w for w, _ in {x for x in found if x})
        return max(best, default=0.0), math.fsum(best[-TOP_WORDS:]), math.log1p(len(found))


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of INPUTS and the offset of a lightly penalised logistic fit."""
    x = np.column_stack([x, np.ones(len(x))])
    start = np.array([0.5, 0.2, 0.0, -3.0])
    penalty, at = np.array([0.1, 0.1, 0.1, 0.01]), start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * (at - start))
        at = at - np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return at


def held_out() -> F.Column:
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """A fitted classifier: fixed-size letter statistics, the weights of features of at
    most TRAINING_ROWS ids, and the coefficients of INPUTS with their offset."""

    lm: list
    weights: dict[str, float]
    coefficients: list[float]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labels of at most TRAINING_ROWS doc_ids of ``docs`` that are not
    held out. A doc_id labelled twice is toxic if any label says so; null labels are
    left out; the rows of a repeated doc_id count as one in the calibration. The letter statistics cover all of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sample = marks.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    # the labelled rows are read from the corpus once; every later step has these alone
    marked = materialize(docs.join(F.broadcast(sample), "doc_id"))
    lm = letter_model(docs)
    weights = evidence_model(marked, lm)
    model = docs.sparkSession.sparkContext.broadcast((lm, weights))

    @tidy
    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in sliced(batches):
            rows = [scorer.of(text.as_py()) for text in batch.column("text")]
            columns = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int64()), *columns], ["doc_id", "toxic", *INPUTS])

    # one row for each id, the mean of its rows: repeated rows weigh no more, and none is left out
    each = marked.mapInArrow(inputs, "doc_id long, toxic long, top double, total double, size double").groupBy("doc_id").agg(*(F.avg(c).alias(c) for c in INPUTS), F.max("toxic").alias("toxic")).collect()
    rows = np.array(sorted(tuple(row[1:]) for row in each), float).reshape(-1, len(INPUTS) + 1)
    return Model(lm, weights, calibrate(rows[:, :-1], rows[:, -1]).tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a last column: the toxicity of ``text``, 0 to 1, named
    ``toxicity`` (an existing one of that name is replaced)."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(known.value.lm, known.value.weights)
        *slopes, offset = known.value.coefficients
        for texts in batches:
            x = np.array([scorer.of(t) for t in texts], float).reshape(-1, len(INPUTS))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(slopes) + offset, -700, 700))))
        give_back()

    return docs.withColumn("toxicity", toxicity(F.col("text").cast("string")))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Scores see the text only. Null and empty texts have no evidence; without both
    kinds of labels no text has any. A null doc_id isn't held out; repeated rows are
    scored each."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
