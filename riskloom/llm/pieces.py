"""SentencePiece encoding and decoding by vectorised merge rounds.

A byte-pair model merges, again and again, the neighbouring symbols whose joined piece has
the best score, the leftmost first. Here all new words of a batch are merged side by side,
in flat arrays of symbols: each round finds the best rank of each word, merges its pairs of
that rank at once, and drops the words in which no pair is left."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, blocks, runs, sliced, small_batches, table, tidy

MODEL = "piece_bpe_32k.model"
#: The mark that stands for a space in pieces.
SPACE = "▁"
#: Characters of words that a task remembers; then it forgets all and starts anew.
REMEMBERED = 4 << 20
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = np.int64(1) << 40
_words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

# what is no UTF-8 becomes a replacement character for each byte
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need of a model. Symbols are piece ids; then characters
    that stand inside pieces only; the last symbol is any other character."""

    surface: list[bytes]  # what each piece decodes to
    controls: frozenset[int]
    spaced: np.ndarray  # pieces that begin with a space
    byte_ids: np.ndarray  # the piece of each byte
    chars: np.ndarray  # code points in order, and the symbol of each (these and the keys below end with NEVER)
    char_symbols: np.ndarray
    inside: np.ndarray  # pairs of characters (as numbers in ``chars``) that stand in some piece
    pairs: np.ndarray  # left symbol * symbols + right symbol, in order
    merged: np.ndarray  # the piece that each pair makes, and its rank: 0 for the best score
    ranks: np.ndarray
    hasty: np.ndarray  # pieces that are part of one with the same or a better rank
    symbols: int
    prefixed: bool  # texts get a space before them


def vocabulary(model: bytes) -> Vocabulary:
    """Reads a model: byte-pair merges over unchanged text, with a piece for each byte and
    no piece that crosses from a word into a space. Any other kind raises ValueError."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    norm, spec = proto.normalizer_spec, proto.trainer_spec
    text, kind = [p.piece for p in proto.pieces], np.array([p.type for p in proto.pieces], np.int64)
    plain = np.flatnonzero(kind == NORMAL).tolist()
    if spec.model_type != spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not spec.byte_fallback:
        raise ValueError("not a byte-pair model with byte pieces over unchanged text")
    if spec.treat_whitespace_as_suffix or not np.isin(kind, (NORMAL, UNKNOWN, CONTROL, BYTE)).all() or any(SPACE in text[i].lstrip(SPACE) for i in plain):
        raise ValueError("pieces that are set by hand, unused, or hold a space behind a letter")
    symbol = {text[i]: i for i in plain}
    for char in sorted({c for i in plain for c in text[i]}):
        symbol.setdefault(char, len(text) + len(symbol) - len(plain))
    symbols = len(text) + len(symbol) - len(plain) + 1
    chars = np.array([*sorted(ord(c) for c in symbol if len(c) == 1), NEVER], np.int64)
    number = {chr(c): i for i, c in enumerate(chars[:-1].tolist())}
    scores = sorted({proto.pieces[i].score for i in plain}, reverse=True)
    rank = {s: i for i, s in enumerate(scores)}
    made = sorted(
        (symbol[text[i][:k]] * symbols + symbol[text[i][k:]], i, rank[proto.pieces[i].score])
        for i in plain for k in range(1, len(text[i])) if text[i][:k] in symbol and text[i][k:] in symbol
    )
    pairs, merged, ranks = np.array([*made, (NEVER, 0, NEVER)], np.int64).T.copy()
    own = np.full(symbols, -1)
    own[merged[:-1]] = ranks[:-1]
    hasty = np.zeros(symbols, bool)
    for part in (pairs[:-1] // symbols, pairs[:-1] % symbols):
        hasty[part[ranks[:-1] <= own[part]]] = True
    inside = {number[a] * len(chars) + number[b] for i in plain for a, b in zip(text[i], text[i][1:])}
    byte_ids = np.zeros(256, np.int64)
    surface = [x.replace(SPACE, " ").encode() for x in text]
    for i in np.flatnonzero(kind == BYTE).tolist():
        value = int(text[i][1:-1], 16)
        byte_ids[value], surface[i] = i, bytes([value])
    for i in np.flatnonzero(kind == UNKNOWN).tolist():
        surface[i] = spec.unk_surface.encode()
    spaced = np.array([x.startswith(SPACE) for x in text]) & (kind == NORMAL)
    return Vocabulary(surface, frozenset(np.flatnonzero(kind == CONTROL).tolist()), spaced, byte_ids, chars, np.array([*(symbol[chr(c)] for c in chars[:-1].tolist()), symbols - 1], np.int64), np.array([*sorted(inside), NEVER], np.int64), pairs, merged, ranks, hasty, symbols, norm.add_dummy_prefix)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in keys that end with NEVER, and whether it does."""
    at = np.searchsorted(sorted_keys, keys)
    return at, sorted_keys[at] == keys


def _rank(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    at, there = _find(v.pairs, left * v.symbols + right)
    return np.where(there, v.ranks[at], NEVER)


def merge_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``words`` in a row, and the word of each.

    A pair joins across no place where neighbouring characters stand together in no piece,
    so words are cut there first, and each part goes at its own pace. Merging all pairs of
    a part's best rank at once equals merging one after another as long as no merge makes
    a neighbour of the same or a better rank; where one does, the part's merges behind it
    wait for the next round. Rounds are as many as the part with most distinct merges has."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    number, known = _find(v.chars, points)
    symbol = np.where(known, v.char_symbols[number], v.symbols - 1)
    joined = np.zeros(len(points), bool)  # with the character before
    joined[1:] = (word[1:] == word[:-1]) & known[1:] & known[:-1] & _find(v.inside, number[:-1] * len(v.chars) + number[1:])[1]
    part, place = np.cumsum(~joined), np.arange(len(points))
    rank = np.full(len(points), NEVER)  # of each symbol with the one behind it
    rank[:-1][joined[1:]] = _rank(v, symbol[:-1][joined[1:]], symbol[1:][joined[1:]])
    done_symbols, done_places = [], []
    while len(symbol):
        begin, end = runs(part)
        best = np.minimum.reduceat(rank, begin)
        live = np.repeat(best < NEVER, end - begin)
        done_symbols.append(symbol[~live])
        done_places.append(place[~live])
        symbol, place, part, rank = symbol[live], place[live], part[live], rank[live]
        if not len(symbol):
            break
        best = np.repeat(best, end - begin)[live]
        at = np.flatnonzero(rank == best)
        # of pairs that overlap the leftmost, then every other one
        first = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (part[at[1:]] != part[at[:-1]])))
        head = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - head) % 2 == 0]
        piece = v.merged[_find(v.pairs, symbol[at] * v.symbols + symbol[at + 1])[0]]
        # the neighbours that a merge meets: to the left perhaps the one merged before it
        stop = np.zeros(len(at), bool)
        if len(some := np.flatnonzero(v.hasty[piece])):
            here, made = at[some], piece[some]
            left = (here > 0) & (part[here - 1] == part[here])
            before = np.where((some > 0) & (at[some - 1] == here - 2), piece[some - 1], symbol[here - 1])
            right = here + 2 < len(symbol)
            right[right] = part[here[right] + 2] == part[here[right]]
            stop[some[left]] = _rank(v, before[left], made[left]) <= best[here[left]]
            stop[some[right]] |= _rank(v, made[right], symbol[here[right] + 2]) <= best[here[right]]
        if stop.any():  # those behind the first stop of a part wait
            begin, end = runs(part[at])
            stops = np.cumsum(stop) - stop
            keep = stops == np.repeat(stops[begin], end - begin)
            at, piece = at[keep], piece[keep]
        symbol[at] = piece
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        at -= np.arange(len(at))  # as many symbols before each are gone
        symbol, place, part, rank = symbol[stay], place[stay], part[stay], rank[stay]
        near = np.zeros(len(symbol) + 1, bool)
        near[at] = near[at - 1] = True
        changed = np.flatnonzero(near[:-1])
        rank[changed] = NEVER
        changed = changed[changed + 1 < len(symbol)]
        changed = changed[part[changed] == part[changed + 1]]
        rank[changed] = _rank(v, symbol[changed], symbol[changed + 1])
    symbol, place = np.concatenate([np.zeros(0, np.int64), *done_symbols]), np.concatenate([np.zeros(0, np.int64), *done_places])
    order = np.argsort(place, kind="stable")
    symbol, place = symbol[order], place[order]
    odd = np.flatnonzero(symbol >= len(v.surface))
    if not len(odd):
        return symbol, word[place]
    spelt = [chr(c).encode("utf-8", "surrogatepass") for c in points[place[odd]].tolist()]  # characters without a piece: their bytes
    copies = np.ones(len(symbol), np.int64)
    copies[odd] = list(map(len, spelt))
    symbol, place = np.repeat(symbol, copies), np.repeat(place, copies)
    symbol[symbol >= len(v.surface)] = v.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
    return symbol, word[place]


class Encoder:
    """Ids of texts, as little-endian 32-bit bytes. Spaces part words, across which no
    piece reaches; words are merged once and remembered up to REMEMBERED characters."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.known, self.held = v, {}, 0

    def _words(self, text: bytes) -> list[str]:
        said = text.decode("utf-8", "each_byte")
        return _words.findall((SPACE if self.v.prefixed else "") + said.replace(" ", SPACE)) if said else []

    def ids(self, texts: list[bytes]) -> list[bytes]:
        words = [self._words(x) for x in texts]
        new = list({w for ws in words for w in ws if w not in self.known})
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
            new = list({w for ws in words for w in ws})
        if new:
            ids, word = merge_words(self.v, new)
            cut, raw = np.searchsorted(word, np.arange(len(new) + 1)) * 4, ids.astype("<u4").tobytes()
            self.known.update(zip(new, [raw[b:e] for b, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], strict=True))
            self.held += sum(map(len, new))
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]


def decoded(v: Vocabulary, ids: list[int]) -> str:
    """The text of ``ids``: the space that encoding put before it goes, control ids say
    nothing, bytes that are no UTF-8 become replacement characters."""
    parts = [ids]
    if not v.controls.isdisjoint(ids):  # bytes on two sides of one make no character
        cut = [-1, *(i for i, x in enumerate(ids) if x in v.controls), len(ids)]
        parts = [part for b, e in zip(cut, cut[1:]) if (part := ids[b + 1 : e])]
    text = [b"".join([v.surface[i] for i in part]) for part in parts]
    if v.prefixed and parts and parts[0] and v.spaced[parts[0][0]]:
        text[0] = text[0][1:]
    return "".join([x.decode("utf-8", "each_byte") for x in text])


def _encoded(v: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """doc_ids and the ids of their texts, about a block of text at once."""
    encoder = Encoder(v)
    for batch in sliced(batches):
        ids, texts = batch.column("doc_id"), as_bytes(batch.column("text"))
        for b, e in blocks(texts):
            yield ids.slice(b, e - b), encoder.ids(texts[b:e])


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, ids array<int>)``: the pieces of each whole text,
    exactly those of the sentencepiece library, without begin or end.

    A null or empty text has no ids. Null doc_ids and repeated rows are encoded like any
    other, extra columns are left out, no rows give none. Bytes that are no UTF-8 count as
    a replacement character each. Every row is encoded where it lies, without a shuffle;
    a task holds a block of texts and the words that it remembers."""
    send = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in _encoded(send.value, batches):
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4")))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: bytes) -> DataFrame:
    """``tokens(doc_id, ids)`` to ``(doc_id, text)``, as the sentencepiece library decodes
    them. Null ids stand for no ids; an id outside the model raises IndexError."""
    send = tokens.sparkSession.sparkContext.broadcast(vocabulary(model))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [decoded(send.value, ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: bytes) -> DataFrame:
    """What ``encode`` and then ``decode`` give for ``docs(doc_id, text)``, in one pass and as
    digests: doc_id, n_tokens, ids_sha256 (decimal, joined by commas), decoded_sha256."""
    send = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = send.value
        decimal = [str(i) for i in range(len(v.surface))]
        for doc_id, raw in _encoded(v, batches):
            columns = [[], [], []]
            for x in raw:
                ids = np.frombuffer(x, "<u4").tolist()
                columns[0].append(len(ids))
                columns[1].append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                columns[2].append(hashlib.sha256(decoded(v, ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    with open(model_path(), "rb") as file:
        model = file.read()
    return round_trips(table(spark, sf_dir, "documents"), model)
