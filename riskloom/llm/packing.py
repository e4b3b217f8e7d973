"""Packing of token sequences by minimum bin slack."""

from __future__ import annotations

import os
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, small_batches, table, tidy

CAPACITY, END = 4096, 2
TOKENIZER = "word_bpe_49k.json"
#: Tails that wait for a partner before windows are filled, and distinct words remembered.
WAITING, CACHE = 512, 250_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Small Latin-1 letters with punctuation behind: two tokens' worth that never join.
_ended = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+)")


def _small(text: str) -> str:
    """``text`` in small letters, if that is sure to be what the tokenizer makes of it:
    Latin-1 only, and none of its special tokens."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes.

    The tokenizer drops white space, never joins across it, and ignores case, so
    words are encoded once and remembered: CACHE of the newest, and those before
    them for as long. A word with punctuation behind is put together from its parts,
    and remembered itself only if its letters were known before, that is, not rare."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark fills the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of ``missing``: from before, or from parts, or encoded."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older, parts, new, out = self.known, self.older, {}, set(), {}
        for word in missing:
            if (old := older.get(word)) is not None:
                known[word] = old
            elif match := _ended.fullmatch(word):
                parts[word] = match.groups()
                for x in match.groups():
                    if x not in known:
                        if (old := older.get(x)) is not None:
                            known[x] = old
                        else:
                            new.add(x)
            else:
                new.add(word)
        encoded = list(new)
        for word, found in zip(encoded, self.tokenizer.encode_batch_fast(encoded, add_special_tokens=False), strict=True):
            known[word] = array("I", found.ids).tobytes()
        for word, (letters, signs) in parts.items():
            (out if letters in new else known)[word] = known[letters] + known[signs]
        return out

    def ids(self, text: str | None) -> list[bytes]:
        """The ids of each word of ``text``."""
        words = _small(text or "").replace("\n", " ").split(" ")
        found = list(map(self.known.get, words))
        if None in found:
            once = self._learn({w for w, x in zip(words, found, strict=True) if x is None})
            known = self.known
            found = [(known.get(w) or once.get(w, b"")) if x is None else x for w, x in zip(words, found, strict=True)]
        return found


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a Python worker; what it remembers goes with each task."""
    return Encoder(path)


def fill(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """How many pieces of each length fill ``capacity`` best without passing it.

    Minimum bin slack as a bounded subset sum: bit t of ``reach`` says that some
    multiset adds up to t. Lengths enter in strides from long to short, until the
    window closes exactly; the snapshots before each length give the counts on the
    way back."""
    everything, reach, layers = (1 << (capacity + 1)) - 1, 1, []
    lengths = sorted((x for x in counts if 0 < x <= capacity), reverse=True)
    for length in (x for i in range(16) for x in lengths[i::16]):
        layers.append((length, reach))
        left, step = min(counts[length], capacity // length), 1
        while left:
            take = min(step, left)
            reach |= reach << (length * take) & everything
            left, step = left - take, 2 * step
        if reach >> capacity:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            used[length] = n
    return used


class Packer:
    """Fills sequences from a stream of documents; holds only waiting pieces.

    A piece is (document, first id, ids). Whole windows leave at once; the tails
    wait until WAITING of them are there, then windows are filled around the
    longest. What slack a window has left is filled by cutting a waiting piece."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.waiting, self.count = capacity, {}, 0
        self.n_waiting, self.ids_waiting = 0, 0

    def _put(self, piece: tuple) -> None:
        self.waiting.setdefault(len(piece[2]), deque()).append(piece)
        self.n_waiting, self.ids_waiting = self.n_waiting + 1, self.ids_waiting + len(piece[2])

    def _take(self, length: int) -> tuple:
        queue = self.waiting[length]
        piece = queue.popleft()
        if not queue:
            del self.waiting[length]
        self.n_waiting, self.ids_waiting = self.n_waiting - 1, self.ids_waiting - length
        return piece

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids in pieces:
            yield *doc, start, ids, self.count, offset
            offset += len(ids)
        self.count += 1

    def _window(self) -> list[tuple]:
        chosen = [self._take(max(self.waiting))]
        slack = self.capacity - len(chosen[0][2])
        for length, n in fill(slack, {k: len(v) for k, v in self.waiting.items()}).items():
            chosen += [self._take(length) for _ in range(n)]
            slack -= length * n
        if slack:  # every waiting piece is longer than the slack
            doc, start, ids = self._take(min(self.waiting))
            chosen.append((doc, start, ids[:slack]))
            self._put((doc, start + slack, ids[slack:]))
        return chosen

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            yield from self._emit([(doc, start, ids[start : start + self.capacity])])
        if whole < len(ids):
            self._put((doc, whole, ids[whole:]))
        while self.n_waiting >= WAITING and self.ids_waiting >= self.capacity:
            yield from self._emit(self._window())

    def end(self) -> Iterator[tuple]:
        """The last windows; what is short of one is cut into powers of two, which
        need no padding."""
        while self.ids_waiting >= self.capacity:
            yield from self._emit(self._window())
        size = 1 << self.ids_waiting.bit_length() >> 1
        chosen, room = [], size
        while self.n_waiting:
            doc, start, ids = self._take(max(self.waiting))
            while len(ids) >= room:
                chosen.append((doc, start, ids[:room]))
                yield from self._emit(chosen)
                start, ids = start + room, ids[room:]
                left = self.ids_waiting + len(ids)
                chosen, room = [], 1 << left.bit_length() >> 1
                if not left:
                    break
            if len(ids):
                chosen.append((doc, start, ids))
                room -= len(ids)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of the token ids of ``docs(doc_id, text)``, packed into sequences of at
    most ``capacity``: doc_id, start and length in the document, doc_tokens,
    sequence_id, offset there, and ``ids`` (little-endian unsigned 32-bit).

    Every document ends with id ``end``; a null text is empty, so it has that id
    alone. Each task packs what it reads, in order, without a shuffle: a sequence
    never crosses tasks, and a lost task is done again alike. A sequence holds
    ``capacity`` ids, or a power of two at a task's end, so none needs padding.
    Repeated rows and null doc_ids are packed like any other."""
    path = path or tokenizer_path()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(path), Packer(capacity)
        first, last = TaskContext.get().partitionId() << 32, end.to_bytes(4, "little")
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            doc, tokens, start, ids, sequence, offset = zip(*rows, strict=True)
            longs = [doc, start, [len(x) for x in ids], tokens, [first + s for s in sequence], offset]
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), pa.array([x.tobytes() for x in ids], pa.binary())], names)

        for batch in sliced(batches):
            out, held = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(b"".join([*encoder.ids(text.as_py()), last]), "<u4")
                for row in packer.add((doc_id, len(ids)), ids):
                    out.append(row)
                    held += len(row[3])
                if held > 1 << 20:
                    yield batch_of(out)
                    out, held = [], 0
            if out:
                yield batch_of(out)
        if out := list(packer.end()):
            yield batch_of(out)
        encoder.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
