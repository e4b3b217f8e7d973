"""SentencePiece rounds, the filter audit and the conversation trie."""

import collections
import hashlib
import itertools
import random
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from riskloom.llm import audit, pieces, trie
from riskloom.llm.common import table

SF = "/root/testdata/sf0.001"


# --- SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def model():
    with open(pieces.model_path(), "rb") as file:
        return file.read()


def odd_texts(library):
    rng = random.Random(5)
    out = [None, "", " ", "   ", "a" * 3000, "ab" * 700, "▁▁a ▁", "\n\n \t x", "<s></s><unk>", "<0x41>", "é" * 99, "日本語 テキスト漢字", "😀 👩‍👩‍👧", "\x00\x01", " " * 37, "=" * 333, "-" * 77 + " " * 13]
    out += ["".join(rng.choice("aabcdehinorst  .▁\n_-=é日😀") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    out += ["".join(rng.choice(" aA=-_/*\t\n") for _ in range(rng.randrange(1, 80))) for _ in range(200)]
    return out + ["".join(library.id_to_piece(rng.randrange(259, 32000)) for _ in range(20)).replace("▁", " ") for _ in range(200)]


def test_ids_and_texts_of_the_library(spark, library, model):
    texts = odd_texts(library)
    docs = spark.createDataFrame([(i if i % 50 else None, t, i, [i]) for i, t in enumerate(texts)], "doc_id long, text string, idx int, ids array<int>")
    encoded = pieces.encode(docs, model)
    assert encoded.columns == ["doc_id", "ids"]
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect())
    want = [(i if i % 50 else None, tuple(library.encode(t or ""))) for i, t in enumerate(texts)]
    assert got == collections.Counter(want)
    back = collections.Counter(map(tuple, pieces.decode(encoded, model).collect()))
    assert back == collections.Counter((i, library.decode(list(ids))) for i, ids in want)


def test_decoding_of_any_ids(spark, library, model):
    v, rng = pieces.vocabulary(model), random.Random(9)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, 3 + rng.randrange(256), 3 + rng.randrange(256), 259, 264, 28705, rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        assert pieces.decoded(v, ids) == library.decode(ids)
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, pieces.decode(none, model).collect())) == [(1, ""), (2, "")]
    assert pieces.encode(none.limit(0).select("doc_id", F.lit("").alias("text")), model).count() == 0


def test_bytes_that_are_no_text(spark, library, model):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(x'61ff6220e282' AS STRING) AS text")
    assert pieces.encode(docs, model).first()["ids"] == library.encode("a�b ��")


def test_forgetting_changes_nothing(library, model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    encoder, texts = pieces.Encoder(pieces.vocabulary(model)), [t or "" for t in odd_texts(library)][:300]
    for i in range(0, 300, 10):
        got = encoder.ids([t.encode() for t in texts[i : i + 10]])
        assert [list(memoryview(x).cast("I")) for x in got] == library.encode(texts[i : i + 10])


def test_other_models_are_refused(model):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.vocabulary(proto.SerializeToString())


def test_op11_over_the_table(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    got = pieces.op11_pieces(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


# --- filter audit


def brute_audit(docs, labels):
    """Every order over every document, as the contract says it."""
    good, toxic = ({i for i, q, t in labels if i is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = collections.defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = i is not None and i > least[text]
        rows[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, found in rows.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                now = [r for r in left if f not in r[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [f, len(now), len(gone), sum(f in r[0] for r in found) - len(gone), sum(r[0] == {f} for r in found), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                left = now
        for key in [k for k in out if k[0] == part]:
            out[key] = (*out[key][1:], total[out[key][0]])
    return out


def test_audit_equals_all_orders(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice(["a", "b#", "Cc", "dé", "e" * 9, f"w{k}"]) for k in range(n)) for n in (0, 1, 150, 199, 200, 201, 260)] + ["A B\tC\x0bD", " ", None, "", "x|" * 3, " ".join(map(str, range(250)))]
    docs = [(i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(1, 120)]
    docs += docs[:7] + [(None, pool[3], "en"), (None, pool[3], "fr"), (5, pool[1], "de"), (5, "other", None)]  # repeated rows, ids with two texts, rows without an id
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(1, 90)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (777, 1, 1)]
    frame = spark.createDataFrame([(*r, "p", 1) for r in docs], "doc_id long, text string, lang string, part string, n int").repartition(3)
    got = audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == brute_audit(docs, labels)
    assert len(got) == 600 * 4


def test_audit_of_nothing_and_of_long_texts(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    long = [(1, "Word " * 400_000, "en"), (2, "x" * 3_000_000, "en")]
    got = {(r["filter_order"], r["step"]): r["removed"] for r in audit.audit(spark.createDataFrame(long, docs.schema), labels).collect()}
    assert (got["ABCDE", 1], got["BACDE", 1], got["CABDE", 1], got["DABCE", 1]) == (1, 1, 1, 0)


def test_audit_is_native(spark):
    plan = audit.op12_audit(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


# --- conversation trie


def brute_trie(rows, rebuild=True):
    said = collections.defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        said[c].append((r or "", x or ""))
    paths = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        paths[c] = (*said.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h], *own[h:])
    members, children = collections.defaultdict(list), collections.Counter()
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    sha = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p)).encode()).hexdigest()
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p, m)) for p, m in members.items())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, idx int, depth int").repartition(3)


def nodes(frame):
    return collections.Counter(map(tuple, frame.collect()))


def test_trie_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(150, 170), 100, 399, -3, -100, -250]:
        for t in range(rng.randrange(1, 8)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["é", "hello", "", None, "a b"])))
    rows += [(10, t, "user", "long") for t in range(60)] + [(11, t, "user", "long") for t in range(60)]  # a deep path that two share in part
    rows += [(10, 3, "user", "long")] * 3 + [(None, 0, "user", "x")]
    turns = trie.turns_of(conversations(spark, rows))
    assert nodes(trie.trie(turns, trie.rebuilt_paths(turns))) == brute_trie(rows)
    monkeypatch.setattr(trie, "HOT", 2)  # most nodes are broadcast, chains are cut short
    monkeypatch.setattr(trie, "LINK", 3)
    assert nodes(trie.trie(turns, trie.rebuilt_paths(turns))) == brute_trie(rows)


def test_trie_of_equal_few_and_none(spark):
    copies = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(12)]
    turns = trie.turns_of(conversations(spark, copies))
    assert nodes(trie.trie(turns, trie.plain_paths(turns))) == brute_trie(copies, rebuild=False)
    one = [(507, 0, "user", "x")]
    turns = trie.turns_of(conversations(spark, one))
    assert nodes(trie.trie(turns, trie.rebuilt_paths(turns))) == brute_trie(one)
    none = trie.turns_of(conversations(spark, one).limit(0))
    assert trie.trie(none, trie.rebuilt_paths(none)).count() == 0


def test_op13_over_the_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(trie.op13_trie(spark, SF)) == brute_trie(rows)


def test_only_sets_of_pairs_are_shuffled_whole(spark, monkeypatch):
    """Each comparison sent all whole sets through shuffles, whatever pairs were left."""
    from riskloom.llm import setjoin

    kept, sieve = [], setjoin._sieved
    monkeypatch.setattr(setjoin, "_sieved", lambda *a: (kept.append(out := sieve(*a)), out)[1])
    sets = spark.range(3000).selectExpr("id as line_set", "5 as size", "cast(null as binary) as sketch", "sequence(id div 2 * 10, id div 2 * 10 + 4) as words")
    pairs = spark.createDataFrame([(7, 6), (8, 7), (2999, 2998)], "line_set long, partner long")
    assert {tuple(r) for r in setjoin.alike(pairs, sets).collect()} == {(7, 6), (2999, 2998)}
    ids = {r["line_set"] for r in kept[0].collect()}
    assert {6, 7, 8, 2998, 2999} <= ids and len(ids) < 100


def test_sets_at_the_bound_of_counts(spark):
    """Sets of 120 and 140 words were held against each other by one half of their words only."""
    import random

    from riskloom.llm import linededup, setjoin

    draw = random.Random(5)
    pool = [f"w{k}" for k in range(400)]
    texts = [" ".join([f"shared{i // 2}", *draw.sample(pool, 119 + 20 * (i % 2))]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = setjoin.indexed(docs, linededup.LINES)
    assert setjoin.named(setjoin.met(index, 4)).count() == 0
    assert index.columns[0] == "bucket"
