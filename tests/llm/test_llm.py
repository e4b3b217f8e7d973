"""Each corpus operator against brute force, and its edge cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash

from riskloom.llm import chat, decontaminate, linededup, packing, setjoin, simhash, substrings, topk, toxicity, urlfilter, warc
from riskloom.llm.components import components

rng = random.Random(7)
WORDS = [a + b for a in ("ba", "ko", "ti", "ne", "sul", "mor") for b in ("ra", "lon", "ta", "vi", "dex")]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, first=1, extra=""):
    """Texts as documents, with columns whose names operators use themselves."""
    rows = [(i, t, "en", f"s{i}", 0, i) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long")


CORPUS = [prose(60) for _ in range(12)]
CORPUS += [CORPUS[0], CORPUS[0] + " ending", CORPUS[1].replace("ba", "ko", 1), None, "", "  \n ", "ba", "ba ra", CORPUS[2] + "\n" + CORPUS[3], "a" * 500, "a" * 700, "é\x01" * 80]


# --- top-k


def test_topk_equals_brute_force(spark):
    gen = np.random.default_rng(3)
    base = gen.normal(size=(40, 6))
    vectors = {i: base[i % 25] for i in range(0, 400, 5)}  # copies and ties
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()] + [(1001, None), (1002, [float("nan")] * 6), (1003, [None] * 6), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    quantized = topk.quantized(df)
    got = sorted(map(tuple, topk.top_k(quantized, quantized.where("vec_id % 100 = 0"), 10, topk.SCALE).collect()))
    ints = {i: np.floor(1024 * np.float32(v).astype(float)).astype(int) for i, v in vectors.items()}
    want = []
    for q in (i for i in ints if i % 100 == 0):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:10]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert got == sorted(want)


def test_topk_of_any_numbers(spark):
    """Repeated ids, also of queries, vectors of other lengths, and components past every long."""
    rows = [(100, [1.0, 2.0])] * 12 + [(101, [1.0, 2.0]), (102, [1.0, 2.0]), (5, [0.5, 0.5]), (6, [1.0, 2.0, 3.0]), (7, []), (8, None), (9, [-0.0, 0.0]), (200, [1e13, 1.0]), (201, [1e13, -1e300]), (300, [3.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    quantized = topk.quantized(df)
    got = {}
    for q, _, v, score in sorted(map(tuple, topk.top_k(quantized, quantized.where("vec_id % 100 = 0").dropDuplicates(["vec_id"]), 10, topk.SCALE).collect())):
        got.setdefault(q, []).append((v, score))
    ints = [(i, [int(x * 1024 // 1) if abs(x) < 1e15 else int(x * 1024) for x in v]) for i, v in rows if v is not None]
    for q in (100, 200, 300):
        own = next(v for i, v in ints if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in ints if i != q and len(v) == len(own))[:10]
        assert got[q] == [(i, max(-(2**63 - 1), min(2**63 - 1, -s))) for s, i in scores]


def test_topk_of_huge_components(spark):
    """Components whose scaled value no double holds, and scores of hundreds of digits."""
    rows = [(100, [1e306, 1e20]), (200, [1.0, -1e20]), (1, [1e306, 3e20]), (2, [-1e306, 1e20]), (3, [1e306, 1e20]), (4, [5e-324, 3e20]), (5, [0.5, 1e20]), (6, [1e20, -1e300])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    quantized = topk.quantized(df)
    got = {}
    for q, _, v, score in sorted(map(tuple, topk.top_k(quantized, quantized.where("vec_id % 100 = 0"), 10, topk.SCALE).collect())):
        got.setdefault(q, []).append((v, score))
    from fractions import Fraction

    ints = {i: [int(Fraction(x) * 1024 // 1) for x in v] for i, v in rows}
    for q in (100, 200):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)
        assert got[q] == [(i, max(-(2**63 - 1), min(2**63 - 1, -s))) for s, i in scores]


def test_topk_keys_sort_as_numbers():
    numbers = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 10**600, -(10**600), 10**600 + 1]
    assert sorted(numbers) == sorted(numbers, key=topk.sort_key) and [topk.from_key(topk.sort_key(x)) for x in numbers] == numbers


def test_topk_resolves_few_pairs():
    """The cutoff leaves less than a tenth of random pairs to resolve, and none of the best out."""
    gen = np.random.default_rng(4)
    a, b = np.floor(1024 * gen.normal(size=(40, 64))) / 1024, np.floor(1024 * gen.normal(size=(20_000, 64))) / 1024
    parts = topk._parts(a, b, topk.SCALE)
    whole = np.sort(sum(parts), axis=1)
    q, at = topk.survivors(parts, whole[:, -10:-9])
    assert len(q) < a.shape[0] * b.shape[0] / 10
    best = {(i, j) for i in range(len(a)) for j in np.argsort(-sum(parts)[i])[:10]}
    assert best <= set(zip(q.tolist(), at.tolist(), strict=True))


def test_topk_few_and_none(spark):
    two = spark.createDataFrame([(0, [1, 2]), (7, [3, 4])], "vec_id long, v array<long>")
    assert [tuple(r) for r in topk.top_k(two, two.where("vec_id = 0"), 10).collect()] == [(0, 1, 7, 11)]
    assert topk.top_k(two.limit(0), two.limit(0), 10).count() == 0


# --- WARC


def test_revisits(spark):
    full = {"etag": '"a"', "last-modified": "mon", "server": "x", "content-type": "t"}
    rows = [
        (1, "response", "http://www.H.com/a/?b=1&utm_x=2&a=3#f", 10, full, "d1"),
        (2, "response", "https://h.com/a?a=3&b=1", 20, full | {"etag": '"b"'}, "d2"),
        (3, "revisit", "http://h.com:80/a?b=1&a=3", 20, {"etag": 'W/"a"', "date": "now", "server": "y"}, None),
        (4, "revisit", "http://h.com/a?b=1&a=3", 21, {"etag": '"a"'}, None),
        (5, "revisit", "http://h.com/a?b=1&a=3", 5, {"etag": '"a"'}, None),
        (6, "revisit", "http://h.com/a?b=1&a=3", 900, {"last-modified": "mon"}, None),
        (7, "revisit", "http://h.com/a?b=1&a=3", 900, {}, None),
        (8, "revisit", None, 900, {}, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, headers map<string,string>, digest string")
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r["response_id"], r["outcome"], r["digest"]) for k, r in got.items()} == {
        3: (1, "resolved", "d1"), 4: (2, "mismatch", None), 5: (None, "missing", None), 6: (2, "resolved", "d2"), 7: (2, "unvalidated", None),
    }
    assert got[3]["headers"] == full | {"etag": 'W/"a"', "date": "now"} and got[3]["target"] == "h.com/a?a=3&b=1"


def test_no_records(spark):
    df = spark.createDataFrame([], "record_id long, kind string, url string, ts long, headers map<string,string>, digest string")
    assert warc.resolve_revisits(df).count() == 0


# --- URL filters


def test_rules_hosts_and_paths(spark):
    urls = ["https://A.Example.NET/en/x?y", "http://example.net/de/", "http://example.com/de/1", "http://b.org/fr/2#z", "http://b.org/de/", "http://net", "http://xnet/", None, "no scheme", "x://h?q#://other/", "http://notexample.com/de/"]
    pages = spark.createDataFrame([(i, u, "<p>cheap pills farm spam</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(pages).collect()}
    assert [got[i]["rule"] for i in range(11)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None, None]
    assert (got[0]["host"], got[0]["path"], got[9]["host"], got[9]["path"], got[7]["host"], got[8]["host"]) == ("a.example.net", "/en/x", "h", "", "", "")
    assert {got[i]["verdict"] for i in (0, 3)} == {"allow"} and {got[i]["verdict"] for i in (1, 2)} == {"block"}
    assert all(r["verdict"] in ("allow", "block") for r in got.values())


def test_segmentation_is_the_cheapest():
    cost = {"cheap": 2.0, "pills": 2.0, "che": 5.0, "ap": 3.0, "pill": 3.0}
    name = "cheappillsx"
    edges = [(b, n, cost[name[b : b + n]]) for b in range(len(name)) for n in range(2, 6) if name[b : b + n] in cost]
    assert urlfilter.viterbi(name, edges) == ["cheap", "pills", "x"]
    best = min(sum(cost.get(w, urlfilter.UNKNOWN if len(w) == 1 else 99) for w in split) for k in range(len(name)) for cuts in itertools.combinations(range(1, len(name)), k) if k < 5 for split in [[name[a:b] for a, b in zip((0, *cuts), (*cuts, len(name)), strict=True)]])
    assert best == 2 + 2 + urlfilter.UNKNOWN


def test_no_pages(spark):
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- chat


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "[\\INST]", "<\\\\/s>", "<<SYS>>x<</SYS>>", "<", "[/INST", "[ROLE]a[/ROLE]b[END]", "", "a\nb\\", "<<</s>"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and not chat._control.search(chat.escape(text))
    for role in ("user", "assistant", "system", "tool<s>", ""):
        both = chat.render(role, text)[0] + chat.render("user", text)[0]
        assert chat.read_back(both) == [(role, text), ("user", text)]


def test_examples_of_a_conversation(spark):
    rows = [(1, 2, "user", "q2"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 3, "assistant", None), (1, 4, "user", "end"), (2, 0, None, "x"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r["conv_id"], r["n_turns"], r["target"], r["formatted"][r["loss_begin"] : r["loss_end"]]) for r in chat.prefix_targets(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, True, "a"), (1, 4, True, ""), (1, 5, False, ""), (2, 1, False, ""), (None, 1, True, "z")], key=str)
    one = next(r for r in chat.digests(chat.prefix_targets(df)).collect() if r["conv_id"] == 1)
    turns = "user\nq\nassistant\na\nuser\nq2\nassistant\n\nuser\nend\n"
    assert one["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and (one["n_turns"], one["loss_chars"]) == (5, 1)
    assert chat.digests(chat.prefix_targets(df.limit(0))).count() == 0


# --- SimHash


def slow_fingerprint(text, width=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [x or "" for x in CORPUS] + [prose(700), "A b\x0bc\u00a0d"]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_links_equal_brute_force(spark):
    gen = random.Random(1)
    fps = {gen.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:30]:  # chains and stars of near neighbours
        for _ in range(6):
            f ^= sum(1 << b for b in gen.sample(range(64), gen.randint(1, 4)))
            fps.add(f)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for distance in (1, 3, 7):
        edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance)
        got = {(r["a"], r["b"]) for r in edges.collect()}
        near = {(min(a, b), max(a, b)) for (x, a), (y, b) in itertools.combinations(zip(fps, signed, strict=True), 2) if (x ^ y).bit_count() <= distance}
        assert got <= near and groups(signed, got) == groups(signed, near)


def groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(spark, CORPUS)).collect()}
    fps = {i: slow_fingerprint(t or "") for i, t in enumerate(CORPUS, 1)}
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert got == groups(list(fps), near)
    assert simhash.near_duplicates(documents(spark, CORPUS).limit(0)).count() == 0


def shingles(text, width=5):
    words = (text or "").lower().encode().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def test_verified_duplicates(spark):
    base = prose(400)
    near = base.split()
    near[50] = near[200] = "other"
    texts = [base, " ".join(near), prose(400), base, None, "", "one two"]
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_duplicates(documents(spark, texts)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5, 7: 7}


@pytest.mark.parametrize("partners", [1, 4])
def test_verified_duplicates_lose_no_link(spark, partners):
    """Against all pairs, with similarities all around the least one, hubs that fail, and few partners named at first."""
    texts = []
    for size in (12, 40, 60, 150, 300):
        base = prose(size).split()
        for changes in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            words = list(base)
            for _ in range(changes):
                words[rng.randrange(size)] = rng.choice(("other", "words", "here"))
            texts.append(" ".join(words).title() if changes == 1 else " ".join(words))
    texts += ["", None, "a b", "A  b", "a b c"]
    sets = [shingles(t) for t in texts]
    near = [(i + 1, j + 1) for i, j in itertools.combinations(range(len(texts)), 2) if not sets[i] and not sets[j] or (sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_duplicates(documents(spark, texts), partners=partners).collect()}
    assert got == groups(range(1, len(texts) + 1), near)


def test_verified_duplicates_of_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (3, "A b c d e f"), (None, "a b c d e f"), (4, "alone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in simhash.verified_duplicates(frame).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert simhash.verified_duplicates(frame.limit(0)).count() == 0


# --- substrings


def slow_repeats(docs, length=substrings.LENGTH):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            piece = data[p : p + length]
            if piece in seen:
                gone[p : p + length] = [True] * length
            seen.add(piece)
        out[i] = bytes(b for b, g in zip(data, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("shard", [1 << 21, 600])
def test_repeats_equal_brute_force(spark, shard, monkeypatch):
    passage, other = prose(40), prose(30)
    texts = CORPUS + [prose(20) + passage + prose(9), other + passage, passage + other + passage, prose(5) + passage[:150] + prose(7) + passage[90:], "abcd" * 100, "abcd" * 60 + prose(30)]
    texts += [f"{prose(6)} {passage[:130]} {prose(6)}" for _ in range(12)]
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
    compare = substrings._compare
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = {r["doc_id"]: bytes(r["kept"]) for r in substrings.remove_repeats(documents(spark, texts)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert compare is substrings._compare and got == slow_repeats(dict(enumerate(texts, 1)))


def test_split_groups_match_whole_ones():
    """Shards of one anchor group, looked up in each other, mark what one shard does."""
    import pyarrow as pa

    pieces = [(5, d, 0, (prose(8) + " " + CORPUS[0][: 100 + d] + " tail").encode()[:168]) for d in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pieces, strict=True)], ["key", "doc_id", "begin", "piece"])

    def marked(size):
        before, substrings.SHARD_BYTES = substrings.SHARD_BYTES, size
        try:
            found = pa.Table.from_batches(list(substrings._compare(iter([batch])))).to_pydict()
        finally:
            substrings.SHARD_BYTES = before
        return {(d, p) for d, b, e in zip(*(found[c] for c in ("doc_id", "begin", "end")), strict=True) for p in range(b, e)}

    assert marked(400) == marked(1 << 21)


def test_suffix_array_and_common_prefixes():
    for text in (b"banana\0bandana", b"aaaa\0aaaaaaaa", bytes(rng.choice(b"ab") for _ in range(300))):
        codes = np.where(np.frombuffer(text, np.uint8) == 0, 0, np.frombuffer(text, np.uint8).astype(np.int16) + 1)
        order = substrings.suffix_array(codes)
        assert order.tolist() == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
        shared = substrings.common_prefixes(codes, order, np.array([0]), np.array([len(codes)]), 10**6)
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :], text[order[k] :]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_repeats_edge_cases(spark):
    df = documents(spark, ["x" * 300, None, ""]).union(spark.createDataFrame([(None, "x" * 300, "", "", 0, 0)], "a long, b string, c string, d string, e long, f long"))
    got = {r["doc_id"]: (r["n_bytes"], len(r["kept"])) for r in substrings.remove_repeats(df).collect()}
    assert got == {1: (300, 0 + 300 - 299), 2: (0, 0), 3: (0, 0), None: (300, 300)}
    assert substrings.remove_repeats(df.limit(0)).count() == 0


# --- packing


def test_fill_is_best():
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        capacity = rng.randint(1, 60)
        used = packing.fill(capacity, counts)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= capacity)
        assert all(n <= counts[k] for k, n in used.items())


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = [prose(rng.randint(1, 900)) for _ in range(40)] + [None, "", "Don't stop... <|endoftext|>, é. É e\u0301. x$$$ A.B,", prose(3000).title()]
    rows = packing.pack(documents(spark, texts).coalesce(1), capacity=256).collect()
    for i, text in enumerate(texts, 1):
        pieces = sorted((r["start"], bytes(r["ids"]), r["length"]) for r in rows if r["doc_id"] == i)
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4").tobytes()
        assert b"".join(p[1] for p in pieces) == ids and all(4 * p[2] == len(p[1]) for p in pieces)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(documents(spark, texts).limit(0)).count() == 0


# --- lines


def test_lines_equal_brute_force(spark):
    lines = [prose(rng.randint(1, 14)) for _ in range(60)]
    texts = []
    for _ in range(40):
        own = []
        for line in rng.sample(lines, 5):
            words = line.split()
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            own.append(" ".join(words).title() if rng.random() < 0.2 else " ".join(words))
        texts.append("\n".join([*own, "", rng.choice(lines)]))
    texts += [None, "", "\n\n", lines[0]]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(documents(spark, texts), ["source", "fp"]).collect()}
    seen = []
    for i, text in enumerate(texts, 1):
        left = []
        for line in [] if text is None else text.split("\n"):
            words = set(line.encode().lower().split())
            if not words or not any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                left.append(line)
            if words:
                seen.append(words)
        assert got[i]["text"] == (None if text is None else "\n".join(left)) and got[i]["carried"]["source"] == f"s{i}"


def test_lines_that_look_further(spark, monkeypatch):
    """More partners than are named at first, the nearest of them not alike."""
    monkeypatch.setattr(setjoin, "_closest", lambda y, x, far, keep, f=setjoin._closest: f(y, x, -far if keep == 1 else far, keep))
    base = prose(20)
    texts = [base + " " + " ".join(f"z{i}{k}" for k in range(5)) for i in range(6)] + [base + " z00 z01 z02 z03 q"]
    kept = {tuple(r) for r in linededup.kept_lines(documents(spark, texts).select("doc_id", "text"), 1).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(i + 1, 0) for i, s in enumerate(sets) if not any(5 * len(s & e) >= 4 * len(s | e) for e in sets[:i])}
    assert kept == want


@pytest.mark.parametrize("together", [1, 7])
def test_word_of_all_lines(spark, monkeypatch, together):
    """Every line stands under one frequent word, whose index rows are dealt to block pairs."""
    monkeypatch.setattr(setjoin, "TOGETHER", together)
    monkeypatch.setattr(setjoin, "GUESS_FROM", 1)
    texts = [f"always the same six words here {rng.randrange(40)}" + (f" x{i}" if i % 3 else "") for i in range(80)]
    kept = {tuple(r) for r in linededup.kept_lines(documents(spark, texts).select("doc_id", "text")).collect()}
    sets = [set(t.split()) for t in texts]
    assert kept == {(i + 1, 0) for i, s in enumerate(sets) if not any(5 * len(s & e) >= 4 * len(s | e) for e in sets[:i])}


def test_no_lines(spark):
    assert linededup.dedup_lines(documents(spark, CORPUS).limit(0)).count() == 0


# --- toxicity


@pytest.fixture(scope="module")
def letters(spark):
    return toxicity.letter_model(documents(spark, [prose(300) + " idiot stupid idiot stupid moron tidy idiom"]))


def test_restores_disguises(letters):
    for disguised, plain in {"1d10t": "idiot", "stu.p.id": "stupid", "s-t-u-p-i-d": "stupid", "idiiiiot": "idiot", "m0r0n": "moron"}.items():
        assert toxicity.suspicious(disguised) and toxicity.restore(disguised, letters) == plain
    assert not toxicity.suspicious("idiot") and toxicity.core("lonra***") == "lonra" and toxicity.core("ok,") == "ok"


def test_restore_is_the_cheapest(letters):
    import math

    def cost(word):
        codes = [0, 0, *(toxicity.CODE[c] for c in word), 0]
        return sum(letters[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    best = math.inf, ""
    for reading in itertools.product("1il", "0o"):
        extra, word = 0.0, ""
        for sign, letter in zip("10", reading, strict=True):
            extra += toxicity.DROP_LEET if letter == sign else toxicity.READ_LEET
            word += "" if letter == sign else letter
        best = min(best, (extra + cost("t" + word + "n"), "t" + word + "n"))
    assert toxicity.restore("t10n", letters) == best[1]


def test_held_out_accuracy(spark):
    texts, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(rng.randint(20, 80)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["stupid", "1d10t", "idiot", "st.upid"]))
        texts.append(" ".join(words))
        marks.append((i + 1, int(toxic)))
    texts += [None, ""]
    labels = spark.createDataFrame([*marks, (1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(documents(spark, texts), labels).collect()
    truth = dict(marks)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 402 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["held_out"]} == {i for i in range(1, 403) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out)


def test_repeated_rows_do_not_crowd_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAINING_ROWS", 100)
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5][:100]
    texts = {i: prose(30) + (" stupid idiot" if n % 4 == 0 else "") for n, i in enumerate(ids)}
    rows = [*texts.items(), *[(ids[1], texts[ids[1]])] * 400]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n % 4 == 0)) for n, i in enumerate(ids)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got == {i: int(n % 4 == 0) for n, i in enumerate(ids)}


def test_no_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_toxicity(documents(spark, CORPUS[:3]), labels).collect()} == {0}
    assert toxicity.score_toxicity(documents(spark, CORPUS).limit(0), labels).count() == 0


# --- decontamination


def test_seeds_find_every_tolerated_overlap():
    """13 equal words with up to a fifth replaced, wherever, hold a seed."""
    for matched, missed in ((13, 3), (16, 4), (20, 5)):
        n = matched + missed
        for gaps in itertools.combinations(range(1, n - 1), missed):
            bits = (1 << n) - 1 - sum(1 << g for g in gaps)
            assert any(np.bitwise_and.reduce([bits >> o for o in mask]) for mask in decontaminate.MASKS)


def test_overlaps(spark):
    items = [prose(25), prose(14), "only three words", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    swapped = items[0].upper().split()
    for i in (3, 9, 15, 20):
        swapped[i] = "zzz"
    broken = items[0].split()
    broken[::3] = ["zzz"] * len(broken[::3])
    texts = [prose(50) + " " + " ".join(swapped) + ". " + prose(9), " ".join(broken), "so, only THREE words!", None, "", items[1] + " " + items[0], prose(80)]
    got = {(r["doc_id"], r["item_id"]): (r["doc_word"], r["words"], r["matched"]) for r in decontaminate.contaminated(documents(spark, texts), bench).collect()}
    assert set(got) == {(1, 0), (3, 2), (6, 0), (6, 1)} and got[1, 0] == (50, 25, 21) and got[3, 2] == (1, 3, 3)
    left = [r["doc_id"] for r in decontaminate.without_leaks(documents(spark, texts), bench).collect()]
    assert left == [2, 4, 5, 7]
    assert decontaminate.contaminated(documents(spark, texts), bench.limit(0)).count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    items = [prose(20) for _ in range(5)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(documents(spark, items), bench).collect()}
    assert got >= {(i + 1, i) for i in range(5)}


def test_stretches_equal_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(400):
        equal = rng.random(rng.integers(1, 60)) < rng.choice([0.6, 0.75, 0.85])
        every = [(int(equal[b:e].sum()), b - e, -b) for b in range(len(equal)) for e in range(b + 1, len(equal) + 1) if 5 * equal[b:e].sum() >= 4 * (e - b)]
        most, length, begin = max((x for x in every if x[0] >= 5), default=(0, 0, 0))
        assert decontaminate.best_stretch(equal, 5) == (-begin, -length, most)


def test_overlaps_beside_worse_words(spark):
    item = prose(51).split()
    doc = ["zzz" if i in range(13, 19) or i in range(32, 38) else word for i, word in enumerate(item)]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    rows = decontaminate.contaminated(documents(spark, [" ".join(doc)]), bench).collect()
    assert [(r["doc_word"], r["words"], r["matched"]) for r in rows] == [(0, 32, 26)]
    assert decontaminate.without_leaks(documents(spark, [" ".join(doc)]), bench).count() == 0


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= before and (name != "line_dedup" or now == before)
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == before
