"""Edge cases of the corpus operators: nulls, ties, repeated rows, long texts, clashing
columns; and whole results against plain computations."""

import hashlib
import math
import random

import numpy as np
import pytest

from riskloom.llm import chat, decontaminate, packing, simhash, substrings, topk, toxicity, urlfilter, warc

rng = random.Random(21)
WORDS = [a + b for a in ("ba", "ko", "ti", "ne", "sul", "mor") for b in ("ra", "lon", "ta", "vi", "dex")]
CLASH = "key long, word long, fp long, node long, mark long, held_out string, n long"


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text) with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, 0, 0, 0, 0, 0, "x", 0) for i, t in rows], f"doc_id long, text string, {CLASH}")


# --- decontamination


def slow_overlaps(texts, items):
    """For each text and item the most equal words of a tolerated stretch, over all
    alignments and stretches."""
    out = {}
    for t, text in texts:
        for i, item in items:
            if text is None or item is None or i is None:
                continue
            a, b = text.lower().split(), item.lower().split()
            most = 0
            for shift in range(-len(b), len(a)):
                equal = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
                for begin in range(len(equal)):
                    n = 0
                    for end in range(begin, len(equal)):
                        n += equal[end]
                        if n >= min(13, len(b)) and 5 * n >= 4 * (end + 1 - begin):
                            most = max(most, n)
            if most:
                out.setdefault((t, i), []).append(most)
    return out


def test_overlaps_equal_brute_force(spark):
    items = [(i, prose(rng.choice((3, 6, 14, 20, 40)))) for i in range(8)] + [(8, None), (9, ""), (None, prose(20)), (10, "ba ba ba ba ba ba ba ba ba ba ba ba ba ba ba")]
    items.append((11, items[3][1]))  # a repeated item
    texts = [(None, items[0][1]), (50, None), (51, ""), (52, "ba " * 40)]
    for k in range(40):
        words = rng.choice(items[:8])[1].split()
        for at in rng.sample(range(len(words)), int(len(words) * rng.choice((0, 0.1, 0.2, 0.3)))):
            words[at] = "zzz"
        texts.append((k, prose(rng.randrange(12)) + " " + " ".join(words[rng.randrange(3) :]) + " " + prose(rng.randrange(12))))
    texts.append(texts[-1])  # a repeated row
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    got = {}
    for r in decontaminate.contaminated(documents(spark, texts), bench).collect():
        got.setdefault((r["doc_id"], r["item_id"]), []).append(r["matched"])
    assert got == slow_overlaps(texts, items)
    left = decontaminate.without_leaks(documents(spark, texts), bench)
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == sorted(t or -1 for t, _ in texts if not any(k[0] == t for k in got)) and "held_out" in left.columns


def test_masks_ignore_words():
    assert all(len(m) < m[-1] + 1 for m in decontaminate.MASKS)


# --- toxicity


@pytest.fixture(scope="module")
def letters(spark):
    return toxicity.letter_model(documents(spark, [(1, prose(300) + " idiot stupid idiot stupid moron tidy idiom you are" * 3)]))


def test_spaces_are_in_the_lattice(letters):
    assert toxicity.restore("s t u p 1 d", letters) == "stupid" and "idiot" in toxicity.restore("y o u i d 1 o t", letters).replace(" ", "")
    assert toxicity.spelt_out("well i d i o t there") == ["i d i o t"] and toxicity.spelt_out("it is up to us") == []
    long = "stupid" * 40
    assert toxicity.restore(long.replace("i", "1"), letters).count("stupid") >= 38  # longer than any word: decoded whole


def test_scores_equal_a_plain_computation(spark):
    rows = [(i, ("you " + rng.choice(("1diot", "st-upid", "idiot")) + " " if i % 4 == 0 else "fine ") + prose(12)) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "you idiot"), (5, "idiot"), (5, "idiot"), (202, "i d i o t " + prose(5))]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(120)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)

    def plain(text):
        lower = (text or "").lower()
        words = [(toxicity.restore(w, model.lm) if toxicity.suspicious(w) else w) for w in map(toxicity.core, set(lower.split()))]
        words += [w for run in toxicity.spelt_out(lower) for w in toxicity.restore(run, model.lm).split()]
        weight = {w: max(model.weights.get(f, 0.0) for f in [w + "$"] + ["^" + w[:n] for n in (4, 5, 6) if len(w) > n]) for w in words}
        best = sorted((x for x in weight.values() if x), reverse=True)
        x = [best[0] if best else 0.0, math.fsum(sorted(best[:3])), math.log1p(len(words)), 1.0]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.coefficients, strict=True))))

    got = toxicity.score_toxicity(docs, labels)
    assert got.count() == len(rows) and got.columns == ["doc_id", "held_out", "score", "predicted"]
    scored = toxicity.score(docs.select("doc_id", "text"), model).collect()
    assert [r["toxicity"] for r in scored] == pytest.approx([plain(r["text"]) for r in scored], abs=1e-9)
    by_text = {r["text"]: r["toxicity"] for r in scored}
    assert by_text["idiot"] > 0.5 > by_text[""] and by_text[None] == by_text[""]


# --- chat


def test_long_and_repeated_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "FLUSH", 50)  # examples leave in many small batches
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} </s>" * (1 + t % 3)) for t in range(60)]
    rows += [(2, 0, "user", "same"), (2, 0, "user", "same"), (2, 1, "assistant", None), (2, 1, "assistant", None), (None, 0, "user", "a"), (None, None, None, "b"), (3, 0, "assistant", "x" * 200_000), (4, 0, "user", "never answered")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns long")
    got = {r["conv_id"]: r for r in chat.digests(chat.prefix_targets(frame)).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        said = [r[3] or "" for r in own if r[2] == "assistant"]
        assert got[conv]["n_turns"] == len(own) and got[conv]["loss_chars"] == sum(map(len, said))
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()


# --- URLs and revisits


def test_pages_with_long_hosts_and_clashing_columns(spark):
    url = "http://" + "cheappills" * 300 + ".example.net/de/" + "x" * 5000
    rows = [(1, url, "cheap pills", 0, 0), (1, url, "cheap pills", 0, 0), (2, None, None, 0, 0), (None, "nothing", "", 0, 0), (3, "HTTP://A.ORG/fr/1?q", None, 0, 0)]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host long, salt long")).collect()
    assert len(got) == len(rows)
    found = {r["page_id"]: r for r in got}
    assert found[1]["rule"] == "net/" and found[1]["path"].startswith("/de/x") and found[3]["rule"] == "org/fr/" and found[3]["host"] == "a.org"
    assert found[2]["host"] == "" and found[None]["path"] == "" and found[None]["verdict"] in ("allow", "block")


def test_revisits_with_ties_and_stray_times(spark):
    tag, none = {"etag": "a"}, {}
    rows = [(1, "response", "http://x.com/a", 5, tag, "d1"), (2, "response", "http://x.com/a", 5, {"etag": "b"}, "d2"), (3, "revisit", "http://www.x.com:80/a?utm_x=1", 6, {"etag": "W/b"}, None), (4, "revisit", "http://x.com/a", 5, tag, None)]
    rows += [rows[2], (5, "response", "http://y.com/", 9_000_000_000_000, none, "d5"), (6, "revisit", None, 7, tag, None), (7, "other", "http://x.com/a", 7, tag, None), (8, "revisit", "http://x.com/" + "p" * 20_000, 7, tag, None)]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], "record_id long, kind string, url string, ts long, headers map<string,string>, digest string, slice long, target long")
    got = sorted((r["record_id"], r["response_id"], r["outcome"], r["digest"]) for r in warc.resolve_revisits(frame).collect())
    assert got == [(3, 2, "resolved", "d2"), (3, 2, "resolved", "d2"), (4, None, "missing", None), (8, None, "missing", None)]


# --- duplicates, substrings, packing


def test_fingerprints_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d"), (1, "p q r s"), (None, "a b c d"), (7, "a b c d"), (8, None), (None, None)]
    got = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    assert len(got) == 6 and {c for i, f, c in got if f == "0" * 16} == {8} and [c for i, f, c in got if i == 7] == [1]


def test_long_repetitive_text(spark):
    base = prose(3000)
    rows = [(1, base), (2, "x" * 30_000), (3, prose(5) + base[500:9000]), (None, base), (None, None)]
    got = [r for r in substrings.remove_repeats(documents(spark, rows)).collect()]
    assert len(got) == 5 and sum(r["n_bytes"] for r in got if r["doc_id"] is None) == len(base)
    assert all(not r["removed"] for r in got if r["doc_id"] is None)
    kept = {r["doc_id"]: r["kept"] for r in got if r["doc_id"]}
    assert len(kept[2]) == 1 and len(kept[3]) < 100  # all strings of x but the first start earlier


def test_very_long_text_is_packed(spark):
    from tokenizers import Tokenizer

    rows = [(1, " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(30_000))), (1, "Twice."), (None, None), (2, "<|endoftext|> É, don't")]
    pieces = packing.pack(documents(spark, rows)).collect()
    ids, total = {}, 0
    for p in sorted(pieces, key=lambda p: p["start"]):
        ids.setdefault((p["doc_id"], p["doc_tokens"]), []).extend(np.frombuffer(p["ids"], "<u4").tolist())
        total += p["length"]
    encode = Tokenizer.from_file(packing.tokenizer_path()).encode
    for i, text in rows:
        want = [*encode(text or "", add_special_tokens=False).ids, packing.END]
        assert ids[i, len(want)] == want
    assert total == sum(map(len, ids.values()))


# --- top-k


def test_topk_query_in_many_partitions_and_of_mixed_lengths(spark, tmp_path):
    """Shuffled to partitions that stay apart; shorter vectors count as zeros behind their end."""
    gen = np.random.default_rng(31)
    vectors = {10 * i: np.floor(1024 * gen.normal(size=(3, 6, 0)[i % 7 % 3])) / 1024 for i in range(60)}
    spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "37"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, topk.op1_topk(spark, str(tmp_path)).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    score = lambda a, b: int(sum(1024 * x * 1024 * y for x, y in zip(a, b, strict=False)))
    want = []
    for q in (i for i in vectors if i % 100 == 0):
        best = sorted((-score(vectors[q], v), i) for i, v in vectors.items() if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
