"""The naive Bayes verdicts against a plain computation."""

import math
import re
from collections import Counter

import pytest

from riskloom.llm import urlfilter

PAGES = [
    ("http://cheappills.example.net/de/1", "cheap pills cheap pills win"), ("http://cheapfarm.example.net/de/2?x", "farm spam farm"),
    ("http://news.example.net/en/3", "news of the day"), ("http://dailynews.b.org/fr/4", "daily news daily"),
    ("http://cheapnews.c.com/es/5.html", "the example"), ("http://farmpills.c.com/es/6", None), ("http://daily.c.com/es/7", "<p>cheap</p><script>pills();</script>"),
    (None, "x"), ("http://cheappills.example.net/de/1", "cheap"),
]


def slow(pages, rules=urlfilter.RULES):
    words = Counter()
    for _, html in pages:
        text = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ", (html or "").lower())
        words.update(w for w in re.split("[^a-z]+", text) if 2 <= len(w) <= urlfilter.LONGEST)
    total = math.log(max(2, sum(words.values())))

    def split(name):
        edges = sorted((b, n, total - math.log(words[name[b : b + n]])) for b in range(len(name)) for n in range(2, urlfilter.LONGEST + 1) if b + n <= len(name) and name[b : b + n] in words)
        return urlfilter.viterbi(name, edges)

    rows = []
    for url, _ in pages:
        _, found, rest = (url or "").partition("://")
        host = re.split("[/?#]", rest)[0].lower() if found else ""
        path = re.split("[?#]", rest[len(host) :])[0] if found else ""
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        tokens = [w for name in re.findall("[a-z]+", re.sub(r"\.?[^.]*$", "", host)) for w in split(name)]
        tokens += [t for t in re.split(r"[^a-z0]+", re.sub("[0-9]+", "0", path.lower())) if t]
        rows.append((max(fits, key=len) if fits else None, tokens))
    counts = {v: Counter(t for r, ts in rows if r and rules[r] == v for t in ts) for v in ("block", "allow")}
    size = len(set(counts["block"]) | set(counts["allow"]))
    seen = Counter(rules[r] for r, _ in rows if r)
    odds = {t: math.log((counts["block"][t] + 1) / (counts["allow"][t] + 1)) for _, ts in rows for t in ts}
    base = math.log((sum(counts["allow"].values()) + size + 1) / (sum(counts["block"].values()) + size + 1))
    return [(r, math.log((seen["block"] + 1) / (seen["allow"] + 1)) + sum(odds[t] + base for t in ts)) for r, ts in rows]


def test_scores(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df).collect()}
    for i, (rule, score) in enumerate(slow(PAGES)):
        assert got[i]["rule"] == rule and got[i]["score"] == pytest.approx(score)
        assert got[i]["verdict"] == (urlfilter.RULES[rule] if rule else "block" if score > 0 else "allow")
