"""URL filters: rules by host and path, and for the rest a naive Bayes verdict over
words that Viterbi segmentation finds in host names."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: The rules of the query, a verdict for each host with path.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Letters that a word of the lexicon has at most.
LONGEST = 20
#: Nats that each letter costs which no word of the lexicon explains.
UNKNOWN = 8.0


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z made small."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: dict[str, str]) -> Column:
    """The longest rule whose host is the row's or a parent of it and whose path the
    row's starts with; null if none fits. Of equally long ones the first by name."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        host, slash, path = rule.partition("/")
        fits = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        out = F.when(fits & F.startswith(F.col("path"), F.lit(slash + path)), F.lit(rule)).otherwise(out)
    return out


def lexicon(pages: DataFrame) -> DataFrame:
    """``(word, n)``: how often each word of a-z occurs in the visible text of all pages."""
    text = F.regexp_replace(F.lower("html"), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    words = pages.where("html is not null").select(F.explode(F.split(text, "[^a-z]+")).alias("word"))
    return words.where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, edges: list[tuple[int, int, float]]) -> list[str]:
    """The cheapest split of ``name`` into words (begin, length, cost) and letters that
    none explains; of equal ones that with the longest last word."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for begin, length, cost in edges:
        ends.setdefault(begin + length, []).append((begin, cost))
    best = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = [(best[b][0] + cost, b) for b, cost in ends.get(end, ())]
        best.append(min([*options, (best[end - 1][0] + UNKNOWN, end - 1)]))
    words, end = [], len(name)
    while end:
        begin = best[end][1]
        words.append(name[begin:end])
        end = begin
    return words[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """``names(name)`` to ``(name, words)``. Substrings meet the lexicon in a join, so
    neither is ever held whole; a name has at most LONGEST of them a letter."""
    total = math.log(max(2, words.agg(F.sum("n")).first()[0] or 0))
    at = names.distinct().select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    longest = F.least(F.lit(LONGEST), F.length("name") - F.col("at") + 1)
    parts = at.where(longest >= 2).select("name", "at", F.explode(F.sequence(F.lit(2), longest)).alias("length"))
    parts = parts.withColumn("word", F.expr("substring(name, at, length)"))
    edges = parts.join(words, "word").groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct((F.col("at") - 1).alias("begin"), "length", (F.lit(total) - F.log("n")).alias("cost")))).alias("edges")
    )

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([viterbi(x, [(r["begin"], r["length"], r["cost"]) for r in (e if e is not None else ())]) for x, e in zip(name, edges, strict=True)])

    return names.distinct().join(edges, "name", "left").select("name", split("name", "edges").alias("words"))


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``pages(page_id, url, html)`` judged: page_id, host, path, rule, verdict, score
    and host_words.

    A rule's verdict stands. Other rows get that of a multinomial naive Bayes model
    with add-one smoothing, learned from all rows that a rule judges: block if the log
    odds ``score`` of block are above 0. Its tokens are the words of the host, but for
    its last label, and of the path, where digits count as one token. A null url, or
    one without ``://``, has no host, path or tokens; its score is the log odds of the
    classes. Repeated rows are judged each; no rows give no result. Counts are taken over distinct hosts and path forms, so a host with a
    third of all rows is one row of them. Rules are few: they are a CASE expression."""
    rows = pages.select("page_id", "url").select("page_id", host_of().alias("host"), path_of().alias("path"))
    rows = rows.withColumn("rule", rule_of(rules)).withColumn("form", F.regexp_replace(F.lower("path"), "[0-9]+", "0"))
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        ruled = F.when(F.col("rule") == rule, verdict).otherwise(ruled)
    rows = rows.withColumn("ruled", ruled)

    hosts = materialize(rows.groupBy("host").agg(*(F.count_if(F.col("ruled") == v).alias(v) for v in ("block", "allow"))))
    forms = materialize(rows.groupBy("form").agg(*(F.count_if(F.col("ruled") == v).alias(v) for v in ("block", "allow"))))
    names = hosts.select("host", F.explode(F.regexp_extract_all(F.regexp_replace(F.lower("host"), r"\.?[^.]*$", ""), F.lit("([a-z]+)"), F.lit(1))).alias("name"))
    cut = segmented(names.select("name"), materialize(lexicon(pages)))
    host_words = materialize(names.join(cut, "name").select("host", F.explode("words").alias("token")))
    form_words = forms.select("form", F.explode(F.filter(F.split("form", "[^\\p{L}0-9]+"), lambda x: x != "")).alias("token"))

    seen = host_words.join(hosts, "host").select("token", "block", "allow").union(form_words.join(forms, "form").select("token", "block", "allow"))
    counts = seen.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).where("block + allow > 0")
    n = counts.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    block, allow, size = (x or 0 for x in n)
    classes = hosts.agg(F.sum("block"), F.sum("allow")).first()
    prior = math.log(((classes[0] or 0) + 1) / ((classes[1] or 0) + 1))
    unseen = math.log((allow + size + 1) / (block + size + 1))
    weights = counts.select("token", (F.log((F.col("block") + 1) / (F.col("allow") + 1)) + unseen).alias("weight"))

    def scored(words: DataFrame, key: str, name: str) -> DataFrame:
        weighed = words.join(weights, "token", "left")
        # written, so that Spark knows its size: it sends a small table to the rows where they are, and splits the rows of a hot key at a large one
        return materialize(weighed.groupBy(key).agg(F.sum(F.coalesce("weight", F.lit(unseen))).alias(name), F.sort_array(F.collect_set("token")).alias(f"{name}_words")))

    out = rows.join(scored(host_words, "host", "of_host"), "host", "left").join(scored(form_words, "form", "of_form"), "form", "left")
    score = F.lit(prior) + F.coalesce("of_host", F.lit(0.0)) + F.coalesce("of_form", F.lit(0.0))
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"), F.col("of_host_words").alias("host_words")
    )


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
