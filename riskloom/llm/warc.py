"""WARC: resolves not-modified revisits against the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Header fields of a 304 answer that replace the stored ones, and query
#: parameters that do not name a resource.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "^(utm_[^=]*|fbclid|gclid|ref)(=|$)"
#: Time slices of a URL's captures that are searched on their own.
SLICES = 64


def canonical(url: str = "url") -> Column:
    """Host in small letters without ``www.`` and default port, path without a closing
    slash or index page, parameters sorted and without tracking; no scheme, no
    fragment. A url without ``://`` is taken whole, null stays null."""
    u = F.col(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^:/?#]*://([^/?#]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1), r"(/index\.html?|/+)$", "")
    params = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(params), "&"))).otherwise("")
    return F.when(u.contains("://"), F.concat(host, path, query)).otherwise(u)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit of ``records(record_id, kind, url, ts, headers, digest)`` with the
    response it stands for: record_id, target (canonical URL), ts, response_id, outcome,
    headers, digest. ``kind`` is 'response' (a full answer) or 'revisit' (304).

    The response is the latest strictly earlier one of the canonical URL, the larger
    record_id among those of one time. Outcomes: 'resolved' if the revisit's ETag
    equals the response's by weak comparison, or, without an ETag, its Last-Modified;
    'unvalidated' if it names neither; 'mismatch' if the named one differs or is
    missing there; 'missing' without an earlier response. Resolved revisits get the
    response's digest and headers, where PERMITTED fields of the revisit replace the
    stored ones; the others get null. Header names are in small letters. Rows of other
    kinds, or with a null url or time, are left out; repeated rows stay repeated; no rows
    give no result.

    The as-of join looks back within a slice of time of a URL, and takes the last
    response of earlier slices from a summary, so that a URL with very many captures
    is spread over SLICES groups."""
    rows = records.where("kind in ('response', 'revisit') and url is not null and ts is not null")
    rows = rows.select("record_id", "kind", canonical().alias("target"), F.col("ts").cast("long"), "headers", "digest")
    # bounds at equal numbers of captures: a stray time moves none of them, a hot URL's own times most
    bounds = sorted(set(rows.agg(F.percentile_approx("ts", [i / SLICES for i in range(1, SLICES)])).first()[0] or []))
    rows = rows.withColumn("slice", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("ts"))) if bounds else F.lit(0))
    full = F.struct("ts", "record_id", "headers", "digest")

    last = rows.where("kind = 'response'").groupBy("target", "slice").agg(F.max_by(full, F.struct("ts", "record_id")).alias("stored"))
    slices = rows.where("kind = 'revisit'").select("target", "slice").distinct().join(last, ["target", "slice"], "full")
    before = Window.partitionBy("target").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("target", "slice", F.last("stored", ignorenulls=True).over(before).alias("carried"))

    # at one time revisits come first: a response of the same time is not earlier
    within = Window.partitionBy("target", "slice").orderBy("ts", F.when(F.col("kind") == "revisit", 0).otherwise(1), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("near", F.last(F.when(F.col("kind") == "response", full), ignorenulls=True).over(within)).where("kind = 'revisit'")
    found = found.join(carried, ["target", "slice"], "left").withColumn("response", F.coalesce("near", "carried"))

    tag, date = F.col("headers")["etag"], F.col("headers")["last-modified"]
    stored = F.col("response.headers")
    same = F.when(tag.isNotNull(), _strong(tag) == _strong(stored["etag"])).otherwise(date == stored["last-modified"])
    outcome = (
        F.when(F.col("response").isNull(), "missing")
        .when(tag.isNull() & date.isNull(), "unvalidated")
        .when(F.coalesce(same, F.lit(False)), "resolved")
        .otherwise("mismatch")
    )
    new = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    out = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return out.select(
        "record_id", "target", "ts", F.col("response.record_id").alias("response_id"), "outcome",
        F.when(resolved, merged).alias("headers"), F.when(resolved, F.col("response.digest")).alias("digest"),
    )


def header_block(headers: str = "headers") -> Column:
    """The fields as text, sorted by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records of ``pages``: each page fetched in full at ``page_id``, then asked
    for again. How the second answer validates follows from the url's checksum: by a
    weak ETag, by date, by another ETag, or not at all."""
    digest, mode = F.md5("html"), F.expr("locate(substring(md5(url), 1, 1), '0123456789abcdef')") % 4
    tag, date = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"')), F.concat(F.lit("day "), F.length("html"))
    first = F.map_from_arrays(F.array(*map(F.lit, ("content-type", "date", "etag", "last-modified", "server"))), F.array(F.lit("text/html"), F.concat(F.lit("at "), F.col("page_id")), tag, date, F.lit("one")))
    later = F.concat(F.lit("again "), F.col("page_id"))
    second = F.map_filter(
        F.map_from_arrays(
            F.array(*map(F.lit, ("content-type", "date", "etag", "last-modified", "server"))),
            F.array(F.lit("text/plain"), later, F.when(mode == 0, F.concat(F.lit("W/"), tag)).when(mode == 2, F.lit('"other"')), F.when(mode != 3, date), F.lit("two")),
        ),
        lambda k, v: v.isNotNull(),
    )
    one = pages.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("ts"), first.alias("headers"), digest.alias("digest"))
    two = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (F.col("page_id") + 10_000_000).alias("ts"), second.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return one.unionByName(two)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    return out.withColumn("headers", header_block())


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, md5(html) AS digest, strpos('0123456789abcdef', substr(md5(url), 1, 1)) % 4 AS mode, '"' || substr(md5(html), 1, 12) || '"' AS tag, 'day ' || length(html) AS day,
    regexp_replace(lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)), '^www\.|:(80|443)$', '', 'g')
      || regexp_replace(regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1), '(/index\.html?|/+)$', '')
      || CASE WHEN len(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))) > 0
         THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))), '&') ELSE '' END AS target
  FROM pages WHERE url IS NOT NULL
), r AS (
  SELECT v.page_id * 2 + 1 AS record_id, v.target, v.page_id + 10000000 AS ts, v.page_id, v.mode, v.tag, v.day,
    f.page_id AS found, f.tag AS stored_tag, f.day AS stored_day, f.digest,
    row_number() OVER (PARTITION BY v.page_id ORDER BY f.page_id DESC) AS n
  FROM p v LEFT JOIN p f ON f.target = v.target AND f.page_id < v.page_id + 10000000
), o AS (
  SELECT *, CASE WHEN found IS NULL THEN 'missing' WHEN mode = 3 THEN 'unvalidated'
    WHEN mode = 0 AND tag = stored_tag THEN 'resolved' WHEN mode = 1 AND day = stored_day THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM r WHERE n = 1
)
SELECT record_id, target, ts, found * 2 AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: again ' || page_id || chr(10) || 'etag: ' || CASE WHEN mode = 0 THEN 'W/' || tag ELSE stored_tag END || chr(10) || 'last-modified: ' || day || chr(10) || 'server: one' END AS headers,
  CASE WHEN outcome = 'resolved' THEN digest END AS digest
FROM o
"""
