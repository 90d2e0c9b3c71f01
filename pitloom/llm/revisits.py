"""Operator 3: resolve WARC not-modified revisit records to the full response they stand for.

An as-of join by canonical URL: each revisit takes the latest earlier response of status 200. Validators decide whether
it may stand for it (entity tags by weak comparison, else Last-Modified, else payload digests), and the headers that a
304 may update are merged over the stored ones.

The as-of join works in two levels. The URL's records are cut into time slices; inside a slice a running last value
finds the response, and one summary row per (URL, slice) carries the last response of earlier slices. So a URL with
any share of the records is dealt over many tasks, and only the summaries of a URL meet.

Defined results: a null URL or null time matches nothing (``orphan``); at equal times the lower record id is earlier,
and a record is never earlier than its copy (repeated rows give repeated results); null headers count as none;
header names are compared in lower case; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time slices over the span of all records.
SLICES = 512
#: Headers that a 304 response must not change in the stored response: they describe its payload or one hop.
FIXED_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without closing slash, sorted query without tracking
    parameters; scheme and fragment do not count."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.|:80$|:443$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[^=]*|fbclid|gclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _lower_keys(headers: Column) -> Column:
    return F.transform_keys(F.coalesce(headers, F.expr("map()").cast("map<string,string>")), lambda k, _: F.lower(k))


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, at, kind, status, etag, last_modified, digest, headers).

    ``at`` is in seconds; ``kind`` is 'response' or 'revisit'. Returns record_id, canonical_url, target_id (the
    response's record id), verdict and merged_headers. Verdicts: ``resolved``; ``mismatch`` (a validator differs);
    ``unverified`` (no validator in common); ``orphan`` (no earlier response). Headers are merged only if resolved.
    """
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("canonical_url"),
        F.col("at").cast("long").alias("at"),
        "kind",
        F.struct(
            F.col("record_id").cast("long").alias("record_id"), "etag", "last_modified", "digest",
            _lower_keys(F.col("headers")).alias("headers"),
        ).alias("own"),
        ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"),
    )
    keyed = rows.filter(F.col("canonical_url").isNotNull() & F.col("at").isNotNull())
    span = keyed.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    low = span["low"] or 0
    width = max(1, ((span["high"] or 0) - low) // slices + 1)
    keyed = keyed.withColumn("slice", F.expr(f"(at - {low}) div {width}"))
    # Inside a slice: the last full response before each record. Responses of one instant come in order of id.
    inside = Window.partitionBy("canonical_url", "slice").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.withColumn("hit", F.last(F.when(F.col("full"), F.col("own")), ignorenulls=True).over(inside))
    revisits = near.filter(F.col("kind") == "revisit").drop("full")
    # Across slices: one summary per (URL, slice) that holds a full response.
    newest = (
        keyed.filter("full")
        .groupBy("canonical_url", "slice")
        .agg(F.max_by("own", F.struct("at", "record_id")).alias("last_full"))
    )
    asked = revisits.filter(F.col("hit").isNull()).select("canonical_url", "slice").distinct()
    both = newest.join(asked.withColumn("asked", F.lit(True)), ["canonical_url", "slice"], "full_outer")
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        both.withColumn("carried", F.last("last_full", ignorenulls=True).over(before))
        .filter("asked")
        .select("canonical_url", "slice", "carried")
    )
    found = revisits.filter(F.col("hit").isNotNull()).unionByName(
        revisits.filter(F.col("hit").isNull())
        .join(carried, ["canonical_url", "slice"], "left")
        .withColumn("hit", F.col("carried"))
        .drop("carried")
    )
    lost = rows.filter((F.col("kind") == "revisit") & (F.col("canonical_url").isNull() | F.col("at").isNull()))
    columns = ["record_id", "canonical_url", "own"]
    none = F.lit(None).cast(found.schema["hit"].dataType)
    return _judged(found.select(*columns, "hit").unionByName(lost.select(*columns, none.alias("hit"))))


def _judged(found: DataFrame) -> DataFrame:
    own, hit = F.col("own"), F.col("hit")
    tag = _weak(own["etag"]) == _weak(hit["etag"])
    same = F.coalesce(tag, own["last_modified"] == hit["last_modified"], own["digest"] == hit["digest"])
    verdict = (
        F.when(hit.isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    )
    update = F.map_filter(own["headers"], lambda k, _: ~k.isin(*FIXED_HEADERS))
    stay = F.map_filter(hit["headers"], lambda k, _: ~F.array_contains(F.map_keys(update), k))
    merged = F.map_concat(stay, update)
    return found.select(
        "record_id",
        "canonical_url",
        hit["record_id"].alias("target_id"),
        verdict.alias("verdict"),
        F.when(verdict == "resolved", merged).alias("merged_headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log derived from ``pages``: each page's response, and a later (at times an earlier) conditional request
    that was answered by 304. What validators they carry, and whether they agree, follows from the page id."""
    n = F.col("page_id")
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(
        n, "url", F.md5(html.cast("binary")).alias("digest"), F.octet_length(html).cast("string").alias("length")
    )
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    modified = F.concat(F.lit("day-"), (n % 97).cast("string"))
    server = F.concat(F.lit("edge"), (n % 4).cast("string"))
    at = n * 1000
    response = base.select(
        (n * 2).alias("record_id"), "url", at.alias("at"), F.lit("response").alias("kind"),
        F.when(n % 13 == 0, 404).otherwise(200).alias("status"),
        F.when(n % 3 != 0, tag).alias("etag"), F.when(n % 4 != 0, modified).alias("last_modified"),
        F.when(n % 6 != 0, F.col("digest")).alias("digest"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("length"),
            F.lit("Date"), at.cast("string"), F.lit("Server"), server,
        ).alias("headers"),
    )
    later = F.when(n % 11 == 0, at - 500).otherwise(at + 500)
    revisit = base.select(
        (n * 2 + 1).alias("record_id"), "url", later.alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(n % 7 == 0, F.lit('"changed"')).when(n % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag).alias("etag"),
        F.when(n % 5 != 0, modified).alias("last_modified"), F.col("digest"),
        F.create_map(
            F.lit("Date"), later.cast("string"), F.lit("Cache-Control"), F.concat(F.lit("max-age="), (n % 100).cast("string")),
            F.lit("Content-Length"), F.lit("0"),
        ).alias("headers"),
    )
    return response.unionByName(revisit)


def header_lines(headers: Column) -> Column:
    """``name: value`` lines in order of names."""
    entries = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


ORACLE_SQL = r"""
WITH bare AS (
  SELECT page_id AS n, url, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::VARCHAR AS length,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b
  FROM pages),
canon AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
                                  lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid)(=|$)'))) AS kept
  FROM bare),
c AS (
  SELECT n, digest, length, '"' || substr(digest, 1, 16) || '"' AS tag, 'day-' || (n % 97) AS modified, 'edge' || (n % 4) AS server,
         regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^www\.|:80$|:443$', '', 'g')
         || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url
  FROM canon),
resp AS (
  SELECT n * 2 AS target_id, canonical_url, n * 1000 AS at_time, CASE WHEN n % 3 <> 0 THEN tag END AS etag,
         CASE WHEN n % 4 <> 0 THEN modified END AS lm, CASE WHEN n % 6 <> 0 THEN digest END AS dg, length, server
  FROM c WHERE n % 13 <> 0),
rev AS (
  SELECT n * 2 + 1 AS record_id, canonical_url, n, CASE WHEN n % 11 = 0 THEN n * 1000 - 500 ELSE n * 1000 + 500 END AS at_time,
         CASE WHEN n % 7 = 0 THEN '"changed"' ELSE tag END AS etag, CASE WHEN n % 5 <> 0 THEN modified END AS lm, digest AS dg
  FROM c),
j AS (
  SELECT rev.*, r.target_id, r.length, r.server,
         coalesce(rev.etag = r.etag, rev.lm = r.lm, rev.dg = r.dg) AS same
  FROM rev ASOF LEFT JOIN resp r ON rev.canonical_url = r.canonical_url AND rev.at_time > r.at_time)
SELECT record_id, canonical_url, target_id,
       CASE WHEN target_id IS NULL THEN 'orphan' WHEN same IS NULL THEN 'unverified' WHEN same THEN 'resolved' ELSE 'mismatch' END AS verdict,
       CASE WHEN same THEN 'cache-control: max-age=' || (n % 100) || chr(10) || 'content-length: ' || length || chr(10)
            || 'content-type: text/html' || chr(10) || 'date: ' || at_time || chr(10) || 'server: ' || server END AS merged_headers
FROM j
"""
