"""Resolution of WARC not-modified revisits.

A revisit record says that the server answered 304: it has headers and no payload. It is resolved by
an as-of join on the canonical URL to the latest full response captured strictly before it. The pair
counts only if a validator agrees: entity tags if both have one, else dates of last modification. The
resolved record has the payload of the response, its headers, and from the revisit those headers
that a 304 answer may update.

A URL with a third of all captures is no single task: time is cut into blocks at quantiles of all records, the last
response before each record is found within (URL, block), and the last response of earlier blocks, one row for
each URL and block, is carried into the blocks that begin without one.

Defined cases: records without URL or time are never resolved (reason no-url); no earlier response: reason
no-response; validators missing or different: reason no-validator or changed; of responses with the same
time the one with the largest id is the latest; names of header fields compare without case, come out in lower case,
and of several fields with one name the first counts; null headers are none; repeated rows are resolved each; empty
tables give empty tables; further columns of a revisit pass through, unless they have the name of a result column.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Header fields that a 304 answer may update (RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
BLOCKS = 256


def canonical(url: Column) -> Column:
    """Without scheme, www or mobile prefix, fragment, campaign parameters and trailing marks; host in lower case."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z]+://(www[0-9]*\\.|m\\.)?", "")
    u = F.regexp_replace(u, "([?&])utm_[^&]*&?", "$1")
    u = F.regexp_replace(u, "[?&/]+$", "")
    return F.concat(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), F.regexp_replace(u, "^[^/?]*", ""))


def fields(headers: Column) -> Column:
    """Header fields by lower-case name."""
    names = F.transform(F.map_keys(headers), F.lower)
    entries = F.zip_with(names, F.map_values(headers), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def with_block(records: DataFrame) -> DataFrame:
    """Add ``block``, which of ``BLOCKS`` quantiles of t a record lies in."""
    cuts = records.agg(F.percentile_approx("t", [i / BLOCKS for i in range(1, BLOCKS)])).first()[0] or []
    edges = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(edges) < 3:
        return records.withColumn("block", F.lit(0.0))
    cut = Bucketizer(splits=edges, inputCol="_t", outputCol="block")
    return cut.transform(records.withColumn("_t", F.col("t").cast("double"))).drop("_t")


def latest_earlier(records: DataFrame) -> DataFrame:
    """records(rid, url, t, full boolean, head struct, ...) -> those that aren't full, with ``found``: t, rid and head of
    the latest full record with the same canonical URL and a smaller t."""
    r = records.withColumn("curl", canonical(F.col("url")))
    r = with_block(r.where(F.col("curl").isNotNull() & F.col("t").isNotNull()))
    record, order = F.struct("t", "rid", "head"), F.when(F.col("full"), F.struct("t", "rid"))
    in_block = W.partitionBy("curl", "block").orderBy("t").rangeBetween(W.unboundedPreceding, -1)
    inside = r.withColumn("own", F.max_by(record, order).over(in_block)).where(~F.col("full"))
    ends = r.where("full").groupBy("curl", "block").agg(F.max_by(record, order).alias("last"))
    wanted = inside.where("own is null").select("curl", "block").distinct()
    marks = ends.unionByName(wanted, allowMissingColumns=True).groupBy("curl", "block").agg(F.first("last", ignorenulls=True).alias("last"))
    before = W.partitionBy("curl").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.select("curl", "block", F.last("last", ignorenulls=True).over(before).alias("earlier"))
    out = inside.join(carried, ["curl", "block"], "left")
    out = out.withColumn("found", F.coalesce("own", "earlier")).drop("own", "earlier", "block", "full")
    lost = records.withColumn("curl", canonical(F.col("url"))).where(~F.col("full") & (F.col("url").isNull() | F.col("t").isNull())).drop("full")
    return out.unionByName(lost, allowMissingColumns=True)


def merged(response: Column, revisit: Column) -> Column:
    """Headers of the response, updated by those of the revisit that may be."""
    none = F.create_map().cast("map<string,string>")
    response, revisit = F.coalesce(response, none), F.coalesce(revisit, none)
    may = lambda k: k.isin(*PERMITTED)
    kept = F.map_filter(response, lambda k, v: ~(may(k) & F.coalesce(F.map_contains_key(revisit, k), F.lit(False))))
    return F.map_concat(kept, F.map_filter(revisit, lambda k, v: may(k)))


RECORD = ("rid", "url", "t", "full", "headers", "payload_id")
RESULT = ("rid", "curl", "t", "response_id", "payload_id", "headers", "reason")


def resolve(records: DataFrame) -> DataFrame:
    """records(rid, url, t, full, headers map, payload_id, ...) -> one row for each revisit: rid, curl, t,
    response_id, payload_id, headers, reason, ...; reason is 'resolved' or why not."""
    others = [c for c in records.columns if c not in (*RECORD, *RESULT)]
    head = F.struct(fields(F.col("headers")).alias("headers"), "payload_id").alias("head")
    full = F.coalesce(F.col("full"), F.lit(False))
    r = records.select("rid", "url", F.col("t").cast("long").alias("t"), full.alias("full"), head, F.when(~full, F.struct(F.lit(1).alias("_"), *others)).alias("rest"))
    found = latest_earlier(r)
    own, other = F.col("head.headers"), F.col("found.head.headers")
    tag = lambda h, k: F.try_element_at(h, F.lit(k))
    both = lambda k: tag(own, k).isNotNull() & tag(other, k).isNotNull()
    same = lambda k: tag(own, k) == tag(other, k)
    reason = (
        F.when(F.col("curl").isNull() | F.col("t").isNull(), "no-url").when(F.col("found").isNull(), "no-response")
        .when(both("etag"), F.when(same("etag"), "resolved").otherwise("changed"))
        .when(both("last-modified"), F.when(same("last-modified"), "resolved").otherwise("changed"))
        .otherwise("no-validator")
    )
    out = found.withColumn("reason", reason)
    ok = F.col("reason") == "resolved"
    return out.select("rid", "curl", "t", F.when(ok, F.col("found.rid")).alias("response_id"), F.when(ok, F.col("found.head.payload_id")).alias("payload_id"), F.when(ok, merged(other, own)).otherwise(own).alias("headers"), "reason", *(F.col("rest")[c].alias(c) for c in others))


def crawl(pages: DataFrame) -> DataFrame:
    """Records derived from the pages: a full response at page_id, and a revisit a thousand ticks later,
    every third without entity tag and every seventh with another one."""
    i = F.col("page_id").cast("long")
    etag, modified = F.md5(F.coalesce("html", F.lit(""))), F.concat(F.lit("v"), (F.floor(i / 7)).cast("string"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    full = F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in ("content-length", size, "date", i.cast("string"), "etag", etag, "last-modified", modified, "server", "a")))
    tag = F.when(i % 7 == 0, F.lit("other")).otherwise(etag)
    late = F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in ("cache-control", "max-age=60", "date", (i + 1000).cast("string"), "last-modified", modified, "server", "b")))
    late = F.when(i % 3 == 1, late).otherwise(F.map_concat(late, F.create_map(F.lit("etag"), tag)))
    responses = pages.select((2 * i).alias("rid"), "url", i.alias("t"), F.lit(True).alias("full"), full.alias("headers"), i.alias("payload_id"))
    revisits = pages.select((2 * i + 1).alias("rid"), "url", (i + 1000).alias("t"), F.lit(False).alias("full"), late.alias("headers"), F.lit(None).cast("long").alias("payload_id"))
    return responses.unionByName(revisits)


def with_payload(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    """The resolved records with the page that they stand for."""
    return resolved.join(pages.select(F.col("page_id").cast("long").alias("payload_id"), "html"), "payload_id", "left")


def resolved_pages(pages: DataFrame) -> DataFrame:
    """Every revisit of the derived crawl, with its headers and the digest of the payload it stands for."""
    out = with_payload(resolve(crawl(pages)), pages)
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.select("rid", "curl", "t", "response_id", "payload_id", "reason", F.array_join(lines, "\n").alias("headers"), F.md5("html").alias("payload_md5"))


SQL = r"""
WITH u AS (
  SELECT CAST(page_id AS BIGINT) AS i, url, html,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://(www[0-9]*\.|m\.)?', ''), '([?&])utm_[^&]*&?', '\1', 'g'), '[?&/]+$', '') AS v
  FROM pages
), p AS (
  SELECT i, html, lower(regexp_extract(v, '^[^/?]*', 0)) || regexp_replace(v, '^[^/?]*', '') AS curl, md5(coalesce(html, '')) AS tag, 'v' || CAST(i // 7 AS VARCHAR) AS modified,
         CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) AS size FROM u
), m AS (
  SELECT r.i AS i, r.curl AS curl, max(f.i) AS found FROM p r LEFT JOIN p f ON f.curl = r.curl AND f.i < r.i + 1000 GROUP BY r.i, r.curl
), j AS (
  SELECT r.i, r.curl, r.modified AS own_modified, CASE WHEN r.i % 3 = 1 THEN NULL WHEN r.i % 7 = 0 THEN 'other' ELSE r.tag END AS own_tag, f.i AS f, f.tag, f.modified, f.size, f.html
  FROM p r JOIN m ON m.i = r.i LEFT JOIN p f ON f.i = m.found
), k AS (
  SELECT *, CASE WHEN curl IS NULL THEN 'no-url' WHEN f IS NULL THEN 'no-response'
    WHEN own_tag IS NOT NULL THEN CASE WHEN own_tag = tag THEN 'resolved' ELSE 'changed' END
    WHEN own_modified = modified THEN 'resolved' ELSE 'changed' END AS reason FROM j
)
SELECT 2 * i + 1 AS rid, curl, i + 1000 AS t, CASE WHEN reason = 'resolved' THEN 2 * f END AS response_id, CASE WHEN reason = 'resolved' THEN f END AS payload_id, reason,
  CASE WHEN reason = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || size, 'date: ' || (i + 1000), 'etag: ' || coalesce(own_tag, tag), 'last-modified: ' || own_modified, 'server: a')
  ELSE concat_ws(chr(10), 'cache-control: max-age=60', 'date: ' || (i + 1000), 'etag: ' || own_tag, 'last-modified: ' || own_modified, 'server: b') END AS headers,
  CASE WHEN reason = 'resolved' THEN md5(html) END AS payload_md5
FROM k
"""
