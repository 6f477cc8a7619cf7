"""Not-modified records of web archives, resolved to the full response they stand for.

A revisit takes the latest earlier full response of the same canonical URL; their validators are
compared, and the headers of the revisit that a 304 answer may change are merged into those of the
response. The as-of join cuts the captures of a URL into spans of time: inside a span a window
finds the latest response, and one row per span carries it to later spans, so that a URL with very
many captures is spread over many tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_SECONDS = 6 * 3600
#: fixed values: headers that a 304 answer may not change (content and connection headers)
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*://)?"
HOST = r"([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"  #: user, then a name or an address in brackets


def canonical_url(url: str | Column) -> Column:
    """Host in lower case without user and www., its port but for 80 and 443, path without closing
    slash, and the sorted query without tracking parameters; no scheme and no fragment. NULL for NULL."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.regexp_replace(F.lower(F.regexp_extract(u, SCHEME + HOST, 3)), r"^www\.", "")
    port = F.regexp_extract(u, SCHEME + HOST + ":([0-9]+)", 4)
    host = F.concat(host, F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)))
    path = F.regexp_replace(F.regexp_extract(u, SCHEME + r"[^/?#]*([^?#]*)", 2), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """(record_id, kind 'response' or 'revisit', url, ts: seconds, headers: map with lower-case
    names, ...) -> one row per revisit: record_id, canonical_url, response_id, status, headers.

    Earlier means by (ts, record_id). ``status`` is ``resolved``; ``no_response`` without an earlier
    response (also for a NULL url or ts, and responses with a NULL ts are never taken);
    ``no_validator`` if no validator stands in both; ``mismatch`` if the ETags differ (weakly
    compared) or, without a pair of ETags, the Last-Modified dates do. ``response_id`` names the
    candidate whatever the status; ``headers`` are merged only when resolved, else those of the
    revisit. Other kinds of records are left out. Repeated revisits stay rows of their own; of responses
    equal in ts and record_id any one is taken. Further columns are not read.
    """
    r = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", canonical_url("url").alias("canonical_url"), "ts",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    placed = r.where("canonical_url IS NOT NULL AND ts IS NOT NULL").withColumn("_span", F.floor(F.col("ts") / span_seconds))
    full = F.when(F.col("kind") == "response", F.struct("record_id", "headers"))
    before = Window.partitionBy("canonical_url", "_span").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_near", F.last(full, ignorenulls=True).over(before))
    latest = (
        placed.where("kind = 'response'").groupBy("canonical_url", "_span")
        .agg(F.max_by(F.struct("record_id", "headers"), F.struct("ts", "record_id")).alias("_last"))
    )
    asked = inside.where("kind = 'revisit'")
    # spans that only hold revisits need the carried response as well
    spans = asked.select("canonical_url", "_span").distinct().join(latest, ["canonical_url", "_span"], "full")
    earlier = Window.partitionBy("canonical_url").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("canonical_url", "_span", F.last("_last", ignorenulls=True).over(earlier).alias("_far"))
    found = asked.join(carried, ["canonical_url", "_span"]).withColumn("_hit", F.coalesce("_near", "_far"))
    unplaced = r.where("kind = 'revisit' AND (canonical_url IS NULL OR ts IS NULL)").withColumn("_hit", F.lit(None).cast(found.schema["_hit"].dataType))
    cols = ["record_id", "canonical_url", "headers", "_hit"]
    d = found.select(*cols).unionByName(unplaced.select(*cols))
    old, new = F.col("_hit.headers"), F.col("headers")
    tags = old["etag"].isNotNull() & new["etag"].isNotNull()
    dates = old["last-modified"].isNotNull() & new["last-modified"].isNotNull()
    status = (
        F.when(F.col("_hit").isNull(), "no_response")
        .when(tags, F.when(_opaque(old["etag"]) == _opaque(new["etag"]), "resolved").otherwise("mismatch"))
        .when(dates, F.when(old["last-modified"] == new["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    allowed = F.map_filter(new, lambda k, v: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    return d.withColumn("status", status).select(
        "record_id", "canonical_url", F.col("_hit.record_id").alias("response_id"), "status",
        F.when(F.col("status") == "resolved", merged).otherwise(new).alias("headers"))


def as_records(pages: DataFrame) -> DataFrame:
    """Archive records from (page_id, url, html): a response for each page and a later revisit of
    it. Of the revisits some carry another ETag, some only a date, and some come too early."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    d = pages.select("page_id", "url", F.coalesce(F.length("html"), F.lit(0)).alias("_n"), tag.alias("_tag"), F.col("page_id").alias("_pick"))
    ts = F.lit(1_700_000_000).cast("long") + F.col("page_id") * 10
    day = F.concat(F.lit("day "), F.floor(ts / 86400).cast("string"))
    response = d.select(
        (2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"), "url", ts.alias("ts"),
        F.map_from_arrays(
            F.array(*map(F.lit, ("etag", "last-modified", "content-length", "content-type", "date"))),
            F.array("_tag", day, F.col("_n").cast("string"), F.lit("text/html"), ts.cast("string"))).alias("headers"))
    again = F.when(F.col("_pick") % 13 == 0, ts - 5).otherwise(ts + 5 + (F.col("_pick") % 7) * 86400)
    sent = (
        F.when(F.col("_pick") % 5 == 0, F.create_map(
            F.lit("etag"), F.lit('"other"'), F.lit("content-length"), F.lit("0"), F.lit("date"), again.cast("string")))
        .when(F.col("_pick") % 11 == 0, F.create_map(
            F.lit("last-modified"), day, F.lit("content-length"), F.lit("0"), F.lit("date"), again.cast("string")))
        .otherwise(F.create_map(
            F.lit("etag"), F.concat(F.lit("W/"), F.col("_tag")), F.lit("content-length"), F.lit("0"), F.lit("date"), again.cast("string"),
            F.lit("cache-control"), F.lit("max-age=60")))
    )
    revisit = d.select((2 * F.col("page_id") + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", again.alias("ts"), sent.alias("headers"))
    return response.unionByName(revisit)
