"""Resolution of not-modified revisits: an as-of join to the latest earlier full response of the same canonical URL.

Records are dealt by ranges of (canonical URL, capture time), so that the captures of one hot URL spread over tasks.
Inside a range the latest earlier response is a running maximum; what a URL brings along from earlier ranges is a running
maximum over the ranges' own maxima, and only URLs at the edge of a range (at most two a range) have one. Payloads take
no part: a match is an identifier, with which headers are joined at the end.

A revisit is resolved when its first usable validator agrees: ``ETag`` (weak marks ignored), else ``Last-Modified``, else
the payload digest. The result's headers are the response's, replaced by those of the revisit that a 304 may update.

Defined cases: a response at the same time is not earlier; of several at one time the largest ``record_id`` counts; null
URLs and null times match nothing; of a repeated ``record_id`` the headers that are largest as JSON count; URLs and headers of any
length are taken whole; a validator counts only where both sides have it; without any, ``unverified``; repeated
rows are each resolved; null headers are empty; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.lineage import cut

#: Headers that a 304 response may carry to update a stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
_URL = r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)(\?[^#]*)?"
_TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, ``m.`` and default port; path without trailing slash; sorted query without tracking."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), r"/+$", "")
    parts = F.split(F.substring(F.regexp_extract(url, _URL, 3), 2, 1 << 30), "&")
    query = F.array_join(F.array_sort(F.filter(parts, lambda p: (p != "") & ~p.rlike(_TRACKING))), "&")
    return F.when(url.rlike(_URL), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise(F.trim(url))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per revisit: ``record_id, canonical_url, response_id, resolved, reason, digest, headers`` (canonical JSON).

    ``records``: ``record_id long, url, captured_at long, kind`` (``response`` or ``revisit``), ``etag, last_modified,
    digest, headers map<string,string>`` with lower-case names.
    """
    spark = records.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = records.select(canonical_url(F.col("url")).alias("canonical_url"), F.col("captured_at").cast("long").alias("captured_at"), F.col("record_id").cast("long").alias("record_id"), "kind", "etag", "last_modified", "digest")
    dealt = cut(light.repartitionByRange(ranges, "canonical_url", "captured_at").withColumn("part", F.spark_partition_id()), "captures")
    full = F.when((F.col("kind") == "response") & F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull(), F.struct("captured_at", "record_id", "etag", "last_modified", "digest"))
    earlier = Window.partitionBy("part", "canonical_url").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("own", F.max(full).over(earlier)).where("kind = 'revisit'")
    edges = dealt.where("canonical_url IS NOT NULL").groupBy("part").agg(F.min("canonical_url").alias("lo"), F.max("canonical_url").alias("hi"))
    edges = edges.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("canonical_url")).distinct()
    # at most two URLs a range: bounded by the number of ranges, whatever the data
    sums = dealt.join(F.broadcast(edges), "canonical_url", "left_semi").groupBy("canonical_url", "part").agg(F.max(full).alias("most"))
    carried = sums.withColumn("carried", F.max("most").over(Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("carried IS NOT NULL")
    found = inside.join(F.broadcast(carried.select("canonical_url", "part", "carried")), ["canonical_url", "part"], "left")
    found = found.withColumn("hit", F.when(F.col("captured_at").isNotNull(), F.greatest("own", "carried")))
    hit = F.col("hit")
    reason = (
        F.when(hit.isNull(), "no earlier response")
        .when(F.col("etag").isNotNull() & hit["etag"].isNotNull(), F.when(_strong(F.col("etag")) == _strong(hit["etag"]), "etag").otherwise("etag differs"))
        .when(F.col("last_modified").isNotNull() & hit["last_modified"].isNotNull(), F.when(F.col("last_modified") == hit["last_modified"], "last-modified").otherwise("last-modified differs"))
        .when(F.col("digest").isNotNull() & hit["digest"].isNotNull(), F.when(F.col("digest") == hit["digest"], "digest").otherwise("digest differs"))
        .otherwise("unverified")
    )
    found = found.select("record_id", "canonical_url", "captured_at", hit["record_id"].alias("response_id"), reason.alias("reason"), hit["digest"].alias("digest"))
    found = found.withColumn("resolved", F.col("reason").isin("etag", "last-modified", "digest"))
    none = F.create_map().cast("map<string,string>")
    held = records.where("kind = 'response'").groupBy(F.col("record_id").cast("long").alias("response_id")).agg(F.max_by("headers", F.to_json("headers")).alias("stored"))
    fresh = records.where("kind = 'revisit'").groupBy(F.col("record_id").cast("long").alias("record_id")).agg(F.max_by("headers", F.to_json("headers")).alias("update"))
    rows = found.join(fresh, "record_id", "left").join(held, "response_id", "left")
    allowed = F.map_filter(F.coalesce("update", none), lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    base = F.map_filter(F.coalesce("stored", none), lambda k, _: ~F.map_contains_key(allowed, k))
    merged = F.array_sort(F.map_entries(F.map_concat(base, allowed)))
    return rows.select("record_id", "canonical_url", "response_id", "resolved", "reason", F.when(F.col("resolved"), F.col("digest")).alias("digest"), F.when(F.col("resolved"), F.to_json(F.map_from_entries(merged))).alias("headers"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Captures of a page table: each row is a full response at time ``page_id`` and is revisited 500 later.

    Revisits of every fifth page have no validator but the digest, of every seventh an outdated ``ETag``.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    page = cut(page, "pages")
    etag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    nothing = F.lit(None).cast("string")
    response = page.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("captured_at"), F.lit("response").alias("kind"), etag.alias("etag"), nothing.alias("last_modified"), "digest", F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size"), F.lit("date"), F.concat(F.lit("t"), F.col("page_id").cast("string")), F.lit("etag"), etag).alias("headers"))
    sent = F.when(F.col("page_id") % 5 == 0, nothing).when(F.col("page_id") % 7 == 0, F.lit('"outdated"')).otherwise(etag)
    later = F.col("page_id") + 500
    revisit = page.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("captured_at"), F.lit("revisit").alias("kind"), sent.alias("etag"), nothing.alias("last_modified"), "digest", F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(F.lit("t"), later.cast("string"))).alias("headers"))
    return response.unionByName(revisit)
