"""WARC revisit records: each "not modified" capture gets the full response that it stands for.

Captures are ordered by canonical URL and time. A revisit takes the latest earlier full response of its URL (an
as-of join), its validators are checked against that response, and of its own headers those that a 304 response may
update are merged into the response's headers. Captures are dealt to ranges of (URL, time), so a URL with very many
captures spreads over many tasks; what a range needs of the ranges before it is one response for each URL.

Defined results: earlier means at an earlier second; of several responses at one second the greatest ``record_id``
counts; a revisit without an earlier response is ``no_response``; with an entity tag, tags are compared weakly;
else, with a date, the response must not be newer; a revisit without validators is ``unchecked``; a null URL or time
never matches; null headers count as none; repeated rows are resolved alike; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Header fields that a 304 response may update.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "vary", "warning")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or ``utm_`` parameters, other parameters sorted."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)"
    scheme, host = F.lower(F.regexp_extract(url, parts, 1)), F.lower(F.regexp_extract(url, parts, 2))
    host = F.when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", "")) \
        .when((scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(url, parts, 3)
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, parts, 4), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query)
    return F.when(scheme == "", F.regexp_replace(url, "#.*$", "")).otherwise(whole)


def captures(pages: DataFrame) -> DataFrame:
    """Capture records made from landed pages: a full response of each and three later or earlier revisits."""
    at = F.lit(1_600_000_000) + (F.col("page_id") * 7919) % 1_000_003 * 60
    base = pages.select("page_id", "url", F.md5("html").alias("digest"), F.char_length("html").cast("string").alias("size"), at.alias("at")) \
        .withColumn("tag", F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')))
    changed = F.col("page_id") % 4 == 0
    second = lambda c: c.cast("string")
    full = base.select(
        F.concat(F.lit("r"), F.col("page_id")).alias("record_id"), "url", "at", F.lit("response").alias("kind"), F.col("tag").alias("etag"),
        (F.col("at") - 3600).alias("modified"), "digest",
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size"), F.lit("date"), second(F.col("at")),
                     F.lit("etag"), F.col("tag"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"))

    def again(k: int, url: Column, at: Column, tag: Column, modified: Column) -> DataFrame:
        return base.select(
            F.concat(F.lit("v"), F.col("page_id"), F.lit(f"-{k}")).alias("record_id"), url.alias("url"), at.alias("at"), F.lit("revisit").alias("kind"),
            tag.alias("etag"), modified.alias("modified"), F.lit(None).cast("string").alias("digest"),
            F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), second(at), F.lit("cache-control"), F.lit(f"max-age={k * 100}")).alias("headers"))

    none = F.lit(None)
    return full.unionByName(again(1, F.concat("url", F.lit("#again")), F.col("at") + 86_400, F.when(changed, F.lit('"0"')).otherwise(F.concat(F.lit("W/"), F.col("tag"))), none.cast("bigint"))) \
        .unionByName(again(2, F.col("url"), F.col("at") + 172_800, none.cast("string"), F.col("at") - F.when(changed, 7200).otherwise(3600))) \
        .unionByName(again(3, F.col("url"), F.col("at") - 86_400, F.col("tag"), none.cast("bigint")))


def fields_of(headers: Column) -> Column:
    """Entries of a header map with names in lower case; of names that then agree the last counts."""
    entries = F.transform(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")),
                          lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))


def headers_text(headers: Column) -> Column:
    """Header lines in the order of their names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")


def resolved(records: DataFrame) -> DataFrame:
    """``record_id, url, at, status, response_id, digest, headers`` of every revisit record.

    ``records`` has ``record_id, url, at`` (seconds)``, kind, etag, modified`` (seconds)``, digest, headers map``.
    """
    columns = ["record_id", "at", "kind", "etag", "modified", "digest", "headers"]
    keyed = records.select(canonical_url(F.col("url")).alias("url"), *columns)
    parts = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(keyed.repartitionByRange(parts, "url", "at").withColumn("part", F.spark_partition_id()), "captures")
    full = F.when((F.col("kind") == "response") & F.col("at").isNotNull() & F.col("url").isNotNull(),
                  F.struct("at", "record_id", "etag", "modified", "digest", "headers_text"))
    text = F.to_json("headers")  # maps have no order, structs with text do
    rows = dealt.withColumn("headers_text", text).withColumn("full", full)
    earlier = Window.partitionBy("url", "part").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("found", F.max("full").over(earlier)).where("kind = 'revisit'")
    # one row for each URL and range; only URLs that cross ranges have several
    ends = rows.groupBy("url", "part").agg(F.max("full").alias("latest"))
    before = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.max("latest").over(before)).where("carried is not null").select("url", "part", "carried")
    joined = near.join(carried, ["url", "part"], "left").withColumn("match", F.when(F.col("at").isNotNull(), F.coalesce("found", "carried")))

    def strong(tag: Column) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    m = F.col("match")
    status = F.when(m.isNull(), "no_response") \
        .when(F.col("etag").isNotNull(), F.when(F.coalesce(strong(F.col("etag")) == strong(m["etag"]), F.lit(False)), "resolved").otherwise("validator_mismatch")) \
        .when(F.col("modified").isNotNull(), F.when(F.coalesce(m["modified"] <= F.col("modified"), F.lit(False)), "resolved").otherwise("validator_mismatch")) \
        .otherwise("unchecked")
    done = joined.withColumn("status", status).withColumn("ok", F.col("status").isin("resolved", "unchecked"))
    done = done.withColumn("own", F.filter(fields_of(F.col("headers")), lambda e: e["key"].isin(*PERMITTED))) \
        .withColumn("base", fields_of(F.from_json(m["headers_text"], "map<string,string>")))
    merged = F.map_from_entries(F.concat(F.filter("base", lambda e: ~F.exists("own", lambda o: o["key"] == e["key"])), F.col("own")))
    return done.select("record_id", "url", "at", "status", F.when(F.col("ok"), m["record_id"]).alias("response_id"),
                       F.when(F.col("ok"), m["digest"]).alias("digest"), F.when(F.col("ok"), merged).alias("headers"))
