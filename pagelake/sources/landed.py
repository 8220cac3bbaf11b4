"""Landed sitemaps, robots files and API responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_text
from ..functions.urls import normalize_url, site_of

# Which responses are kept.
TRACKER_HOSTS = ("google", "yandex", "analytics", "facebook", "vk.com", "metrika")
MIN_BODY = 10

URLSET = "url array<struct<loc:string>>"
INDEX = "sitemap array<struct<loc:string>>"


def _locations(landed: DataFrame, schema: str, field: str) -> DataFrame:
    parsed = landed.select("site", "path", F.from_xml("xml", schema).alias("x"))
    return parsed.select("site", "path", F.posexplode(f"x.{field}.loc").alias("pos", "loc")) \
        .where(F.col("loc").isNotNull()).select("site", "path", "pos", strip_text(F.col("loc")).alias("loc"))


def sitemap_urls(landed: DataFrame) -> DataFrame:
    """(site, url, path, pos): same-site URLs of landed sitemaps at their first position.

    Malformed XML parses to NULL and yields no rows.
    """
    found = _locations(landed, URLSET, "url").withColumn("url", normalize_url(F.col("loc")))
    own = found.where(site_of(F.col("url")) == F.col("site"))
    return own.groupBy("site", "url").agg(F.min(F.struct("path", "pos")).alias("f")).select("site", "url", "f.path", "f.pos")


def sitemap_children(landed: DataFrame) -> DataFrame:
    """(site, path, child): sitemaps listed by sitemap indexes, to be landed next."""
    return _locations(landed, INDEX, "sitemap").select("site", "path", F.col("loc").alias("child"))


def robots_sitemaps(landed: DataFrame) -> DataFrame:
    """(site, pos, sitemap): values of the Sitemap lines of robots.txt files."""
    lines = landed.select("site", F.posexplode(F.split("txt", r"\R")).alias("pos", "line"))
    return lines.where(F.lower("line").startswith("sitemap:")).select(
        "site", "pos", strip_text(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("sitemap"))


def json_responses(landed: DataFrame) -> DataFrame:
    """Landed responses that carry usable JSON, with whole bodies."""
    url = F.col("api_url")
    keep = F.contains(F.col("content_type"), F.lit("json")) & (F.length("body") >= MIN_BODY)
    for t in TRACKER_HOSTS:
        keep = keep & ~F.contains(url, F.lit(t))
    return landed.where(keep).where(F.try_parse_json("body").isNotNull())


def api_responses(landed: DataFrame, body_width: int | None = None) -> DataFrame:
    """(site, trigger_url, api_url, body, scraped_at): the stored response table.

    Bodies are whole unless ``body_width`` gives the width of the stored column.
    """
    body = F.col("body") if body_width is None else F.left("body", F.lit(body_width))
    return json_responses(landed).select(
        site_of(F.col("trigger_url")).alias("site"), "trigger_url", "api_url", body.alias("body"),
        F.col("fetched_at").alias("scraped_at"))
