"""Per-site profile, counts and listings over the entity tables.

Sites differ in size by orders of magnitude. Everything keyed by site is an aggregate with map-side partials, a
top-k or long rows; no list of a site's items is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_heading, plausible_phone, truncate_with_rest
from .groups import top_per_group
from .keys import first_wins

# Report limits and the pages that reports leave out.
INFO_MIN_CHARS = 300
INFO_SKIP = {
    "console": r"(?i)/(catalog|basket|compare|personal|login|favicon|\?)",
    "markdown": r"(?i)/(catalog|basket|compare|personal|login|favicon|\?sort=)",
}
PREVIEW_CHARS = 2000
SHORT_CHARS = 110
REPORT_PRODUCTS = 60
REPORT_SERVICES = 40
LG_K = 14  # registers of a count sketch, as a power of two
PROFILE_FIELDS = ("domain", "site_title", "meta_description", "meta_keywords", "main_h1")


def home_page(pages: DataFrame) -> DataFrame:
    """(site, url, title, description, keywords, h1): the page with the shortest url (then the lowest)."""
    row = F.struct(F.length("url").alias("n"), "url", "title", "description", "keywords", "h1")
    return pages.groupBy("site").agg(F.min(row).alias("r")) \
        .select("site", "r.url", "r.title", "r.description", "r.keywords", "r.h1")


def social_links(contacts: DataFrame) -> DataFrame:
    """(site, network, value): one link per site and network, the lowest value."""
    socials = contacts.where(F.col("type").startswith("social:"))
    return socials.groupBy("site", F.expr("substring(type, 8)").alias("network")).agg(F.min("value").alias("value"))


def distinct_addresses(contacts: DataFrame) -> DataFrame:
    return contacts.where(F.col("type") == "address").select("site", "value").distinct()


def contacts_by_type(contacts: DataFrame) -> DataFrame:
    """(site, type, value): distinct values per site and contact type."""
    return contacts.select("site", "type", "value").distinct()


def site_profile(pages: DataFrame, contacts: DataFrame, org: DataFrame | None = None) -> DataFrame:
    """(site, key, value): the company table, one row per fact.

    ``email`` and ``phone`` have a row per distinct value, ``social:<network>`` one row each, all others one per site.
    """
    home = home_page(pages)
    fields = dict(zip(PROFILE_FIELDS, ("site", "title", "description", "keywords", "h1")))
    out = home.select("site", F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.coalesce(F.col(c), F.lit("")).alias("value")) for k, c in fields.items()
    ])).alias("kv")).select("site", "kv.key", "kv.value")
    lists = contacts.where(F.col("type").isin("email", "phone")).select("site", F.col("type").alias("key"), "value").distinct()
    networks = social_links(contacts).select("site", F.concat(F.lit("social:"), "network").alias("key"), "value")
    out = out.unionByName(lists).unionByName(networks)
    return out if org is None else out.unionByName(org.select("site", "key", "value"))


def profile_phones(profile: DataFrame) -> DataFrame:
    """(site, phone): stored profile phones that look like phone numbers."""
    return profile.where((F.col("key") == "phone") & plausible_phone(F.col("value"))).select("site", F.col("value").alias("phone"))


def report_counts(pages: DataFrame, products: DataFrame, services: DataFrame, api: DataFrame) -> DataFrame:
    """(site, pages, products, services, api_responses): rows, or distinct names, per site."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("site").agg(F.count(F.lit(1)).alias("n")).select("site", F.lit(name).alias("what"), "n")

    rows = counted(pages, "pages").unionByName(
        counted(products.select("site", "name").distinct(), "products")).unionByName(
        counted(services.select("site", "name").distinct(), "services")).unionByName(counted(api, "api_responses"))
    return rows.groupBy("site").agg(*[
        F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w)
        for w in COUNTED])


COUNTED = ("pages", "products", "services", "api_responses")


def count_sketches(pages: DataFrame, products: DataFrame, services: DataFrame, api: DataFrame) -> DataFrame:
    """(site, what, sketch): mergeable sketches of the distinct pages, product and service names, and API calls of each site.

    A sketch has a fixed size, whatever it counts, and a later load adds to it by ``merged_sketches`` without seeing the rows of
    the earlier ones. Its relative standard error is 0.6 % (2^LG_K registers), and small counts are exact.
    """
    named = {"pages": (pages, "url"), "products": (products, "name"), "services": (services, "name"), "api_responses": (api, "api_url")}
    rows = None
    for what, (df, column) in named.items():
        part = df.where(F.col(column).isNotNull()).select("site", F.lit(what).alias("what"), F.col(column).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("site", "what").agg(F.hll_sketch_agg("value", LG_K).alias("sketch"))


def merged_sketches(*loads: DataFrame) -> DataFrame:
    """Sketches of several loads as one per site and kind."""
    rows = loads[0]
    for more in loads[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("site", "what").agg(F.hll_union_agg("sketch").alias("sketch"))


def approximate_counts(sketches: DataFrame) -> DataFrame:
    """(site, pages, products, services, api_responses) as estimated from sketches."""
    n = F.hll_sketch_estimate("sketch")
    return sketches.groupBy("site").agg(*[
        F.coalesce(F.max(F.when(F.col("what") == w, n)), F.lit(0)).alias(w) for w in COUNTED])


def unique_products(products: DataFrame) -> DataFrame:
    """One row per (site, name): the lowest (source_url, seq)."""
    return first_wins(products, ["site", "name"], ["source_url", "seq"])


def unique_services(services: DataFrame) -> DataFrame:
    return first_wins(services, ["site", "name"], ["page_url"])


def _short_description() -> list[Column]:
    cut = truncate_with_rest(F.col("description"), SHORT_CHARS)
    return [cut["head"].alias("description"), cut["rest"].alias("more")]


def _part_of_line(c: Column, template: str) -> Column:
    return F.when(c != "", F.format_string(template, c)).otherwise(F.lit(""))


def product_listing(products: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per product name with its report line; with ``limit`` the first names per site in byte order.

    Descriptions show SHORT_CHARS characters and ``more``, the number of those left.
    """
    unique = unique_products(products)
    listed = unique if limit is None else top_per_group(unique, ["site"], [F.asc("name")], limit).drop("rank")
    price = F.when(F.col("price") != "", F.concat(F.lit("  | "), F.rtrim(F.concat_ws(" ", "price", "currency")))) \
        .otherwise(F.lit(""))
    old = F.when((F.col("old_price") != "") & (F.col("old_price") != F.col("price")),
                 F.concat(F.lit("  (было "), F.col("old_price"), F.lit(")"))).otherwise(F.lit(""))
    line = F.concat(F.lit("  • "), F.col("name"), price, old,
                    _part_of_line(F.col("brand"), "  | %s"), _part_of_line(F.col("category"), "  | %s"))
    return listed.select("site", "name", "price", "old_price", "currency", "brand", "category",
                         *_short_description(), "product_url", line.alias("line"))


def service_listing(services: DataFrame, limit: int | None = None) -> DataFrame:
    """(site, name, description, more): one row per service name; with ``limit`` the first names per site."""
    unique = unique_services(services)
    listed = unique if limit is None else top_per_group(unique, ["site"], [F.asc("name")], limit).drop("rank")
    return listed.select("site", "name", *_short_description())


def info_pages(pages: DataFrame, mode: str = "console") -> DataFrame:
    """Pages with more than 300 characters of text whose url is not a shop or service path.

    ``url_length`` then ``url`` is the report order.
    """
    kept = pages.where((F.length("raw_text") > INFO_MIN_CHARS) & ~F.col("url").rlike(INFO_SKIP[mode]))
    return kept.select("site", "url", F.length("url").alias("url_length"), "title", "h1", "raw_text")


def page_preview(pages: DataFrame, n: int = PREVIEW_CHARS) -> DataFrame:
    """(site, url, heading, head, rest) of the console report pages."""
    cut = truncate_with_rest(F.col("raw_text"), n)
    return info_pages(pages, "console").select(
        "site", "url", page_heading(F.col("title"), F.col("h1"), F.col("url"), F.col("site")).alias("heading"),
        cut.alias("_c")).select("site", "url", "heading", "_c.head", "_c.rest")


def crawl_summary(pages: DataFrame) -> DataFrame:
    """(site, pages): number of pages processed."""
    return pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
