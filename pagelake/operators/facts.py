"""One look at every page: all that the entity tables need, in one row per page.

Tokens, elements, markup, main text, anchors and JSON-LD walks are built once each and shared by all extractors. The rows are
stored, so every entity table is a narrow read of its own column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from . import blocks, pages as P, structured as S
from .dom import with_elements

KINDS = ("pages", "contacts", "products", "services", "links", "org")


def _rows(column: Column, kind: str) -> Column:
    """The array, empty instead of NULL."""
    return F.coalesce(column, F.array().cast(kind))


CONTACTS = "array<struct<type:string,value:string>>"
SERVICES = "array<struct<name:string,seq:int,description:string>>"
CARDS = blocks.NO_CARDS


def page_facts(pages: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(site, url, one column per kind), one row per page; only what the given kinds need is built.

    ``pages`` is struct(title, description, keywords, h1, raw_text, scraped_at), ``contacts``, ``services``, ``links`` and ``org`` are
    arrays, and ``products`` has those of JSON-LD (``structured``) and of cards. The pages need site, url and html, and one row per url.
    """
    def needed(*names: str) -> bool:
        return any(n in kinds for n in names)

    scraped = F.col("fetched_at").cast("timestamp") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    mentions = [test() for kind, test in (("contacts", blocks.mentions_address), ("services", blocks.mentions_service),
                                          ("products", blocks.mentions_card)) if needed(kind)]
    parts = {"scraped_at": scraped}
    if needed("pages"):
        parts["_m"] = H.visible_html(F.col("html"))
    if needed("pages", "contacts"):
        parts["raw_text"] = P.main_text_of_html()
    if needed("contacts", "links"):
        parts["anchors"] = P.anchors_of_html()
    if needed("contacts", "products", "org"):
        parts["walks"] = S.walks_of_html()
    base = pages.select("site", "url", "html", F.explode(F.array(F.struct(*[c.alias(k) for k, c in parts.items()]))).alias("x")) \
        .select("site", "url", "html", "x.*")
    if mentions:
        any_of = mentions[0]
        for m in mentions[1:]:
            any_of = any_of | m
        base = with_elements(base, any_of)
    if needed("links"):
        base = base.select("*", F.explode(F.array(P.link_targets())).alias("targets"))
    columns = {}
    if needed("pages"):
        columns["pages"] = F.struct(P.head_of_markup().alias("head"), F.col("raw_text"), F.col("scraped_at"))
    if needed("contacts"):
        addresses = F.transform(F.when(blocks.mentions_address(), blocks.address_texts()),
                                lambda t: F.struct(F.lit("address").alias("type"), t.alias("value")))
        columns["contacts"] = F.array_distinct(F.concat(*[_rows(c.cast(CONTACTS), CONTACTS) for c in (
            P.contact_values(F.col("raw_text")), addresses, P.social_values(), S.contact_rows())]))
    if needed("services"):
        columns["services"] = _rows(F.when(blocks.mentions_service(), blocks.service_rows()).cast(SERVICES), SERVICES)
    if needed("products"):
        columns["products"] = F.struct(S.product_rows().alias("structured"), _rows(
            F.when(blocks.mentions_card(), blocks.card_rows()), CARDS).alias("cards"))
    if needed("links"):
        columns["links"] = P.first_targets()
    if needed("org"):
        columns["org"] = S.org_rows()
    return base.select("site", "url", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("x")) \
        .select("site", "url", "x.*")


def pages_table(facts: DataFrame) -> DataFrame:
    return facts.select("site", "url", "pages.head.*", "pages.raw_text", "pages.scraped_at")


def contacts_table(facts: DataFrame) -> DataFrame:
    return facts.select("site", F.col("url").alias("page_url"), F.explode("contacts").alias("c")).select("site", "page_url", "c.type", "c.value")


def services_table(facts: DataFrame) -> DataFrame:
    return facts.select("site", F.col("url").alias("page_url"), F.explode("services").alias("r")).select(
        "site", "page_url", "r.name", "r.description")


def links_table(facts: DataFrame) -> DataFrame:
    return facts.select("site", F.col("url").alias("from_url"), F.explode("links").alias("l")).select("site", "from_url", "l.to_url", "l.text")


def org_table(facts: DataFrame) -> DataFrame:
    return S.org_table(facts.select("site", "url", F.explode("org").alias("r")).select("site", "r.key", "r.value", "url", "r.seq"))


def product_tables(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products of JSON-LD and of cards."""
    def table(array: str, origin: str) -> DataFrame:
        rows = facts.select("site", F.col("url").alias("source_url"), F.explode(f"products.{array}").alias("r"))
        return S.product_table(rows.select("site", "source_url", "r", "r.seq"), origin)

    return table("structured", "jsonld"), table("cards", "card")
