"""The main plan: landed pages and API responses to entity tables, profile and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, facts, pages as P, profile, structured
from ..operators.keys import merge_products
from ..sources import landed
from ..sources.pages import latest_pages
from ..sources.tables import stored_rows


@dataclass
class Entities:
    """One lazy DataFrame per entity table."""

    pages: DataFrame | None
    contacts: DataFrame | None
    products: DataFrame | None
    services: DataFrame | None
    links: DataFrame | None
    api_responses: DataFrame
    org: DataFrame | None

    def profile(self) -> DataFrame:
        return profile.site_profile(self.pages, self.contacts, self.org)

    def sections(self) -> dict[str, DataFrame]:
        """Report sections; API calls without their bodies."""
        return {"pages": self.pages, "contacts": self.contacts, "products": self.products, "services": self.services,
                "api_calls": self.api_responses}


def all_contacts(pages: DataFrame) -> DataFrame:
    """Contacts of every kind, one row per (site, page_url, type, value)."""
    return P.page_contacts(pages).unionByName(blocks.page_addresses(pages)).unionByName(P.page_socials(pages)) \
        .unionByName(structured.jsonld_contacts(pages)).distinct()


def build_entities(pages: DataFrame, responses: DataFrame, kinds: Sequence[str] = facts.KINDS) -> Entities:
    """Entity tables of the last delivery of every page, and of all API responses.

    The pages are parsed once: what all tables need is stored in the shared folder, one row per page, and each table is a
    read of its own column. So the markup is shuffled at most once, to find the last deliveries. Tables of other kinds than
    the given ones are None.
    """
    found = stored_rows(facts.page_facts(latest_pages(pages), kinds), "facts")
    tables = {"pages": facts.pages_table, "contacts": facts.contacts_table, "services": facts.services_table,
              "links": facts.links_table, "org": facts.org_table}
    built = {k: table(found) if k in kinds else None for k, table in tables.items()}
    products = merge_products(structured.api_products(landed.json_responses(responses)), *facts.product_tables(found)) if "products" in kinds else None
    return Entities(products=products, api_responses=landed.api_responses(responses), **built)


def store_entities(entities: Entities, path: str) -> Entities:
    """Write the entity tables and return them read back.

    Profile and reports read every table several times; from storage that costs a scan, from
    the lazy plans it would parse the pages again each time.
    """
    def stored(name: str) -> DataFrame:
        df = getattr(entities, name)
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    return Entities(**{f.name: stored(f.name) for f in fields(Entities)})


def link_profile(pages: DataFrame) -> DataFrame:
    """(site, pages, home_url, home_title, out_links): first look at landed sites.

    Head fields and links come from the page row; per site only partial aggregates are shuffled.
    """
    heads = P.head_fields(pages)
    home = profile.home_page(heads).select("site", F.col("url").alias("home_url"), F.col("title").alias("home_title"))
    counts = profile.crawl_summary(heads)
    links = P.page_links(pages).select("site", "to_url").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("out_links"))
    return home.join(counts, "site").join(links, "site", "left").select(
        "site", "pages", "home_url", "home_title", F.coalesce("out_links", F.lit(0)).alias("out_links"))
