"""Entities from JSON-LD blocks and from landed JSON API responses (narrow jobs)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.html import jsonld_bodies
from ..functions.prices import price_and_currency
from ..functions.text import built_once, clean_text, let
from ..functions.urls import classify_social, site_of
from .keys import last_wins, order_number

PRODUCT_COLUMNS = (
    "site", "source_url", "name", "price", "old_price", "currency", "sku", "brand", "category",
    "description", "image_url", "product_url", "in_stock", "origin", "seq",
)

# JSON-LD types and the field names under which APIs publish products.
PRODUCT_TYPES = ("Product", "IndividualProduct")
ORG_TYPES = ("Organization", "LocalBusiness", "Store", "Company")
API_ALIASES: Mapping[str, Sequence[str]] = {
    "name": ("name", "title", "product_name", "label", "наименование"),
    "price": ("price", "cost", "amount", "цена", "price_value"),
    "old_price": ("old_price", "price_old", "compare_price"),
    "sku": ("sku", "article", "artikul", "code", "id", "product_id"),
    "description": ("description", "desc", "text", "about"),
    "image_url": ("image", "img", "picture", "photo", "src", "image_url", "preview"),
    "product_url": ("url", "link", "href", "product_url", "detail_url"),
    "brand": ("brand", "producer", "manufacturer", "vendor"),
    "category": ("category", "section", "group", "type"),
    "in_stock": ("in_stock", "available", "quantity", "qty", "stock"),
}

def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _node_type(node: Column) -> Column:
    return V.string_at(node, '$["@type"]')


def _is_product(node: Column) -> Column:
    return F.coalesce(_node_type(node).isin(*PRODUCT_TYPES), F.lit(False))


def _is_org(node: Column) -> Column:
    return F.coalesce(_node_type(node).isin(*ORG_TYPES), F.lit(False))


def jsonld_blocks(pages: DataFrame) -> DataFrame:
    """(site, url, block_no, body): valid JSON-LD script bodies."""
    return pages.select("site", "url", F.posexplode(jsonld_bodies(F.col("html"))).alias("block_no", "body")) \
        .where(F.try_parse_json("body").isNotNull())


def _enter(v: Column) -> Column:
    """A product without a name is not entered."""
    return ~(_is_product(v) & (clean_text(V.string_at(v, "$.name")) == ""))


def _walked(pages: DataFrame, max_depth: int | None) -> DataFrame:
    """(site, url, walks): the walk of every JSON-LD block of a page."""
    walks = F.transform(jsonld_bodies(F.col("html")), lambda b: V.json_objects(b, max_depth, _enter))
    return pages.select("site", "url", walks.alias("walks"))


def _numbered() -> Column:
    """array<struct(seq, depth, node)>: objects of all blocks in block and level order."""
    return F.flatten(F.transform("walks", lambda w, i: F.transform(
        w["objects"],
        lambda o, j: F.struct(
            order_number(i, j).alias("seq"), o["depth"].alias("depth"), o["node"].alias("node")))))


def json_nodes(pages: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(site, url, seq, depth, type, node): every object of every JSON-LD block.

    The array is exploded as an expression: exploding a column of it would let the optimizer
    add an emptiness filter that walks the documents again.
    """
    return _walked(pages, max_depth).select("site", "url", F.explode(_numbered()).alias("o")).select(
        "site", "url", "o.seq", "o.depth", _node_type(F.col("o.node")).alias("type"), "o.node")


def json_nodes_cut(pages: DataFrame, max_depth: int) -> DataFrame:
    """(site, url, cut): containers below ``max_depth`` per page, 0 when the walk is complete."""
    cut = F.aggregate("walks", F.lit(0), lambda a, w: a + w["cut"])
    return _walked(pages, max_depth).select("site", "url", cut.alias("cut"))


def jsonld_products(pages: DataFrame) -> DataFrame:
    """Product rows of JSON-LD Product nodes."""
    row = F.struct(*[c.alias(k) for k, c in _product_fields(F.col("node")).items()])
    rows = json_nodes(pages).where(_is_product(F.col("node"))).select("site", F.col("url").alias("source_url"), F.explode(F.array(row)).alias("r"), "seq")
    return product_table(rows.where("r.name <> ''"), "jsonld")


def product_table(rows: DataFrame, origin: str) -> DataFrame:
    """Product rows from (site, source_url, r, seq); fields that ``r`` lacks are empty."""
    given = set(rows.schema["r"].dataType.names)
    fields = [c for c in PRODUCT_COLUMNS if c not in ("site", "source_url", "origin", "seq")]
    return rows.select("site", "source_url", *[(F.col(f"r.{c}") if c in given else F.lit("")).alias(c) for c in fields],
                       F.lit(origin).alias("origin"), "seq").select(*PRODUCT_COLUMNS)


def _product_fields(n: Column) -> dict[str, Column]:
    image_item = F.coalesce(V.string_at(n, "$.image"), V.string_at(n, "$.image[0]"),
                            V.string_at(n, "$.image.url"), V.string_at(n, "$.image[0].url"))
    sku = F.when(V.node_at(n, "$.sku").isNotNull(), V.scalar_text(n, "$.sku")).otherwise(V.scalar_text(n, "$.productID"))
    return {
        "name": clean_text(V.string_at(n, "$.name")),
        "price": _text(F.coalesce(V.scalar_text(n, "$.offers.price"), V.scalar_text(n, "$.offers[0].price"))),
        "currency": _text(F.coalesce(V.scalar_text(n, "$.offers.priceCurrency"), V.scalar_text(n, "$.offers[0].priceCurrency"))),
        "sku": _text(sku),
        "brand": clean_text(F.coalesce(V.string_at(n, "$.brand.name"), V.string_at(n, "$.brand"))),
        "description": clean_text(V.string_at(n, "$.description")),
        "image_url": _text(image_item),
    }


@built_once
def walks_of_html() -> Column:
    """The walk of every JSON-LD block of ``html``."""
    return F.transform(jsonld_bodies(F.col("html")), lambda b: V.json_objects(b, None, _enter))


@built_once
def product_rows() -> Column:
    """array<struct(seq, ...)> of the products in ``walks``."""
    found = F.filter(_numbered(), lambda o: _is_product(o["node"]))
    rows = F.transform(found, lambda o: F.struct(o["seq"].alias("seq"), *[c.alias(k) for k, c in _product_fields(o["node"]).items()]))
    return F.filter(rows, lambda r: r["name"] != "")


@built_once
def org_rows() -> Column:
    """array<struct(seq, key, value)> of the organizations in ``walks``."""
    found = F.filter(_numbered(), lambda o: _is_org(o["node"]))
    return F.flatten(F.transform(found, lambda o: F.transform(
        F.filter(_org_facts(o["node"]), lambda f: f["given"]),
        lambda f: F.struct(o["seq"].alias("seq"), f["key"].alias("key"), f["value"].alias("value")))))


@built_once
def contact_rows() -> Column:
    """array<struct(type, value)> of the organizations in ``walks``."""
    orgs = F.filter(_numbered(), lambda o: _is_org(o["node"]))
    return F.flatten(F.transform(orgs, lambda o: _org_contacts(o["node"])))


def _org_facts(n: Column) -> Column:
    return F.array(*[F.struct(F.lit(key).alias("key"), clean_text(V.string_at(n, path)).alias("value"),
                              (_text(V.string_at(n, path)) != "").alias("given"))
                     for key, path in (("org_name", "$.name"), ("org_description", "$.description"))])


def jsonld_org(pages: DataFrame) -> DataFrame:
    """(site, key, value): org_name and org_description per site, the last (url, seq) wins."""
    rows = json_nodes(pages).where(_is_org(F.col("node"))).select("site", "url", "seq", F.explode(_org_facts(F.col("node"))).alias("f")) \
        .where("f.given").select("site", "f.key", "f.value", "url", "seq")
    return org_table(rows)


def org_table(rows: DataFrame) -> DataFrame:
    """(site, key, value) from rows with url and seq: the last one wins."""
    return last_wins(rows, ["site", "key"], ["url", "seq"]).select("site", "key", "value")


def _strings_of(v: Column, path: str) -> Column:
    """A string, or the strings of a list, as array<string>."""
    one = V.string_at(v, path)
    many = F.filter(
        F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: V.string_at(x, "$")), lambda x: x.isNotNull())
    return F.coalesce(F.when(one.isNotNull(), F.array(one)), many, F.array().cast("array<string>"))


def _org_contacts(n: Column) -> Column:
    def typed(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("value")))

    def some(c: Column) -> Column:
        return F.filter(F.array(c), lambda x: x.isNotNull() & (x != ""))

    parts = [V.string_at(n, f"$.address.{k}")
             for k in ("streetAddress", "addressLocality", "postalCode", "addressCountry")]
    address = F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])
    socials = F.flatten(F.transform(_strings_of(n, "$.sameAs"), lambda x: classify_social(x)))
    return F.concat(
        typed("phone", F.transform(_strings_of(n, "$.telephone"), clean_text)),
        F.transform(some(V.string_at(n, "$.email")),
                    lambda e: F.struct(F.lit("email").alias("type"), clean_text(e).alias("value"))),
        typed("address", some(address)), socials)


def jsonld_contacts(pages: DataFrame) -> DataFrame:
    """(site, page_url, type, value) of JSON-LD organizations."""
    return _walked(pages, None).select("site", F.col("url").alias("page_url"), F.explode(F.array_distinct(contact_rows())).alias("c")) \
        .select("site", "page_url", "c.type", "c.value")


def api_nodes_cut(responses: DataFrame, max_depth: int) -> DataFrame:
    """(trigger_url, api_url, cut): containers below ``max_depth`` per response, 0 when the walk is complete."""
    return responses.select("trigger_url", "api_url", V.json_objects(F.col("body"), max_depth)["cut"].alias("cut"))


def products_per_response(responses: DataFrame, products: DataFrame) -> DataFrame:
    """(trigger_url, products): how many products the responses of each page gave, 0 included."""
    counts = products.groupBy(F.col("source_url").alias("trigger_url")).agg(F.count(F.lit(1)).alias("products"))
    return responses.select("trigger_url").distinct().join(counts, "trigger_url", "left").select(
        "trigger_url", F.coalesce("products", F.lit(0)).alias("products"))


def ignored_nodes(pages: DataFrame) -> DataFrame:
    """(site, list_types, text_addresses): JSON-LD nodes that the extractors pass over, per site.

    A list-valued @type never names a product or an organization, and an address counts only as an object.
    """
    n = F.col("node")
    listed = F.coalesce(F.schema_of_variant(V.node_at(n, '$["@type"]')).startswith("ARRAY"), F.lit(False))
    return json_nodes(pages).groupBy("site").agg(
        F.count_if(listed).alias("list_types"),
        F.count_if(_is_org(n) & V.string_at(n, "$.address").isNotNull()).alias("text_addresses"))


def api_products(responses: DataFrame, aliases: Mapping[str, Sequence[str]] = API_ALIASES,
                 max_depth: int | None = None) -> DataFrame:
    """Product rows of every object with a usable name in API response bodies.

    ``responses`` has trigger_url, body and fetched_at; products belong to the page that
    triggered the call. With ``max_depth`` objects below it are left out; ``api_nodes_cut`` counts them.
    """
    objects = F.posexplode(V.json_objects(F.col("body"), max_depth)["objects"]).alias("idx", "o")
    rows = responses.select(F.col("trigger_url").alias("source_url"), "fetched_at", objects)
    n = F.col("node")
    raw = rows.select(
        "source_url", F.col("o.node").alias("node"),
        order_number(F.unix_seconds("fetched_at"), F.col("idx")).alias("seq")
    ).withColumn("name", clean_text(V.first_string(n, aliases["name"], non_blank=True))).where(F.length("name") > 1)
    category = V.first_present(n, aliases["category"])
    price_raw = _text(V.scalar_text(V.first_present(n, aliases["price"])))
    priced = let(price_raw, lambda p: let(price_and_currency(p), lambda pc: F.struct(
        F.when(pc["price"] == "", p).otherwise(pc["price"]).alias("price"), pc["currency"].alias("currency"))))
    return raw.select(
        site_of(F.col("source_url")).alias("site"), "source_url", "name", priced.alias("_p"),
        _text(V.scalar_text(V.first_present(n, aliases["old_price"]))).alias("old_price"),
        _text(V.first_non_blank(n, aliases["sku"])).alias("sku"),
        clean_text(V.first_string(n, aliases["brand"])).alias("brand"),
        clean_text(F.coalesce(V.string_at(category, "$"), V.string_at(category, "$.name"))).alias("category"),
        clean_text(V.first_string(n, aliases["description"])).alias("description"),
        _text(V.first_string(n, aliases["image_url"])).alias("image_url"),
        _text(V.first_string(n, aliases["product_url"])).alias("product_url"),
        _text(V.scalar_text(V.first_present(n, aliases["in_stock"]))).alias("in_stock"),
        F.lit("api").alias("origin"), "seq",
    ).withColumns({"price": F.col("_p.price"), "currency": F.col("_p.currency")}).select(*PRODUCT_COLUMNS)
