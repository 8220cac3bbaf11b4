"""Entities that need element containment: addresses, services, product cards, next-page links.

Pages are first narrowed by a plain text test that every possible hit passes, so elements are built for
candidate pages only. All of it works on one row per page, and only finished entities leave the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.prices import price_and_currency
from ..functions.text import built_once, clean_text, let
from ..functions.urls import normalize_url, resolve_url
from . import dom as D
from .keys import order_number
from .structured import product_table

# Markup that marks addresses, services, product cards and pagination.
ADDRESS_CLASS = r"(?iu)address|location"
ADDRESS_MIN_CHARS = 10
SERVICE_CLASS = r"(?iu)service|услуг|advantage"
SERVICE_NAME_MIN = 2
TEMPLATE_CARDS = ("catalog-block-view__item", "catalog-block-view-item")
TEMPLATE_NAME_CLASS = r"(?iU)\bitem.?title\b|\bname\b"
TEMPLATE_CURRENCY = "₽"
TEMPLATE_MARK = "catalog-block-view"
CARD_CLASSES = ("catalog-item", "product-card", "product-item", "goods-item", "item-card")
CARD_CLASS_PARTS = ("product-card", "catalog-item")
CARD_ITEMTYPE = "schema.org/Product"
CARD_NAME_CLASS = r"(?iu)name|title"
CARD_PRICE_CLASS = r"(?iu)price(?!.*old)|cost"
CARD_OLD_PRICE_CLASS = r"(?iu)old.?price|price.?old|crossed"
NAME_MIN_CHARS = 2
HEADINGS = ("h2", "h3", "h4", "h5")
NEXT_WORDS = ("»", "›", "следующая", "далее", "next", "вперёд")


def _page_url() -> Column:
    return F.col("url")


def _text(node: Column) -> Column:
    return clean_text(D.node_text(F.col("toks"), node))


def _per_outer(outers: Column, fields) -> Column:
    """array<struct>: ``fields(outer, descendants)`` for each outer element."""
    return F.transform(outers, lambda o: let(
        D.inside(F.col("els"), o), lambda els: F.struct(*[c.alias(n) for n, c in fields(o, els).items()])))


def _first_by_name(rows: Column, min_chars: int) -> Column:
    """First row per name of one page; ``name`` and ``seq`` are the leading struct fields.

    After sorting by (name, seq) the winner leads its run, so the key rule needs no shuffle.
    """
    usable = F.array_sort(F.filter(rows, lambda r: F.length(r["name"]) >= min_chars))
    return let(usable, lambda u: F.filter(
        u, lambda r, i: (i == 0) | (r["name"] != F.element_at(u, F.greatest(i, F.lit(1)))["name"])))


def page_addresses(pages: DataFrame) -> DataFrame:
    """(site, page_url, type, value): first address tag, itemprop and address-like class per page."""
    dom = D.page_dom(pages.where(mentions_address()))
    return dom.select("site", F.col("url").alias("page_url"), F.lit("address").alias("type"), F.explode(address_texts()).alias("value"))


def mentions_address() -> Column:
    return F.col("html").rlike(ADDRESS_CLASS)


@built_once
def address_texts() -> Column:
    els = F.col("els")
    firsts = F.array(
        D.first_match(els, lambda e: e["tag"] == "address"),
        D.first_match(els, lambda e: D.has_attr(e, "itemprop", "address")),
        D.first_match(els, lambda e: D.class_like(e, ADDRESS_CLASS)))
    return F.filter(F.array_distinct(F.transform(firsts, _text)), lambda t: F.length(t) > ADDRESS_MIN_CHARS)


def page_services(pages: DataFrame) -> DataFrame:
    """(site, page_url, name, description): first heading and paragraph of service-like blocks."""
    dom = D.page_dom(pages.where(mentions_service()))
    return dom.select("site", F.col("url").alias("page_url"), F.explode(service_rows()).alias("r")) \
        .select("site", "page_url", "r.name", "r.description")


def mentions_service() -> Column:
    return F.col("html").rlike(SERVICE_CLASS)


@built_once
def service_rows() -> Column:
    """array<struct(name, seq, description)>"""
    sections = D.matching(F.col("els"), lambda e: e["tag"].isin("section", "div") & D.class_like(e, SERVICE_CLASS))
    rows = _per_outer(sections, lambda o, els: {
        "name": _text(D.first_match(els, lambda e: e["tag"].isin(*HEADINGS))), "seq": o["s"],
        "description": _text(D.first_match(els, lambda e: e["tag"] == "p"))})
    return _first_by_name(rows, SERVICE_NAME_MIN + 1)


def _image_url(node: Column) -> Column:
    src = F.coalesce(F.nullif(H.attr(node["tok"], "data-src"), F.lit("")), H.attr(node["tok"], "src"), F.lit(""))
    return F.when(node.isNotNull(), resolve_url(_page_url(), src)).otherwise(F.lit(""))


def _link_url(node: Column) -> Column:
    href = F.coalesce(H.attr(node["tok"], "href"), F.lit(""))
    return F.when(node.isNotNull(), resolve_url(_page_url(), href)).otherwise(F.lit(""))


def _is_link(e: Column) -> Column:
    return (e["tag"] == "a") & D.has_attr(e, "href")


def _is_dark_link(e: Column) -> Column:
    return (e["tag"] == "a") & D.has_class(e, "dark_link")


def _template_prices(els: Column) -> Column:
    """Price blocks of a card that hold an amount: array<struct(discount, amount, currency)>."""
    def block(b: Column) -> Column:
        return let(D.inside(els, b), lambda inner: let(
            D.first_match(inner, lambda e: D.has_class(e, "price_value")), lambda amount: F.when(
                amount.isNotNull(), F.struct(
                    D.class_contains(b, "discount").alias("discount"),
                    F.regexp_replace(_text(amount), " ", "").alias("amount"),
                    let(D.first_match(inner, lambda e: D.has_class(e, "price_currency")),
                        lambda c: F.when(c.isNotNull(), _text(c))).alias("currency")))))

    return F.filter(F.transform(D.matching(els, lambda e: D.has_class(e, "price")), block), lambda b: b.isNotNull())


CARD_FIELDS = "name string, seq struct<document:bigint,item:bigint>, price string, old_price string, currency string, sku string, " \
    "image_url string, product_url string, in_stock string"
NO_CARDS = f"array<struct<{', '.join(f.replace(' ', ':') for f in CARD_FIELDS.split(', '))}>>"


@built_once
def _template_rows() -> Column:
    def name(els: Column) -> Column:
        return _text(F.coalesce(
            D.first_match(els, lambda e: D.has_class(e, "item-title")), D.first_match(els, _is_dark_link),
            D.first_match(els, lambda e: D.class_like(e, TEMPLATE_NAME_CLASS))))

    def stock(els: Column) -> Column:
        boxes = D.matching(els, lambda e: D.has_class(e, "item-stock"))
        return _text(D.first_match(els, lambda e: D.has_class(e, "sa_block") | (
            D.has_class(e, "value") & F.exists(boxes, lambda b: (e["s"] > b["s"]) & (e["s"] <= b["e"])))))

    def fields(o: Column, els: Column) -> dict[str, Column]:
        return {
            "name": name(els), "seq": order_number(F.lit(0), o["s"]), "blocks": _template_prices(els),
            "sku": F.coalesce(H.attr(o["tok"], "data-id"), F.lit("")),
            "image_url": let(D.first_match(els, lambda e: e["tag"] == "img"), _image_url),
            "product_url": let(F.coalesce(D.first_match(els, _is_dark_link), D.first_match(els, _is_link)), _link_url),
            "in_stock": stock(els)}

    def finished(r: Column) -> Column:
        amounts = F.filter(r["blocks"], lambda b: ~b["discount"] & (b["amount"] != ""))
        discounts = F.filter(r["blocks"], lambda b: b["discount"])
        currencies = F.filter(r["blocks"], lambda b: b["currency"].isNotNull())
        empty = F.lit("")
        return F.struct(
            r["name"].alias("name"), r["seq"].alias("seq"),
            F.coalesce(F.try_element_at(amounts, F.lit(1))["amount"], empty).alias("price"),
            F.coalesce(F.try_element_at(discounts, F.lit(-1))["amount"], empty).alias("old_price"),
            F.coalesce(F.try_element_at(currencies, F.lit(-1))["currency"], F.lit(TEMPLATE_CURRENCY)).alias("currency"),
            *[r[c].alias(c) for c in ("sku", "image_url", "product_url", "in_stock")])

    cards = D.matching(F.col("els"), lambda e: D.has_class(e, *TEMPLATE_CARDS))
    return _first_by_name(F.transform(_per_outer(cards, fields), finished), NAME_MIN_CHARS)


@built_once
def _generic_rows() -> Column:
    rules = [*[lambda e, c=c: D.has_class(e, c) for c in CARD_CLASSES],
             *[lambda e, p=p: D.class_contains(e, p) for p in CARD_CLASS_PARTS],
             lambda e: D.has_attr(e, "itemtype", contains=CARD_ITEMTYPE)]

    def selector_no(e: Column) -> Column:
        return F.coalesce(*[F.when(r(e), i) for i, r in enumerate(rules)])

    def text_of(els: Column, *choices) -> Column:
        return _text(F.coalesce(*[D.first_match(els, c) for c in choices]))

    def fields(o: Column, els: Column) -> dict[str, Column]:
        price = price_and_currency(text_of(
            els, lambda e: D.has_attr(e, "itemprop", "price"), lambda e: D.class_like(e, CARD_PRICE_CLASS)))
        return {
            "name": text_of(els, lambda e: D.has_attr(e, "itemprop", "name"), lambda e: e["tag"].isin(*HEADINGS),
                            lambda e: D.class_like(e, CARD_NAME_CLASS)),
            "seq": order_number(selector_no(o), o["s"]), "p": price,
            "old_price": text_of(els, lambda e: D.class_like(e, CARD_OLD_PRICE_CLASS)),
            "image_url": let(D.first_match(els, lambda e: e["tag"] == "img"), _image_url),
            "product_url": let(D.first_match(els, _is_link), _link_url)}

    def finished(r: Column) -> Column:
        empty = F.lit("")
        return F.struct(
            r["name"].alias("name"), r["seq"].alias("seq"), r["p"]["price"].alias("price"), r["old_price"].alias("old_price"),
            r["p"]["currency"].alias("currency"), empty.alias("sku"), r["image_url"].alias("image_url"),
            r["product_url"].alias("product_url"), empty.alias("in_stock"))

    cards = D.matching(F.col("els"), lambda e: selector_no(e).isNotNull())
    return _first_by_name(F.transform(_per_outer(cards, fields), finished), NAME_MIN_CHARS)


def _card_products(dom: DataFrame, rows: Column) -> DataFrame:
    return product_table(dom.select("site", F.col("url").alias("source_url"), F.explode(rows).alias("r"))
                         .select("site", "source_url", "r", "r.seq"), "card")


def _mentions_generic() -> Column:
    return F.col("html").rlike("|".join(m.replace(".", r"\.") for m in (*CARD_CLASSES, CARD_ITEMTYPE)))


def _mentions_template() -> Column:
    return F.col("html").contains(TEMPLATE_MARK)


def template_cards(pages: DataFrame) -> DataFrame:
    """Product rows of the shop-template card markup."""
    return _card_products(D.page_dom(pages.where(_mentions_template())), _template_rows())


def generic_cards(pages: DataFrame) -> DataFrame:
    """Product rows of common card markup, on pages where the template markup gave none."""
    dom = D.page_dom(pages.where(_mentions_generic()))
    none = F.array().cast(NO_CARDS)
    return _card_products(dom, F.when(F.size(_template_rows()) == 0, _generic_rows()).otherwise(none))


def html_products(pages: DataFrame) -> DataFrame:
    """Template cards, and generic cards on the pages without template cards, in one pass."""
    return _card_products(D.page_dom(pages.where(mentions_card())), card_rows())


def mentions_card() -> Column:
    return _mentions_template() | _mentions_generic()


@built_once
def card_rows() -> Column:
    """array<struct> of ``CARD_FIELDS``: template cards, else generic cards."""
    return let(_template_rows(), lambda t: F.when(F.size(t) > 0, t.cast(NO_CARDS)).otherwise(_generic_rows().cast(NO_CARDS)))


def next_page(pages: DataFrame) -> DataFrame:
    """(site, url, next_url): the page that continues this one.

    rel=next and link-text rules read the page row; only pages with a pagination block that
    mentions 'next' are exploded for the two containment rules. The choice is one small aggregate.
    """
    links = pages.select("site", "url", H.visible_html(F.col("html")).alias("_m")).select(
        "site", "url",
        F.filter(F.regexp_extract_all("_m", F.lit(rf"(?is)(?=<a[\s/>]){H.TAG}"), F.lit(0)),
                 lambda t: H.attr(t, "rel") == "next").alias("rel"),
        F.filter(H.anchors(F.col("_m")), lambda a: F.lower(a["text"]).isin(*NEXT_WORDS)).alias("worded"))
    quick = links.select("site", "url", F.explode(F.array(
        F.struct(F.lit(0).alias("rule"), H.attr(F.try_element_at("rel", F.lit(1)), "href").alias("href")),
        F.struct(F.lit(3).alias("rule"), F.try_element_at("worded", F.lit(1))["href"].alias("href")))).alias("c"))

    dom = D.page_dom(pages.where(F.col("html").rlike(r"paginat") & F.col("html").contains("next")))
    els = F.col("els")
    boxes = {1: lambda e: D.has_class(e, "pagination"), 2: lambda e: D.class_contains(e, "paginat")}
    boxed = dom.select("site", "url", F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), H.attr(
            D.first_match(D.inside_any(els, D.matching(els, box)), lambda e: D.has_class(e, "next"))["tok"], "href").alias("href"))
        for rule, box in boxes.items()])).alias("c"))
    best = quick.unionByName(boxed).where(F.col("c.href").isNotNull() & ((F.col("c.href") != "") | (F.col("c.rule") == 3)))
    return best.groupBy("site", "url").agg(F.min("c").alias("c")).select(
        "site", "url", normalize_url(resolve_url(F.col("url"), F.col("c.href"))).alias("next_url"))
