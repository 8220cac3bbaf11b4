"""Markup inspection: which classes, prices and cards a site uses."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import decode_entities, let, strip_text
from . import dom as D
from .groups import top_per_group

# The two inspection variants.
CATALOG_TAGS = ("div", "article", "li", "section")
CATALOG_PRICE = r"(?U)руб|₽|\d{3,}"
CATEGORY_PRICE = r"(?U)₽|руб|\d{3,}\s*(р|₽)"
PRICE_CLASS = "price_value"
CARD_CLASS = "catalog-block-view__item"


def class_frequency(pages: DataFrame, tags=CATALOG_TAGS, top: int = 40, above: int = 2) -> DataFrame:
    """(site, class, n): the ``top`` most frequent class names per site, of these the ones above a count.

    Class names are counted from the page row, those inside svg and noscript included; only (site, class, count)
    rows are shuffled.
    """
    opens = F.filter(
        H.html_token_array(F.col("html"), raw_blocks=False),
        lambda t: t.rlike(r"^<[a-zA-Z]") & (H.token_tag(t).isin(*tags) if tags else F.lit(True)))
    names = F.flatten(F.transform(opens, H.class_list))
    counts = pages.select("site", F.explode(names).alias("class")).groupBy("site", "class").agg(F.count(F.lit(1)).alias("n"))
    ranked = top_per_group(counts, ["site"], [F.desc("n"), F.asc("class")], top)
    return ranked.where(F.col("n") > above).select("site", "class", "n")


def price_like_nodes(pages: DataFrame, pattern: str = CATALOG_PRICE, need_class: bool = True) -> DataFrame:
    """(site, url, pos, tag, classes, text): price-like text nodes with their parent element."""
    dom = D.page_dom(pages.where(F.col("html").rlike(pattern)), raw_blocks=False)
    places = F.filter(F.transform("toks", lambda t, i: F.when(
        ~t.rlike(r"^<[a-zA-Z/!?]") & decode_entities(t).rlike(pattern), i)), lambda i: i.isNotNull())
    # the page's tokens and elements must not be repeated for every row, so nodes are finished before they are exploded
    nodes = F.transform("inner", lambda n: let(F.get("els", n["i"] - 1), lambda p: F.struct(
        n["pos"].alias("pos"), p["tag"].alias("tag"), F.array_join(p["classes"], " ").alias("classes"),
        strip_text(decode_entities(F.get("toks", n["pos"]))).alias("text"))))
    out = D.innermost(dom, places).select("site", "url", F.explode(nodes).alias("n")).select("site", "url", "n.*")
    return out.where(F.col("classes") != "") if need_class else out


def catalog_selectors() -> Mapping[str, D.Predicate]:
    return {"item, product or card": lambda e: D.class_contains(e, "item") | D.class_contains(e, "product") | D.class_contains(e, "card")}


def category_selectors() -> Mapping[str, D.Predicate]:
    return {".item": lambda e: D.has_class(e, "item"), ".product": lambda e: D.has_class(e, "product"),
            "[class*='item']": lambda e: D.class_contains(e, "item"), "article": lambda e: e["tag"] == "article"}


def selector_samples(pages: DataFrame, selectors: Mapping[str, D.Predicate], k: int = 5, width: int | None = None,
                     skip_blank: bool = False) -> DataFrame:
    """(site, selector, rank, url, tag, classes, text): the first k elements per site and selector.

    A page contributes at most its own first k elements, so little is left to rank per site. Texts are whole
    unless ``width`` is given.
    """
    def shown(text: Column) -> Column:
        return text if width is None else F.left(text, F.lit(width))

    def samples(name: str, predicate: D.Predicate) -> Column:
        first = F.slice(D.matching(F.col("els"), predicate), 1, k)
        return F.transform(first, lambda e: F.struct(
            F.lit(name).alias("selector"), e["s"].alias("at"), e["tag"].alias("tag"),
            F.array_join(e["classes"], " ").alias("classes"),
            F.replace(strip_text(shown(D.node_text(F.col("toks"), e))), F.lit("\n"), F.lit(" ")).alias("text")))

    hits = D.page_dom(pages, raw_blocks=False).select(
        "site", "url", F.explode(F.concat(*[samples(n, p) for n, p in selectors.items()])).alias("h")
    ).select("site", "url", "h.*")
    first = top_per_group(hits, ["site", "selector"], [F.asc("url"), F.asc("at")], k)
    out = first.select("site", "selector", "rank", "url", "tag", "classes", "text")
    return out.where(F.col("text") != "") if skip_blank else out


def card_structure(pages: DataFrame, card_class: str = CARD_CLASS, price_class: str = PRICE_CLASS) -> DataFrame:
    """(site, url, start_pos, tag, classes, text): inside of the first card that holds a price, per page."""
    dom = D.page_dom(pages.where(F.col("html").contains(card_class) & F.col("html").contains(price_class)))
    els = F.col("els")
    prices = D.matching(els, lambda e: D.has_class(e, price_class))
    card = D.first_match(els, lambda e: D.has_class(e, card_class) & F.exists(
        prices, lambda p: (p["s"] > e["s"]) & (p["s"] <= e["e"])))
    shown = let(card, lambda c: F.filter(D.inside(els, c), lambda e: F.size(e["classes"]) > 0))
    out = D.explode_nodes(dom, shown, "").withColumn("text", strip_text(F.col("text")))
    return out.where(F.col("text") != "").select(
        "site", "url", "start_pos", "tag", F.array_join("classes", " ").alias("classes"), "text")
