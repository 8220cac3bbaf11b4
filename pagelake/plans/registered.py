"""Queries over the driver tables, one per operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H, prices, text as T, urls as U
from ..operators import blocks, dom, facts, graph, inspect as I, keys, pages as P, profile as R, structured as S, translate as L
from ..session import configure
from ..sources import landed, reports, tables
from ..sources.pages import dealt, read_pages, scan_pages, spread
from ..streaming import jobs
from . import fixtures as X
from .site_build import all_contacts, build_entities, link_profile

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    _registry[fn.__name__] = run
    return fn


def registered() -> dict[str, Query]:
    return dict(_registry)


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    return scan_pages(X.texts(spark, d, "pages"))


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    return X.texts(spark, d, "documents")


def shop_entities(spark: SparkSession, d: str, kinds=facts.KINDS):
    """Entities of the shop sites: landed listing pages and their API calls."""
    return build_entities(landed_pages(spark, X.shop_pages(spark, d)), X.api_landed(X.shop_parts(spark, d)), kinds)


def all_entities(spark: SparkSession, d: str, kinds=facts.KINDS):
    """Entities of all sites: the given pages and every derived one at its own address, and the API calls of the shops."""
    pages = pages_of(spark, d).select("url", "html")
    for derived in (X.shop_pages, X.jsonld_pages, X.org_pages, X.service_pages, X.furniture_pages):
        pages = pages.unionByName(derived(spark, d).select("url", "html"))
    return build_entities(landed_pages(spark, pages, mixed=True), X.api_landed(X.shop_parts(spark, d)), kinds)


def catalog_entities(spark: SparkSession, d: str, kinds=facts.KINDS):
    """Entities of the given pages, the shops with their API calls and the service sites, whose pages are put below /catalog/."""
    services = X.service_pages(spark, d).withColumn("url", F.replace("url", F.lit("/s/"), F.lit("/catalog/s/")))
    pages = pages_of(spark, d).select("url", "html").unionByName(X.shop_pages(spark, d).select("url", "html")).unionByName(services.select("url", "html"))
    return build_entities(landed_pages(spark, pages, mixed=True), X.api_landed(X.shop_parts(spark, d)), kinds)


def landed_pages(spark: SparkSession, pages: DataFrame, mixed: bool = False) -> DataFrame:
    """Derived pages as they would be landed: written once, then read.

    With ``mixed`` kinds of pages every file holds some of all, so the tasks that read them have like amounts of work.
    """
    path = tables.scratch_path(spark, "landed")
    pages = pages.drop("site", "row_id")
    (dealt(pages) if mixed else pages).write.parquet(path)
    return read_pages(spark, path)


def org_contacts(spark: SparkSession, d: str) -> DataFrame:
    return all_contacts(X.org_pages(spark, d))


# --- A: sources and sinks -----------------------------------------------------------------

@query
def scan_pages_query(spark, d):
    return pages_of(spark, d).select("page_id", "site", "url", F.length("html").alias("n_chars"))


@query
def sitemap_urls(spark, d):
    return landed.sitemap_urls(X.sitemaps(spark, d)).select("site", "url", "path")


@query
def sitemap_children(spark, d):
    return landed.sitemap_children(X.sitemaps(spark, d))


@query
def robots_sitemaps(spark, d):
    return landed.robots_sitemaps(X.robots(spark, d)).select("site", "sitemap")


@query
def api_responses(spark, d):
    out = landed.api_responses(X.api_landed(X.shop_parts(spark, d)))
    return out.select("site", "trigger_url", "api_url", "body", F.unix_seconds("scraped_at").alias("scraped_at"))


@query
def products_per_response(spark, d):
    calls = landed.json_responses(X.api_landed(X.shop_parts(spark, d)))
    return S.products_per_response(calls, S.api_products(calls))


@query
def ignored_nodes(spark, d):
    return S.ignored_nodes(X.jsonld_pages(spark, d))


@query
def write_tables(spark, d):
    path = tables.scratch_path(spark, "entities")
    pages = pages_of(spark, d)
    tables.write_tables({
        "pages": (P.head_fields(pages), ["title"]),
        "links": (P.page_links(pages), ["text"]),
    }, path)
    return tables.read_table(spark, path, "pages").select("site", F.lit("page").alias("kind"), "url", F.col("title").alias("value")).unionByName(
        tables.read_table(spark, path, "links").select("site", F.lit("link").alias("kind"), F.col("from_url").alias("url"),
                                                       F.concat("to_url", F.lit(" "), "text").alias("value")))


@query
def site_partition_replace(spark, d):
    """Load all sites, then reload the .org sites with changed titles: other sites must not change."""
    path = tables.scratch_path(spark, "replace") + "/pages"
    heads = P.head_fields(pages_of(spark, d)).select("site", "url", "title")
    tables.replace_sites(heads, path)
    tables.replace_sites(heads.where(F.col("site").endswith(".org")).withColumn("title", F.lit("reloaded")), path)
    return spark.read.parquet(path).groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("title") == "reloaded").alias("reloaded"))


@query
def json_report(spark, d):
    """Every item of the reports of the shop sites."""
    e = shop_entities(spark, d)
    return reports.json_report(e.profile(), e.sections())


@query
def markdown_report(spark, d):
    """Every line of the reports of all sites, with all sections."""
    e = all_entities(spark, d)
    return reports.markdown_lines(e.profile(), e.pages, e.contacts, e.products, e.services)


@query
def markdown_products(spark, d):
    """Product section of the shop reports."""
    e = replace(shop_entities(spark, d), products=tables.stored_rows(blocks.html_products(X.shop_pages(spark, d)), "products"))
    lines = reports.markdown_lines(e.profile(), e.pages, e.contacts, e.products, e.services)
    return lines.where("section = 5").select("site", "ord_no", "ord_text", "sub", "line")


def all_reports(spark, d):
    """The reports of the given pages, the shops and the service sites, written and read back."""
    path = tables.scratch_path(spark, "report")
    e = catalog_entities(spark, d)
    reports.write_json_report(reports.json_report(e.profile(), e.sections()), path)
    return reports.read_report(spark, path)


@query
def read_report(spark, d):
    """Rows of every section of the written reports, one JSON text each."""
    report = all_reports(spark, d)
    out = None
    for section in ("company", *reports.SECTIONS):
        rows = reports.report_section(report, section)
        item = F.to_json(F.struct(*[c for c in rows.columns if c != "site"]), {"ignoreNullFields": "false"})
        rows = rows.select("site", F.lit(section).alias("section"), item.alias("item"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- B: scalar functions ------------------------------------------------------------------

@query
def clean_text(spark, d):
    return documents_of(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query
def normalize_url(spark, d):
    return pages_of(spark, d).select("page_id", U.normalize_url(F.col("url")).alias("url"))


@query
def resolve_url(spark, d):
    """Every href of every page, and one relative reference per page."""
    a = pages_of(spark, d).select("page_id", "url", H.anchors(H.visible_html(F.col("html"))).alias("a"))
    hrefs = F.concat(F.transform("a", lambda x: x["href"]), F.array(F.lit("../x/./y?z=1"), F.lit("?only=query")))
    return a.select("page_id", "url", F.posexplode(hrefs).alias("pos", "href")).select(
        "page_id", "pos", "href", U.resolve_url(F.col("url"), F.col("href")).alias("resolved"))


@query
def site_of(spark, d):
    u = F.col("url")
    return pages_of(spark, d).select(
        "page_id", U.site_of(u).alias("site"), U.same_site(u, F.lit("https://thther.example.org/x")).alias("same"))


@query
def is_followable(spark, d):
    """Verdicts on page urls extended by the kinds of targets the rules are about."""
    tails = F.array(*[F.lit(x) for x in ("", "/cartoon", "/a.PDF", "/a.pdf?x=1", "/a.pdfx", "/login/", "/style.css", "/tel:1")])
    u = pages_of(spark, d).select("page_id", "site", F.posexplode(tails).alias("k", "tail"), U.normalize_url(F.col("url")).alias("u"))
    target = F.concat("u", "tail")
    return u.select("page_id", "k", U.is_followable(target, F.col("site")).alias("own"),
                    U.is_followable(target, F.lit("thther.example.org")).alias("other"))


@query
def extract_emails(spark, d):
    return documents_of(spark, d).select("doc_id", F.explode(T.extract_emails(F.col("text"))).alias("email"))


@query
def extract_phones(spark, d):
    return documents_of(spark, d).select("doc_id", F.explode(T.extract_phones(F.col("text"))).alias("phone"))


@query
def price_and_currency(spark, d):
    return X.raw_prices(spark, d).select("p_partkey", prices.price_and_currency(F.col("raw")).alias("p")) \
        .select("p_partkey", "p.price", "p.currency")


@query
def price_number(spark, d):
    """Prices of parts in four spellings, with blanks, commas, dots and apostrophes."""
    return X.spelled_prices(spark, d).select("p_partkey", "spelling", prices.price_number(F.col("raw")).alias("price_num"))


@query
def classify_social(spark, d):
    """Social types of links to all networks and to a look-alike, one set per supplier."""
    key = F.col("s_suppkey").cast("string")
    hosts = [*U.SOCIAL_DOMAINS, "netflix.com", "example.org"]
    links = F.array(*[F.concat(F.lit(f"https://{h}/"), key) for h in hosts])
    s = X.table(spark, d, "supplier").select("s_suppkey", F.explode(links).alias("href"))
    return s.select("s_suppkey", F.explode(U.classify_social(F.col("href"))).alias("c")).select("s_suppkey", "c.type", "c.value")


@query
def needs_render(spark, d):
    return P.needs_render(pages_of(spark, d))


@query
def clean_page_text(spark, d):
    return X.noisy_text(spark, d).select("doc_id", T.clean_page_text(F.col("text")).alias("text"))


@query
def strip_site_suffix(spark, d):
    """Titles with and without the site appended."""
    h = P.head_fields(pages_of(spark, d))
    shown = F.concat("title", F.when(F.length("url") % 3 == 0, F.concat(F.lit(" - "), "site")).when(
        F.length("url") % 3 == 1, F.concat(F.lit(" – "), "site", F.lit(" "))).otherwise(F.lit("")))
    blank = F.when(F.length("url") % 7 == 0, F.lit("")).otherwise(shown)
    return h.select("url", T.strip_site_suffix(shown, F.col("site")).alias("stripped"),
                    T.page_heading(blank, F.col("h1"), F.col("url"), F.col("site")).alias("heading"))


@query
def chunk_text(spark, d):
    return documents_of(spark, d).select("doc_id", F.explode(T.chunk_text(F.col("text"))).alias("c")) \
        .select("doc_id", "c.start", "c.chunk", "c.within")


@query
def truncate_with_rest(spark, d):
    return documents_of(spark, d).select("doc_id", T.truncate_with_rest(F.col("text"), 2000).alias("t")).select("doc_id", "t.head", "t.rest")


@query
def decode_entities(spark, d):
    return pages_of(spark, d).select("page_id", T.decode_entities(F.col("html")).alias("decoded"))


@query
def plausible_phone(spark, d):
    return documents_of(spark, d).select("doc_id", F.explode(T.extract_phones(F.col("text"))).alias("phone")) \
        .select("doc_id", "phone", T.plausible_phone(F.col("phone")).alias("plausible"))


# --- C: documents as tables ---------------------------------------------------------------

@query
def html_tokens(spark, d):
    return dom.html_tokens(pages_of(spark, d)).select("url", "pos", "kind", "tag", "tok")


@query
def html_elements(spark, d):
    """Per page and tag: elements, how many of them are closed, and the sum of their last token numbers."""
    return dom.html_elements(pages_of(spark, d)).groupBy("url", "tag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("closed")).alias("n_closed"), F.sum("end_pos").alias("ends"))


@query
def select_elements(spark, d):
    """Product links inside template cards of the shop pages."""
    links = dom.select_elements(
        X.shop_pages(spark, d), lambda e: (e["tag"] == "a") & dom.has_attr(e, "href"),
        within=lambda e: dom.has_class(e, *blocks.TEMPLATE_CARDS))
    return links.select("url", H.attr(F.col("tok"), "href").alias("href"))


@query
def subtree_text(spark, d):
    """Text of every product name in the template cards."""
    names = dom.subtree_text(
        X.shop_pages(spark, d), lambda e: dom.has_class(e, "item-title", "dark_link", "name") & (e["tag"] != "div"))
    return names.select("url", T.clean_text(F.col("text")).alias("text"))


@query
def drop_subtrees(spark, d):
    """Text tokens left per page outside the page furniture."""
    kept = dom.drop_subtrees(pages_of(spark, d))
    return kept.where("kind = 'text'").groupBy("url").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("tok")).alias("n_chars"))


@query
def main_content(spark, d):
    return P.main_text(pages_of(spark, d)).select("url", "raw_text")


@query
def main_content_stripped(spark, d):
    """Main texts of pages whose furniture is named by class or id."""
    return P.main_text(X.furniture_pages(spark, d), strip_classes=True).select("url", "raw_text")


@query
def head_fields(spark, d):
    return P.head_fields(pages_of(spark, d)).unionByName(P.head_fields(X.shop_pages(spark, d)))


@query
def class_frequency(spark, d):
    return I.class_frequency(X.shop_pages(spark, d))


@query
def class_frequency_all_tags(spark, d):
    return I.class_frequency(X.service_pages(spark, d), tags=None, top=30, above=3)


@query
def price_like_nodes(spark, d):
    """Price-like texts below an element with a class, on the shop pages."""
    return I.price_like_nodes(X.shop_pages(spark, d), I.CATEGORY_PRICE).select("url", "tag", "classes", "text")


@query
def selector_samples(spark, d):
    """The first five names of products in template cards per shop, with their whole texts."""
    names = lambda e: dom.has_class(e, "item-title", "dark_link", "name") & (e["tag"] != "div")
    return I.selector_samples(X.shop_pages(spark, d), {"name": names}, k=5)


@query
def card_structure(spark, d):
    """Inside of the first priced card of every template page."""
    return I.card_structure(X.shop_pages(spark, d)).select("url", "tag", "classes", "text")


# --- D: entity extractors -----------------------------------------------------------------

@query
def build_pages(spark, d):
    return P.build_pages(pages_of(spark, d)).select("site", "url", "title", "description", "keywords", "h1", "raw_text")


@query
def repeated_pages(spark, d):
    """Shop pages delivered twice, the second time with another title: titles and products of the last delivery."""
    shop = X.shop_pages(spark, d).withColumn("fetched_at", F.timestamp_seconds(F.lit(1)))
    again = shop.withColumn("html", F.replace("html", F.lit("<title>"), F.lit("<title>New "))).withColumn("fetched_at", F.timestamp_seconds(F.lit(2)))
    e = build_entities(landed_pages(spark, shop.unionByName(again)), X.api_landed(X.shop_parts(spark, d)).where(F.lit(False)), ["pages", "products"])
    return e.pages.select(F.lit("page").alias("kind"), "url", F.col("title").alias("value")).unionByName(
        e.products.select(F.lit("product").alias("kind"), F.col("source_url").alias("url"), F.col("name").alias("value")))


@query
def page_contacts(spark, d):
    return P.page_contacts(pages_of(spark, d))


@query
def page_addresses(spark, d):
    return blocks.page_addresses(X.org_pages(spark, d))


@query
def page_socials(spark, d):
    return P.page_socials(X.org_pages(spark, d))


@query
def page_links(spark, d):
    return P.page_links(pages_of(spark, d))


@query
def followable_links(spark, d):
    return P.followable_links(P.page_links(pages_of(spark, d))).select("site", "from_url", "to_url")


@query
def page_services(spark, d):
    return blocks.page_services(X.service_pages(spark, d))


@query
def template_cards(spark, d):
    return blocks.template_cards(X.shop_pages(spark, d)).drop("origin", "seq")


@query
def generic_cards(spark, d):
    return blocks.generic_cards(X.shop_pages(spark, d)).drop("origin", "seq")


@query
def jsonld_blocks(spark, d):
    return S.jsonld_blocks(X.jsonld_pages(spark, d)).groupBy("site").agg(F.count(F.lit(1)).alias("blocks"))


@query
def json_nodes(spark, d):
    """Objects per depth and type over all JSON-LD pages."""
    return S.json_nodes(X.jsonld_pages(spark, d)).groupBy("depth", F.coalesce("type", F.lit("")).alias("type")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def jsonld_products(spark, d):
    return S.jsonld_products(X.jsonld_pages(spark, d)).drop("origin", "seq")


@query
def jsonld_org(spark, d):
    return S.jsonld_org(X.org_pages(spark, d))


@query
def jsonld_contacts(spark, d):
    return S.jsonld_contacts(X.org_pages(spark, d))


@query
def api_products(spark, d):
    calls = landed.json_responses(X.api_landed(X.shop_parts(spark, d)))
    return S.api_products(calls).drop("origin", "seq")


@query
def next_page(spark, d):
    return blocks.next_page(X.shop_pages(spark, d))


# --- E: relational operators --------------------------------------------------------------

def _numbered_visits(spark, d):
    """Orders as repeated deliveries of a customer's row."""
    o = X.table(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("o_orderdate"))


@query
def first_wins(spark, d):
    return keys.first_wins(_numbered_visits(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query
def last_wins(spark, d):
    return keys.last_wins(_numbered_visits(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query
def merge_products(spark, d):
    """API products override cards of the same name on the same page."""
    return shop_entities(spark, d, ["products"]).products.select("site", "source_url", "name", "origin", "price", "sku")


@query
def distinct_texts(spark, d):
    shop = X.shop_pages(spark, d)
    out = L.distinct_texts(
        {"pages": P.build_pages(pages_of(spark, d)), "products": blocks.html_products(shop),
         "services": blocks.page_services(X.service_pages(spark, d))}, S.jsonld_org(X.org_pages(spark, d)))
    return out


@query
def translate_tables(spark, d):
    """Shop products under names that collide once translated, and organizations with translated names."""
    products = tables.stored_rows(blocks.html_products(X.shop_pages(spark, d)), "products")
    company = tables.stored_rows(S.jsonld_org(X.org_pages(spark, d)), "company")
    names = products.select(F.col("name").alias("src"), F.concat(F.lit("~"), F.regexp_extract("name", "& (.*)$", 1)).alias("dst"))
    orgs = company.where("key = 'org_name'").select(F.col("value").alias("src"), F.concat(F.lit("~"), "value").alias("dst"))
    tables_, company = L.translate_tables({"products": products}, company, names.unionByName(orgs).distinct())
    return tables_["products"].select(F.lit("product").alias("kind"), F.col("source_url").alias("owner"), "name", F.col("price").alias("value")) \
        .unionByName(company.select(F.lit("company").alias("kind"), F.col("site").alias("owner"), F.col("key").alias("name"), "value"))


@query
def detect_language(spark, d):
    t = F.col("text")
    return documents_of(spark, d).select("doc_id", F.coalesce(L.detect_language(t), F.lit("")).alias("detected"),
                                         L.is_translatable(t).alias("translatable"))


@query
def apply_dictionary(spark, d):
    docs = documents_of(spark, d)
    dictionary = docs.where("lang = 'en'").select(F.col("text").alias("src"), F.concat(F.lit("~"), F.md5("text")).alias("dst")).distinct()
    rows = docs.select("doc_id", "text", F.col("source").alias("label"))
    return L.apply_dictionary(rows, ["doc_id"], ["text", "label"], dictionary)


@query
def home_page(spark, d):
    return R.home_page(P.head_fields(pages_of(spark, d)))


@query
def site_profile(spark, d):
    pages = pages_of(spark, d)
    return R.site_profile(P.build_pages(pages), P.page_contacts(pages))


@query
def social_links(spark, d):
    return R.social_links(org_contacts(spark, d))


@query
def report_counts(spark, d):
    e = shop_entities(spark, d)
    return R.report_counts(e.pages, e.products, e.services, e.api_responses)


@query
def approximate_report_counts(spark, d):
    """Counts of the shops from sketches of two loads, of the lower and the upper half of the listing blocks."""
    e = shop_entities(spark, d, ["pages", "products", "services"])
    upper = F.regexp_extract(F.col("u"), r"page=(\d+)$", 1).cast("int") >= 50

    def half(df, url, keep):
        return df.withColumn("u", F.col(url)).where(upper if keep else ~upper).drop("u")

    loads = [R.count_sketches(half(e.pages, "url", k), half(e.products, "source_url", k), half(e.services, "page_url", k),
                              half(e.api_responses, "trigger_url", k)) for k in (False, True)]
    return R.approximate_counts(R.merged_sketches(*loads))


@query
def distinct_addresses(spark, d):
    return R.distinct_addresses(org_contacts(spark, d))


@query
def product_listing(spark, d):
    return R.product_listing(blocks.html_products(X.shop_pages(spark, d))).select("site", "name", "line", "product_url")


@query
def service_listing(spark, d):
    return R.service_listing(blocks.page_services(X.service_pages(spark, d)))


@query
def info_pages(spark, d):
    pages = P.build_pages(pages_of(spark, d))
    console = R.info_pages(pages, "console").withColumn("mode", F.lit("console"))
    return console.unionByName(R.info_pages(pages, "markdown").withColumn("mode", F.lit("markdown"))) \
        .select("mode", "site", "url", "url_length")


@query
def page_preview(spark, d):
    return R.page_preview(P.build_pages(pages_of(spark, d)))


@query
def contacts_by_type(spark, d):
    """Distinct contacts per document source, as JSON lists."""
    docs = documents_of(spark, d)
    rows = docs.select(F.col("source").alias("site"), F.explode(F.concat(
        F.transform(T.extract_emails(F.col("text")), lambda v: F.struct(F.lit("email").alias("type"), v.alias("value"))),
        F.transform(T.extract_phones(F.col("text")), lambda v: F.struct(F.lit("phone").alias("type"), v.alias("value"))),
    )).alias("c")).select("site", "c.type", "c.value")
    return R.contacts_by_type(rows)


@query
def top_products(spark, d):
    return reports.top_products(all_reports(spark, d))


@query
def top_services(spark, d):
    return reports.top_services(all_reports(spark, d))


@query
def report_totals(spark, d):
    return reports.report_totals(all_reports(spark, d))


@query
def profile_phones(spark, d):
    pages = pages_of(spark, d)
    return R.profile_phones(R.site_profile(P.build_pages(pages), P.page_contacts(pages)))


# --- F: link graph ------------------------------------------------------------------------

@query
def frontier_round(spark, d):
    """Next round after all landed pages: up to 20 new links per site."""
    pages = pages_of(spark, d)
    links = P.page_links(pages)
    candidates = links.select("site", F.col("to_url").alias("url"), F.lit("link").alias("kind"),
                              F.length("from_url").alias("depth"), F.col("from_url").alias("seq"))
    return graph.frontier_round(candidates, pages.select("url"), 20).select("site", "url", "kind", "rank")


@query
def frontier_candidates(spark, d):
    """All that may be fetched next for the shops and the sites with sitemaps."""
    shop = X.shop_pages(spark, d)
    roots = shop.select(F.concat(F.lit("https://"), "site", F.lit("/")).alias("url")).distinct()
    found = graph.frontier_candidates(roots, landed.sitemap_urls(X.sitemaps(spark, d)), P.page_links(shop), blocks.next_page(shop))
    return found.select("site", "url", "kind").distinct()


@query
def bfs_depth(spark, d):
    """Depth of shop and product pages from the first listing page of each shop."""
    shop = X.shop_pages(spark, d)
    edges = P.followable_links(P.page_links(shop))
    seeds = shop.where(F.col("url").endswith("page=0")).select("url")
    return graph.bfs_depth(edges, seeds)


@query
def pagination_chain(spark, d):
    return graph.pagination_chain(blocks.next_page(X.shop_pages(spark, d)))


@query
def crawl_summary(spark, d):
    return R.crawl_summary(pages_of(spark, d))


# --- G: streams ---------------------------------------------------------------------------

def _stream(spark, d, name):
    path = f"{d}/{name}.parquet"
    return spread(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))


@query
def stream_api_responses(spark, d):
    base = tables.scratch_path(spark, "stream-api")
    parts = X.shop_parts_of(_stream(spark, d, "part"))
    jobs.stream_api_responses(X.api_landed(parts), f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("site", "trigger_url", "api_url", "body",
                                                    F.unix_seconds("scraped_at").alias("scraped_at"))


@query
def stream_api_products(spark, d):
    base = tables.scratch_path(spark, "stream-products")
    parts = X.shop_parts_of(_stream(spark, d, "part"))
    jobs.stream_api_products(X.api_landed(parts), f"{base}/out", f"{base}/ck").awaitTermination()
    return keys.merge_products(spark.read.parquet(f"{base}/out")).select("source_url", "name", "price", "sku")


@query
def stream_contacts(spark, d):
    base = tables.scratch_path(spark, "stream-contacts")
    landed_pages = scan_pages(_stream(spark, d, "pages")).withColumn("fetched_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")))
    jobs.stream_contacts(landed_pages, f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("fetched_at")


@query
def stream_page_upsert(spark, d):
    """Two runs of the stream: all pages, then every second one again with a changed title."""
    base = tables.scratch_path(spark, "stream-pages")
    first = pages_of(spark, d).select("page_id", "url", "html", F.timestamp_seconds(F.lit(1)).alias("fetched_at"))
    second = first.where("page_id % 2 = 0").withColumn("html", F.replace("html", F.lit("<title>"), F.lit("<title>New "))) \
        .withColumn("fetched_at", F.timestamp_seconds(F.lit(2)))
    for k, df in enumerate((first, second)):
        df.write.parquet(f"{base}/in/delivery={k}")
        arriving = spark.readStream.schema(first.schema).parquet(f"{base}/in")
        jobs.stream_page_upsert(scan_pages(arriving), f"{base}/out", f"{base}/ck").awaitTermination()
    return jobs.current_pages(spark, f"{base}/out").select("site", "url", "title", "h1", "raw_text")


@query
def site_links(spark, d):
    return link_profile(pages_of(spark, d))


_registry["scan_pages"] = _registry.pop("scan_pages_query")
