"""Landed data derived from the star-schema tables: markup and JSON around known entities.

The extractors run on these pages; the expected rows are then plain selections from the base
tables, which share no code with the extractors. Pages group a bounded number of rows each
(by key range), so the builders scale with their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import SOCIAL_DOMAINS, site_of
from ..sources.pages import dealt, spread

def _evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Select columns through a one-element explode.

    Filters are not pushed through it, so a long markup expression is evaluated once per row,
    as it would be if the pages had been read from storage.
    """
    return df.select(F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("r")).select("r.*")


PARTS_PER_BLOCK = 200
CHAIN_LENGTH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are expensive to process, spread over all cores."""
    return spread(table(spark, sf_dir, name))


def _esc(c: Column) -> Column:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(selector: Column, *options: Column) -> Column:
    out = options[-1]
    for i, o in reversed(list(enumerate(options[:-1]))):
        out = F.when(selector == i, o).otherwise(out)
    return out


def shop_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the listing page they are shown on."""
    return shop_parts_of(texts(spark, sf_dir, "part"))


def shop_parts_of(parts: DataFrame) -> DataFrame:
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    block = F.floor(F.col("p_partkey") / PARTS_PER_BLOCK).cast("bigint")
    return parts.select(
        "p_partkey", "p_brand", "p_type", "p_size", brand.alias("brand_no"), block.alias("block"),
        _cat(F.col("p_name"), " & ", F.col("p_type")).alias("name"),
        F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"),
        _cat("https://brand", brand, ".example.com/catalog/list?page=", block).alias("url"))


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url, html): listing pages, template cards on even brands, generic cards on odd ones."""
    key, size = F.col("p_partkey"), F.col("p_size")
    name, price = _esc(F.col("name")), F.col("price")
    image = F.when(key % 2 == 0, _cat('<img data-src="/i/', key, '.jpg" src="/blank.gif">')) \
        .otherwise(_cat("<img src='../i/", key, ".png'>"))
    title = _pick(
        size % 3,
        _cat('<div class="item-title"><a class="dark_link" href="/p/', key, '"><span>', name, "</span></a></div>"),
        _cat('<a class="dark_link" href="/p/', key, '">', name, "</a>"),
        _cat('<div class="block_name"><b class="name">', name, '</b></div><a href="/p/', key, '">x</a>'))
    currency = F.when(size % 3 != 0, F.lit('<span class="price_currency"> руб. </span>')).otherwise(F.lit(""))
    old = F.when(size % 2 == 0, _cat(
        '<div class="price discount"><span class="price_value">', size, " 000</span></div>")).otherwise(F.lit(""))
    stock = _pick(
        size % 4, _cat('<div class="item-stock"><i class="icon"></i><span class="value">Есть (', size, ")</span></div>"),
        F.lit('<div class="sa_block">по запросу</div>'), F.lit(""), F.lit('<span class="value">other</span>'))
    template = _cat(
        '<div class="catalog-block-view__item" data-id="', key, '">', image, title, old,
        '<div class="price"><span class="price_value"> ', price, " </span>", currency, "</div>", stock, "</div>")
    generic = _pick(
        size % 3,
        _cat('<div class="product-card"><h3>', name, '</h3><span class="price">', price,
             ' USD</span><s class="old-price">', size, " USD</s>", image, '<a href="/p/', key, '">more</a></div>'),
        _cat('<li class="goods-item x"><span itemprop="name">', name, '</span><b itemprop="price">€ ', price, "</b></li>"),
        _cat('<div itemscope itemtype="https://schema.org/Product"><p class="Title">', name, '</p><i class="cost">',
             price, " тг.</i></div>"))
    card = F.when(F.col("brand_no") % 2 == 0, template).otherwise(generic)
    rows = shop_parts(spark, sf_dir).select("url", "brand_no", "block", "p_partkey", card.alias("card"))
    cards = dealt(rows, "url", "brand_no", "block").groupBy("url", "brand_no", "block").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "card"))).alias("cards"))
    target = _cat('href="/catalog/list?page=', F.col("block") + 1, '"')
    following = _pick(
        F.col("brand_no") % 4,
        _cat('<a rel="next" ', target, ">more</a>"),
        _cat('<div class="pagination"><a class="prev" href="/">back</a><a class="next" ', target, ">more</a></div>"),
        _cat('<div class="my-paginator"><span><a class="big next" ', target, ">more</a></span></div>"),
        _cat("<p><a ", target, "> Далее </a></p>"))
    brand = F.col("brand_no")
    html = _cat(
        '<!DOCTYPE html><html><head><title>Goods of brand ', brand, " - brand", brand, ".example.com</title>",
        '<meta name="Description" content="Goods &quot;', brand, '&quot; block ', F.col("block"),
        '"></head><body><header class="menu"><nav><a href="/">home</a></nav></header><main><h1>Brand ', brand, "</h1>",
        F.array_join(F.transform("cards", lambda c: c["card"]), "\n"), "</main>",
        F.when(F.col("block") % CHAIN_LENGTH != CHAIN_LENGTH - 1, following).otherwise(F.lit("")),
        "<aside><p>aside</p></aside><footer>&copy; shop</footer></body></html>")
    return _evaluated(cards, site=site_of(F.col("url")), url=F.col("url"), html=html)


def jsonld_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url, html): one page per part with JSON-LD in six shapes."""
    p = texts(spark, sf_dir, "part")
    key = F.col("p_partkey")
    url = _cat("https://shop", key % 7, ".example.net/item/", key)
    name = _cat(F.col("p_name"), " <", key, "> & co")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    typed = F.lit("Product").alias("@type")
    description = _cat(F.col("p_type"), " ", F.repeat(F.lit("word "), 100)).alias("description")
    a = F.to_json(F.struct(
        typed, name.alias("name"), F.struct(price.alias("price"), F.lit("USD").alias("priceCurrency")).alias("offers"),
        F.struct(F.col("p_brand").alias("name")).alias("brand"),
        F.array(_cat("/i/", key, ".jpg"), F.lit("/i/two.jpg")).alias("image"), _cat("S-", key).alias("sku"), description))
    b = F.to_json(F.struct(
        typed, name.alias("name"),
        F.array(F.struct(F.col("p_size").alias("price"), F.lit("EUR").alias("priceCurrency"))).alias("offers"),
        F.col("p_brand").alias("brand"), F.struct(_cat("/i/", key, ".png").alias("url")).alias("image"),
        F.col("p_partkey").alias("productID"), description))
    nameless = _cat('{"@type":"Product","inner":', a, "}")
    block = _pick(
        key % 6, a, _cat("[", b, "]"), _cat('{"@graph":[{"@type":"WebPage","mainEntity":', b, "}]}"),
        _cat('{bad json</script><script type="application/ld+json">', F.replace(a, F.lit('"Product"'), F.lit('"IndividualProduct"'))),
        nameless, F.replace(a, F.lit('"Product"'), F.lit('["Product","Thing"]')))
    html = _cat("<html><head><!-- <script type=\"application/ld+json\">{\"@type\":\"Product\",\"name\":\"no\"}</script> -->",
                "<script type='application/ld+json' data-x=\"1\">", block, "</script></head><body><p>item</p></body></html>")
    return _evaluated(p, site=site_of(url), url=url, html=html)


def org_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url, html): one about page per supplier with JSON-LD, address blocks and social links."""
    s = texts(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    key = F.col("s_suppkey")
    url = _cat("https://org", key, ".example.org/about")
    domains = list(SOCIAL_DOMAINS)
    link = _cat("https://", _pick(key % len(domains), *[F.lit(d) for d in domains]), "/org", key)
    phone_a, phone_b = _cat("+7 (495) 000-", F.lpad(key.cast("string"), 6, "0")), _cat("8 800 ", key)
    as_text = F.to_json(F.struct(phone_a.alias("t")))
    as_list = F.to_json(F.struct(F.array(phone_a, phone_b).alias("t")))
    phone = F.regexp_replace(_pick(key % 3, as_text, as_list, F.lit('{"t":[]}')), r'^\{"t":|\}$', "")
    kind = _pick(key % 4, *[F.lit(k) for k in ("Organization", "LocalBusiness", "Store", "Company")])
    ld = _cat(
        '{"@context":"x","@graph":[{"@type":"', kind, '","name":"', F.col("s_name"), '  Ltd","description":"',
        F.repeat(_cat(F.col("s_name"), " "), 60), '","telephone":', phone, ',"email":"Info@org', key,
        '.example.org","address":{"streetAddress":"', key, ' Main St","addressLocality":"","addressCountry":"',
        F.col("n_name"), '"},"sameAs":["', link, '","https://other.example.org/"]}]}')
    blocks = _pick(
        key % 3,
        _cat("<address>Tag street ", key, "<br>, town</address>"),
        _cat('<div itemprop="address"><span>Prop street ', key, "</span></div>"),
        _cat('<p class="My-Location big">Class street ', key, "</p>"))
    html = _cat('<html><head><title>About</title><script type="application/ld+json">', ld, "</script></head><body>",
                blocks, '<a href="', link, '">follow us</a><a href="', link, '">again</a></body></html>')
    return _evaluated(s.join(n, "s_nationkey"), site=site_of(url), url=url, html=html)


def service_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url, html): pages of 20 customers each, shown as service blocks."""
    c = texts(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    block = F.floor(key / 20)
    name = _cat(F.col("c_mktsegment"), " ", key % 5)
    text = F.repeat(_cat(F.col("c_name"), " "), 30)
    box = _pick(
        key % 4,
        _cat('<section class="our-services"><div><h3>', name, "</h3></div><p>", text, "</p><p>second</p></section>"),
        _cat('<div class="ADVANTAGES"><h2>', name, "</h2></div>"),
        _cat('<div class="блок Услуги"><h5> ', name, " </h5><div><p>short &lt;", key, "&gt;</p></div></div>"),
        F.lit('<section class="service"><h4>ab</h4><p>dropped</p></section>'))
    pages = dealt(c.select(block.alias("block"), key.alias("k"), box.alias("box")), "block").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("k", "box"))).alias("boxes"))
    url = _cat("https://svc", F.col("block") % 25, ".example.com/s/", F.col("block"))
    html = _cat("<html><body><main>", F.array_join(F.transform("boxes", lambda b: b["box"]), ""), "</main></body></html>")
    return _evaluated(pages, site=site_of(url), url=url, html=html)


def api_landed(parts: DataFrame) -> DataFrame:
    """(trigger_url, api_url, content_type, body, fetched_at) from shop_parts rows, one call per part."""
    key = F.col("p_partkey")
    plain = F.to_json(F.struct(
        F.col("name"), F.col("p_size").alias("price"), _cat("A-", key).alias("sku"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"), F.lit(True).alias("in_stock")))
    listed = F.to_json(F.struct(F.array(F.struct(
        F.lit(" ").alias("name"), F.col("name").alias("title"), _cat(F.col("p_size"), " руб").alias("cost"),
        F.lit("").alias("sku"), F.col("p_partkey").alias("article"), F.struct(F.col("p_type").alias("name")).alias("category"),
        _cat("/i/", key).alias("img"), _cat("/p/", key).alias("link"))).alias("items")))
    depth = (key % 11).cast("int")
    nested = _cat(F.repeat(F.lit('{"a":'), depth), F.to_json(F.struct(F.col("name").alias("наименование"), F.col("price").alias("цена"))),
                  F.repeat(F.lit("}"), depth))
    big = F.to_json(F.struct(F.col("name").alias("label"), F.when(key % 80 == 7, F.repeat(F.lit("x"), 90000))
                             .otherwise(F.lit("short text")).alias("about")))
    body = _pick(key % 8, plain, listed, nested, plain, plain, F.lit('{"n":1}'), F.lit('{"name": "broken'), big)
    api = F.when(key % 8 == 3, _cat("https://mc.yandex.example.com/watch/", key)).otherwise(_cat("https://api.example.com/v1/", key))
    return _evaluated(
        parts, trigger_url=F.col("url"), api_url=api,
        content_type=F.when(key % 8 == 4, "text/html").otherwise("application/json; charset=utf-8"),
        body=body, fetched_at=F.timestamp_seconds(F.lit(1704067200) + key))


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, path, xml): sitemap files of at most 100 customers each."""
    key = F.col("c_custkey")
    host = _cat("svc", F.col("c_nationkey"), ".example.com")
    loc = _pick(
        key % 5,
        _cat("https://foreign.example.org/c/", key), _cat("\n   https://", host, "/c/", key, "  \n"),
        _cat("https://", host, "/c/", key, "?a=1&amp;b=2"), _cat("https://", host, "/c/", key, "#part"),
        _cat("https://", host, "/"))
    entry = F.when(key % 7 == 0, F.repeat(_cat("<url><loc>", loc, "</loc></url>"), 2)).otherwise(_cat("<url><loc>", loc, "</loc></url>"))
    files = texts(spark, sf_dir, "customer").select(
        host.alias("site"), F.floor(key / 100).alias("block"), key.alias("k"), entry.alias("e")
    ).groupBy("site", "block").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("es"))
    body = F.array_join(F.transform("es", lambda e: e["e"]), "")
    ns = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    path = _cat("/sitemap-", F.col("block"), ".xml")
    xml = _pick(
        F.col("block") % 4,
        _cat(f'<?xml version="1.0"?><urlset{ns}>', body, "</urlset>"), _cat(f"<urlset{ns}>", body, "</urlset>"),
        _cat(f"<sitemapindex{ns}><sitemap><loc> https://", F.col("site"), "/deep/", F.col("block"), ".xml </loc></sitemap></sitemapindex>"),
        _cat(f"<urlset{ns}>", body))
    return _evaluated(files, site=F.col("site"), path=path, xml=xml)


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, txt): one robots.txt per supplier."""
    key = F.col("s_suppkey")
    host = _cat("org", key, ".example.org")
    return texts(spark, sf_dir, "supplier").select(host.alias("site"), _cat(
        "User-agent: *\nSITEMAP: https://", host, "/sitemap.xml\r\nDisallow: /x\nsitemap:http://", host,
        ":8080/two.xml  \n# Sitemap: no").alias("txt"))


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, raw): part prices printed in the ways shops print them."""
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    raw = _pick(
        key % 10,
        _cat("Цена: ", price, " ₽ за штуку"), _cat("$", price), _cat("от ", price, " РУБ."), _cat("€ ", price, "!"),
        _cat(price, "usd"), _cat("£", price), _cat(price, " грн."), _cat(price, " KZT"), _cat("¥ ", price),
        _cat("price on request ", price))
    return texts(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


def spelled_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, spelling, raw): the price of every part, with thousands, in four spellings."""
    price = (F.col("p_retailprice") * 1000 + F.col("p_partkey") / 100).cast("decimal(18,2)")
    english = F.format_number(price, 2)
    german = F.translate(english, ",.", ".,")
    spellings = {
        "english": _cat("$", english), "german": _cat("ab ", german, " € / Stück"),
        "blanks": _cat("Цена: ", F.translate(F.replace(english, F.lit(","), F.lit("\u00a0")), ".", ","), " ₽"),
        "swiss": _cat("CHF ", F.replace(english, F.lit(","), F.lit("'")), ".-"), "whole": _cat(F.regexp_replace(english, r"\.\d+$", ""), " USD")}
    return texts(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[
        F.struct(F.lit(k).alias("spelling"), v.alias("raw")) for k, v in spellings.items()])).alias("s")).select("p_partkey", "s.*")


def noisy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): document words between five kinds of page noise."""
    words = F.array_join(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^a-z]+", " ")), " "), ". ")
    core = _cat("Текст ", words, ".")
    i = F.col("doc_id") % 5
    text = _pick(
        i, _cat("Магазин Главная — Каталог ", core), _cat(core, " Условия оплаты Условия доставки Возврат"),
        _cat(core, " Акции Бренды Магазины Контакты Блог"), _cat(core, " Показать еще 1 2 3 4"),
        _cat(core, " Подробнее Подробнее Подробнее конец."))
    return _evaluated(texts(spark, sf_dir, "documents"), doc_id=F.col("doc_id"), text=text)


def furniture_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url, html): part descriptions between page furniture that only class or id names."""
    key = F.col("p_partkey")
    text = _cat(_esc(F.col("p_name")), " ", F.repeat(_cat(F.col("p_type"), " "), 12), key)
    above = _pick(
        key % 4, F.lit('<div class="site-header big"><p>Shop<div class="inner"><a href="/">home</a></div></div>'),
        F.lit('<ul id="main-nav"><li>one<li>two</ul><table class="menu"><tr><td>x</table>'),
        F.lit('<div class="top menu-bar"><div><div>deep</div></div></div><span class="breadcrumbs">a / b</span>'),
        F.lit('<img class="header-image" src="/h.png"><b id="header">brand</b>'))
    inside = _pick(key % 3, F.lit('<p class="sidebar-note">aside <i>really</i></p>'), F.lit('<em class="Sidebar">kept</em>'), F.lit(""))
    html = _cat("<html><body>", above, _pick(key % 2, _cat("<article>", text, inside, "</article>"), _cat("<div>", text, inside, "</div>")),
                '<div class="page-footer"><div class="footer">nested</div>more</div><div id="footer2">end</div></body></html>')
    url = _cat("https://made", key % 5, ".example.net/d/", key)
    return _evaluated(texts(spark, sf_dir, "part"), site=site_of(url), url=url, html=html)
