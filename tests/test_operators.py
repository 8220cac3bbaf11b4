"""Operators on small pages, hot groups and edge cases."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagelake.operators import blocks, dom, graph, groups, inspect, keys, pages as P, profile, structured, translate
from pagelake.plans import fixtures as X, site_build
from pagelake.sources import landed, reports, tables
from pagelake.sources.pages import latest_pages, scan_pages


def spark_calls(df, body):
    """One API response with the given body."""
    return df.sparkSession.createDataFrame([("http://a.org/p", "http://a.org/api", body)], "trigger_url string, api_url string, body string") \
        .withColumn("fetched_at", F.timestamp_seconds(F.lit(0)))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


class _Article(HTMLParser):
    """Text of the article element, by the standard library parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_main_text_against_stdlib_parser(spark, sf_dir):
    pages = scan_pages(X.table(spark, sf_dir, "pages"))
    for r in P.main_text(pages).join(pages.select("url", "html"), "url").collect():
        parser = _Article()
        parser.feed(r.html)
        text = " ".join("".join(parser.out).split())
        if len(text) > 100:
            assert r.raw_text.replace(" ", "") == text.replace(" ", "")


def test_elements_of_broken_markup(page_df):
    pages = page_df(("http://a.org/", "<div><div>a</div><p>b<p>c</div></b><b>d<br>"))
    els = dom.html_elements(pages)
    got = {(r.tag, r.start_pos): (r.end_pos, r.closed) for r in els.collect()}
    assert got == {("div", 0): (8, True), ("div", 1): (3, True), ("p", 4): (5, False), ("p", 6): (7, False),
                   ("b", 10): (13, False), ("br", 12): (12, False)}


def test_no_rows_from_empty_pages(page_df):
    pages = page_df(("http://a.org/", None), ("http://b.org/", ""), ("http://c.org/", "<!-- <a href='/x'>x</a> -->"))
    assert P.page_links(pages).count() == 0
    assert blocks.html_products(pages).count() == 0
    assert structured.json_nodes(pages).count() == 0
    assert P.build_pages(pages).count() == 3


def test_links_first_text_wins(page_df):
    pages = page_df(("http://a.org/d/", "<a href='/x#1'>one</a><A HREF=\"/x\">two</A><a href=mailto:q@w.e>m</a><a href='y'>z<b>q</b></a>"))
    assert rows(P.page_links(pages), "to_url", "text") == [("http://a.org/d/y", "zq"), ("http://a.org/x", "one")]


def test_json_walk_has_no_depth_limit(page_df):
    deep = '{"a":[' * 40 + '{"@type":"Product","name":"deep"}' + "]}" * 40
    pages = page_df(("http://a.org/", f'<script type="application/ld+json">{deep}</script>'))
    assert rows(structured.jsonld_products(pages), "name") == [("deep",)]
    assert structured.json_nodes(pages).agg(F.max("depth")).first()[0] == 80
    assert structured.json_nodes_cut(pages, 8).first().cut == 1
    assert structured.json_nodes(pages, max_depth=8).count() == 5
    calls = spark_calls(pages, deep)
    assert rows(structured.api_products(calls), "name") == [("deep",)]
    assert structured.api_nodes_cut(calls, 8).first().cut == 1


def test_json_duplicate_keys_and_types(page_df):
    doc = '{"@type":"Product","name":"no","name":"yes","offers":{"price":1.50},"sku":null,"image":[]}'
    got = structured.jsonld_products(page_df(("http://a.org/", f'<script type="application/ld+json">{doc}</script>'))).first()
    assert (got.name, got.price, got.sku, got.image_url) == ("yes", "1.5", "", "")


def test_api_alias_rules(spark):
    body = '[{"name":" ","title":"TT","price":null,"cost":"5 USD","sku":" ","code":7,"type":{"name":"CC"},"qty":0,"url":3,"link":"/l"}]'
    calls = spark.createDataFrame([("http://a.org/p", body)], "trigger_url string, body string") \
        .withColumn("fetched_at", F.timestamp_seconds(F.lit(0)))
    got = {r.name: r for r in structured.api_products(calls).collect()}
    assert set(got) == {"TT", "CC"}  # a category object with a name counts as a product of its own
    t = got["TT"]
    assert (t.price, t.currency, t.sku, t.category, t.in_stock, t.product_url) == ("", "", "7", "CC", "0", "/l")


def test_generic_cards_only_without_template(page_df):
    template = '<div class="catalog-block-view__item"><a class="dark_link" href="/t">Tee</a></div>'
    generic = '<div class="product-card"><h3>Gee</h3></div>'
    pages = page_df(("http://a.org/1", template + generic), ("http://a.org/2", generic))
    expected = [("http://a.org/1", "Tee"), ("http://a.org/2", "Gee")]
    assert rows(blocks.html_products(pages), "source_url", "name") == expected
    assert rows(blocks.generic_cards(pages), "source_url", "name") == expected[1:]


def test_merge_precedence(spark):
    base = {c: "" for c in structured.PRODUCT_COLUMNS} | {"site": "s", "source_url": "u", "name": "n"}
    made = [spark.createDataFrame([base | {"origin": o, "seq": s}], ", ".join(
        f"{c} {'bigint' if c == 'seq' else 'string'}" for c in structured.PRODUCT_COLUMNS)) for o, s in (("card", 0), ("jsonld", 5), ("api", 9))]
    assert keys.merge_products(*made).first().origin == "api"
    assert keys.merge_products(*made[:2]).first().origin == "jsonld"


def test_latest_delivery_wins(spark):
    df = spark.createDataFrame([("u", "old", 1), ("u", "new", 2), ("v", "x", 1)], "url string, html string, fetched_at int")
    assert rows(latest_pages(df), "url", "html") == [("u", "new"), ("v", "x")]


def test_failed_fetches_are_dropped(spark):
    df = spark.createDataFrame([("http://a.org/1", 404), ("http://a.org/2", None), ("http://a.org/3", 0)], "url string, status int")
    assert scan_pages(df).count() == 2


def test_large_top_k_of_a_hot_group(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), "id")
    got = groups.top_per_group(df, ["g"], [F.desc("id")], 3000)
    expected = {g: sorted((i for i in range(20_000) if (i % 3 > 0) == (g == "hot")), reverse=True)[:3000] for g in ("hot", "cold")}
    for g, ids in expected.items():
        assert [r.id for r in got.where(F.col("g") == g).orderBy("rank").collect()] == ids


def test_sites_are_replaced_alone(spark):
    path = tables.scratch_path(spark, "t")
    make = lambda *r: spark.createDataFrame(list(r), "site string, v int")
    tables.replace_sites(make(("a", 1), ("a", 2), ("b", 3)), path)
    tables.replace_sites(make(("a", 9), ("c", 4)), path)
    assert rows(spark.read.parquet(path), "site", "v") == [("a", 9), ("b", 3), ("c", 4)]


def test_profile_of_a_site_without_contacts(page_df):
    pages = page_df(("http://a.org/", "<title>T</title>"))
    got = dict(rows(profile.site_profile(P.build_pages(pages), P.page_contacts(pages)), "key", "value"))
    assert got == {"domain": "a.org", "site_title": "T", "meta_description": "", "meta_keywords": "", "main_h1": ""}


def test_dictionary_with_a_hot_text(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("t"))
    d = spark.createDataFrame([("same", "X"), ("4", "Y"), ("5", "5")], "src string, dst string")
    got = {r.id: r.t for r in translate.apply_dictionary(df, ["id"], ["t"], d).collect()}
    assert got == {i: "X" if i % 3 == 0 else "Y" if i == 4 else str(i) for i in range(3000)}


def test_language_accuracy(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").where("n_chars >= 200 AND lang IN ('en', 'fr', 'de', 'es')")
    hit = docs.select((translate.detect_language(F.col("text")) == F.col("lang")).cast("int").alias("ok"))
    assert hit.agg(F.avg("ok")).first()[0] > 0.8


def test_pagination_chain_with_loop_and_join(spark):
    edges = [(f"u{i:02}", f"u{i + 1:02}") for i in range(20)] + [("l1", "l2"), ("l2", "l1"), ("z", "u05")]
    got = {r.url: (r.chain, r.position) for r in graph.pagination_chain(spark.createDataFrame(edges, "url string, next_url string")).collect()}
    assert all(got[f"u{i:02}"] == ("u00", i) for i in range(21))
    assert got["l1"] == (None, None) and got["z"] == ("z", 0)


def test_bfs_depth(spark):
    edges = spark.createDataFrame([("http://a/0", "http://a/1"), ("http://a/1", "http://a/2"), ("http://a/0", "http://a/2"),
                                   ("http://a/2", "http://a/0"), ("http://a/2", "http://a/3")], "from_url string, to_url string")
    seeds = spark.createDataFrame([("http://a/0",)], "url string")
    assert rows(graph.bfs_depth(edges, seeds, 9), "url", "depth") == [
        ("http://a/0", 0), ("http://a/1", 1), ("http://a/2", 1), ("http://a/3", 2)]
    assert graph.bfs_depth(edges, seeds, 9, max_pages=2).count() == 2


def test_frontier_priorities(spark):
    c = spark.createDataFrame([
        ("a.org", "http://a.org/l", "link", 1, "1"), ("a.org", "http://a.org/n", "pagination", 5, "2"),
        ("a.org", "http://a.org/seen#x", "seed", 0, "3"), ("a.org", "http://b.org/", "link", 0, "4"),
        ("a.org", "http://a.org/s", "sitemap", 0, "5"), ("a.org", "http://a.org/s#f", "link", 0, "6")],
        "site string, url string, kind string, depth int, seq string")
    seen = spark.createDataFrame([("http://a.org/seen",)], "url string")
    got = graph.frontier_round(c, seen, 2).orderBy("rank").collect()
    assert [(r.url, r.kind) for r in got] == [("http://a.org/n", "pagination"), ("http://a.org/s", "sitemap")]


def test_malformed_landed_files(spark):
    maps = spark.createDataFrame([("a.org", "/s", "<urlset><url><loc>http://a.org/1</loc>"), ("a.org", "/t", None)], "site string, path string, xml string")
    assert landed.sitemap_urls(maps).count() == 0 and landed.sitemap_children(maps).count() == 0


def test_rows_of_one_url_never_mix(page_df):
    card = '<div class="product-card"><h3>%s</h3><span class="price">%s</span></div>'
    pages = page_df(("http://a.org/", card % ("One", "$5")), ("http://a.org/", "<p>x</p>" + card % ("Two", "$6") + card % ("Three", "$7")))
    assert rows(blocks.html_products(pages), "name", "price") == [("One", "$5"), ("Three", "$7"), ("Two", "$6")]
    assert rows(dom.html_elements(pages).where("tag = 'h3'"), "start_pos", "end_pos") == [(1, 3), (4, 6), (12, 14)]


def test_entities_of_the_last_delivery(spark):
    made = spark.createDataFrame([("http://a.org/", "<title>old</title><a href='mailto:old@x.org'>m</a>", 1),
                                  ("http://a.org/", "<title>new</title><a href='mailto:new@x.org'>m</a>", 2)], "url string, html string, fetched_at int")
    pages = scan_pages(made.withColumn("fetched_at", F.timestamp_seconds("fetched_at")))
    e = site_build.build_entities(pages, spark_calls(made, "{}").withColumn("content_type", F.lit("x")).where("false"))
    assert rows(e.pages, "title") == [("new",)] and rows(e.contacts, "value") == [("new@x.org",)]


def test_addresses_written_with_references(page_df):
    pages = page_df(("http://a.org/", '<a href="mailto:info&#64;ex.org">m</a> z&#x40;ex.org'))
    assert rows(P.page_contacts(pages), "type", "value") == [("email", "info@ex.org"), ("email", "z@ex.org")]


def test_containers_of_white_space_are_empty(page_df):
    text = "<p>" + "catalog words " * 30 + "</p>"
    blank, full = "\n\t" * 20, "<i>item</i> " * 20
    pages = page_df(*[(f"http://a.org/{i}", f'<div class="product-list">{x}</div>{text}') for i, x in enumerate((blank, full))])
    assert rows(P.needs_render(pages), "url", "needs_render") == [("http://a.org/0", True), ("http://a.org/1", False)]


def test_json_objects_come_depth_first(page_df):
    doc = '[{"@type":"Product","name":"A","rel":[{"@type":"Product","name":"B","offers":{"price":1}}]},{"@type":"Product","name":"B","offers":{"price":2}}]'
    pages = page_df(("http://a.org/", f'<script type="application/ld+json">{doc}</script>'))
    assert rows(keys.merge_products(structured.jsonld_products(pages)), "name", "price") == [("A", ""), ("B", "1")]


def test_classes_inside_drawings_are_counted(page_df):
    pages = page_df(("http://a.org/", '<svg class="icon">' + '<path class="line" d=""/>' * 5 + "</svg>"))
    assert rows(inspect.class_frequency(pages, tags=None, top=30, above=3), "class", "n") == [("line", 5)]


def test_stored_texts_are_whole(page_df):
    long = "word " * 20_000
    pages = page_df(("http://a.org/", f"<main>{long}</main><a href='/x'>{long}</a><div class='service'><h2>Name</h2><p>{long}</p></div>"))
    assert P.build_pages(pages).first().raw_text == long.strip()
    assert P.page_links(pages).first().text == long.strip() == blocks.page_services(pages).first().description
    text = spark_calls(pages, '{"name":"n1","description":"%s"}' % long.strip())
    assert structured.api_products(text).first().description == long.strip()


def test_many_cards_on_a_page(page_df):
    cards = "".join(f'<div class="catalog-block-view__item"><a class="dark_link" href="/{i}">Item {i}</a><p>open</div>' for i in range(3000))
    assert blocks.template_cards(page_df(("http://a.org/", cards))).count() == 3000


def test_language_of_the_whole_text(column):
    text = "xyz " * 400 + "the house of the man and the dog is in the garden"
    assert column([text], translate.detect_language) == ["en"]


def test_translated_names_that_collide(spark):
    products = spark.createDataFrame([("s", "u", "b", "2"), ("s", "u", "a", "1"), ("s", "v", "a", "3")], "site string, source_url string, name string, price string") \
        .withColumn("description", F.lit(""))
    company = spark.createDataFrame([("s", "org_name", "a"), ("s", "domain", "a")], "site string, key string, value string")
    d = spark.createDataFrame([("a", "X"), ("b", "X")], "src string, dst string")
    out, org = translate.translate_tables({"products": products}, company, d)
    assert rows(out["products"], "source_url", "name", "price") == [("u", "X", "1"), ("v", "X", "3")]
    assert rows(org, "key", "value") == [("domain", "a"), ("org_name", "X")]


def test_machine_local_folders_are_refused_on_a_cluster():
    tables.refuse_machine_local("file:/home/x", "local[4]")
    tables.refuse_machine_local("hdfs://n/home/x", "yarn")
    with pytest.raises(ValueError):
        tables.refuse_machine_local("file:/home/x", "spark://host:7077")


def test_reports_survive_storage(page_df, spark):
    pages = page_df(("http://a.org/", "<title>T</title><h1>H</h1><p>mail a@b.org</p>"))
    built, contacts = P.build_pages(pages), P.page_contacts(pages)
    sections = {s: contacts.where("false").select("site", *[F.lit("").alias(c) for c in cols]) for s, cols in reports.SECTIONS.items()}
    report = reports.json_report(profile.site_profile(built, contacts), sections | {"pages": built, "contacts": contacts})
    path = tables.scratch_path(spark, "report")
    reports.write_json_report(report, path)
    assert reports.read_report(spark, path).exceptAll(report).count() == 0
    assert tuple(reports.report_totals(report).first()) == ("a.org", 1, 1)
    lines = reports.markdown_lines(profile.site_profile(built, contacts), built, contacts, sections["products"].withColumn("seq", F.lit(0)), sections["services"])
    reports.write_markdown(lines, path + "-md")
    shown = [r.line for r in lines.orderBy("section", "ord_no", "ord_text", "sub").collect()]
    assert sorted(r.line for r in spark.read.json(path + "-md").collect()) == sorted(shown) and "- a@b.org" in shown


# --- elements of large pages, furniture by class, innermost elements --------------------------


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def random_page(rng, size):
    tags = ("p", "div", "b", "i", "li", "ul", "br", "img", "span", "td", "table", "section")
    out = []
    for _ in range(rng.randint(0, size)):
        tag, r = rng.choice(tags), rng.random()
        mark = rng.choice(("x", "top-header", "menu", "price", ""))
        out.append(f'<{tag} class="{mark}">' if r < 0.45 else f"</{tag}>" if r < 0.8 else f"text {rng.randint(1, 9999)} ")
    return "".join(out)


def plain_elements(toks):
    """Extents by one stack per kind, then ends of unclosed elements from all intervals."""
    open_tags, found, events = {}, {}, []
    for p, t in enumerate(toks):
        m = re.match(r"</?([a-z]+)", t)
        if m:
            tag = m[1]
            events.append(p)
            if t.startswith("</"):
                if tag not in dom.H.VOID_TAGS and open_tags.get(tag):
                    found[open_tags[tag].pop()][1] = p
            else:
                found[p] = [tag, p if tag in dom.H.VOID_TAGS else None]
                if tag not in dom.H.VOID_TAGS:
                    open_tags.setdefault(tag, []).append(p)
    last, out = max(events, default=-1) + 1, []
    for s, (tag, e) in found.items():
        if e is None:
            around = [f for q, (_, f) in found.items() if f is not None and q < s <= f]
            following = [q for q, (other, _) in found.items() if other == tag and q > s] if tag in dom.IMPLIED_END else []
            e = min([last, *[a - 1 for a in around], *[q - 1 for q in following]])
        out.append((s, e, tag))
    return sorted(out)


@pytest.fixture(scope="module")
def tangled(page_df):
    rng = random.Random(11)
    pages = [(f"http://h{k}.example/", random_page(rng, 70)) for k in range(150)]
    return page_df(*pages, ("http://none.example/", None), ("http://empty.example/", ""))


def test_elements_equal_plain_version(tangled):
    toks = {r.url: r.toks for r in dom.tokenized(tangled).collect()}
    got = {}
    for r in dom.page_dom(tangled).collect():
        got[r.url] = sorted((e.s, e.e, e.tag) for e in r.els)
        starts = [e.s for e in r.els]
        assert [e.i for e in r.els] == list(range(1, len(r.els) + 1))
        assert [e.n for e in r.els] == [0 if e.void else sum(e.s < s <= e.e for s in starts) for e in r.els]
    assert got == {u: plain_elements(t) for u, t in toks.items()}


def test_innermost_equals_plain_version(tangled):
    for r in dom.innermost(dom.page_dom(tangled), F.filter(F.transform("toks", lambda t, i: F.when(F.startswith(t, F.lit("text")), i)),
                                                            lambda i: i.isNotNull())).collect():
        for place in r.inner:
            around = [e.i for e in r.els if not e.void and e.s <= place.pos <= e.e]
            assert place.i == (max(around) if around else None)


def test_dropped_subtrees_equal_plain_version(tangled):
    got, want = {}, {}
    for r in dom.drop_subtrees(tangled, ("ul", "section")).collect():
        got.setdefault(r.url, []).append(r.pos)
    for r in dom.tokenized(tangled).collect():
        depth = 0
        for p, t in enumerate(r.toks):
            m = re.match(r"</?(?:ul|section)[\s>]", t)
            if m:
                depth = max(0, depth + (-1 if t.startswith("</") else 1))
            elif depth == 0:
                want.setdefault(r.url, []).append(p)
    assert {u: sorted(p) for u, p in got.items()} == want


def test_furniture_by_class_and_id(page_df, tangled):
    body = "main words " * 12
    html = (f'<html><body class="home"><div class="site-header x"><p>one<div><span>two</span></div></div><ul id="side-nav"><li>three<li>four</ul>'
            f'<div role="main"><p>{body}</p><span class="BreadCrumb">kept</span><img class="menu-icon"><b class="breadcrumbs"><i>five</b> tail</i></div>'
            f'<div class="footer"><div class="footer">six</div>seven</div><header>eight</header></body></html>')
    pages = page_df(("http://a.example/", html))
    assert P.main_text(pages, strip_classes=True).first().raw_text == body + "kept tail"
    assert "five" in P.main_text(pages).first().raw_text  # by tag only, unless asked
    left = "".join(r.tok for r in dom.drop_subtrees(pages, strip_classes=True).orderBy("pos").collect() if r.kind == "text")
    assert left.replace(body, "") == "kept tail"
    kept = {}
    for r in dom.drop_subtrees(tangled, strip_classes=True).collect():
        kept.setdefault(r.url, set()).add(r.pos)
    for r in dom.page_dom(tangled).collect():
        cut = [e for e in r.els if any(w in " ".join(e.classes) for w in ("header", "menu"))]
        assert kept.get(r.url, set()) == {p for p in range(len(r.toks)) if not any(e.s <= p <= e.e for e in cut)}


def listing(n):
    card = ('<div class="catalog-block-view__item" data-id="{0}"><div class="item-title"><a class="dark_link" href="/p/{0}">Name {0}</a></div><p>a<p>b'
            '<div class="price"><span class="price_value">{0}</span></div></div>')
    return "<html><body>" + "".join(card.format(i) for i in range(n)) + "</body></html>"


def seconds(page_df, operator, n):
    pages = page_df(("http://a.example/", listing(n)))
    start = time.perf_counter()
    operator(pages).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


@pytest.mark.parametrize("operator", (dom.html_elements, blocks.template_cards, inspect.price_like_nodes, dom.drop_subtrees))
def test_large_pages_take_linear_time(page_df, operator):
    seconds(page_df, operator, 50)  # compiled code
    small, large = (min(seconds(page_df, operator, n) for _ in range(2)) for n in (2000, 4000))
    assert large < 10 and large < 2.3 * small + 0.5


# --- graph, replace, sketches, numbers ------------------------------------------------------------


def test_bfs_depth_of_random_graphs_and_a_long_chain(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)} | {(1000 + i, 1001 + i) for i in range(25)}
    depth, frontier = {0: 0, 5: 0, 1000: 0}, [0, 5, 1000]
    while frontier:
        reached = {t for s, t in edges if s in frontier and t not in depth}
        depth |= dict.fromkeys(reached, max(depth[f] for f in frontier) + 1)
        frontier = list(reached)
    df = spark.createDataFrame([(f"http://a/{s}", f"http://a/{t}") for s, t in edges], "from_url string, to_url string")
    seeds = spark.createDataFrame([(f"http://a/{i}",) for i in (0, 5, 1000)], "url string")
    assert rows(graph.bfs_depth(df, seeds), "url", "depth") == sorted((f"http://a/{u}", d) for u, d in depth.items())
    assert rows(graph.bfs_depth(df, seeds, 2), "depth")[-1] == (2,)
    assert graph.bfs_depth(df, seeds.limit(0)).count() == 0
    assert rows(graph.bfs_depth(df.limit(0), seeds), "depth") == [(0,)] * 3


def test_a_level_reads_only_its_buckets(spark, monkeypatch):
    df = spark.createDataFrame([(f"http://a/{i}", f"http://a/{i + 1}") for i in range(20)], "from_url string, to_url string")
    seen = []
    monkeypatch.setattr(graph, "_buckets", lambda d, real=graph._buckets: seen.append(real(d)) or seen[-1])
    graph.bfs_depth(df, spark.createDataFrame([("http://a/0",)], "url string")).count()
    assert all(len(b) <= 1 for b in seen[1:])  # all but the list of buckets that have edges


def test_replace_computes_its_input_once(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([("a.org", "1"), ("b.org", "2")], "site string, v string").mapInArrow(counted, "site string, v string")
    tables.replace_sites(df, f"{tmp_path}/t")
    tables.replace_sites(df.where("site = 'a.org'"), f"{tmp_path}/t")
    assert counter.value == 4
    assert rows(spark.read.parquet(f"{tmp_path}/t"), "site", "v") == [("a.org", "1"), ("b.org", "2")]


def test_sketches_of_two_loads(spark):
    def load(low, high):
        ids = spark.range(low, high)
        pages = ids.selectExpr("if(id % 3 = 0, 'small.org', 'big.org') AS site", "concat('u', id) AS url")
        names = ids.selectExpr("'big.org' AS site", "concat('n', id % 50000) AS name")
        return profile.count_sketches(pages, names, names.limit(0), spark.createDataFrame([], "site string, api_url string"))

    got = {r.site: r for r in profile.approximate_counts(profile.merged_sketches(load(0, 60_000), load(40_000, 100_000))).collect()}
    assert abs(got["big.org"].pages - 66_666) < 0.03 * 66_666 and abs(got["small.org"].pages - 33_334) < 0.03 * 33_334
    assert abs(got["big.org"].products - 50_000) < 0.03 * 50_000 and got["big.org"].services == 0 and got["small.org"].products == 0


def test_price_numbers(column):
    from decimal import Decimal

    from pagelake.functions import prices

    cases = {"1 234,56 ₽": "1234.56", "$1,234.56": "1234.56", "1.234,56 €": "1234.56", "1234.56": "1234.56", "1'234.50": "1234.50", "от 990 руб.": "990",
             "1.234": "1234", "1,5": "1.50", "1.234.567": "1234567", "1,234,567.8": "1234567.80", "12.3456": "12.35", "0,999": "999", "no price": None,
             None: None, "": None, "1 000 000,01": "1000000.01", "3 for 2": "3", "-5,00": "5.00", "9" * 40: None}
    got = column(list(cases), prices.price_number)
    assert got == [None if v is None else Decimal(v).quantize(Decimal("0.01")) for v in cases.values()]
    assert column(["1.234", "1,234", "0,999"], lambda c: prices.price_number(c, ",")) == [Decimal("1234.00"), Decimal("1.23"), Decimal("1.00")]
