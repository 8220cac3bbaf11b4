"""Plan checks: no Python workers, no cartesian products, pruned scans, one shuffle of the pages."""

import re

import pytest
from pyspark.sql import functions as F

from pagelake.operators import blocks, dom, facts, inspect, keys, pages as P, structured
from pagelake.plans import fixtures as X, site_build
from pagelake.sources.pages import latest_pages, read_pages, scan_pages

PLANS = {
    "pages": P.build_pages, "contacts": P.page_contacts, "links": P.page_links, "socials": P.page_socials,
    "jsonld": structured.jsonld_products, "products": blocks.html_products, "services": blocks.page_services,
    "next": blocks.next_page, "site_links": site_build.link_profile,
}
NARROW = ("pages", "contacts", "links", "socials", "jsonld")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANS)
def test_core_plans(spark, sf_dir, name):
    plan = plan_of(PLANS[name](scan_pages(X.table(spark, sf_dir, "pages"))))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)
    assert "page_id" not in re.search(r"ReadSchema: (.*)", plan).group(1)
    if name in NARROW:
        assert "Exchange" not in plan


@pytest.mark.parametrize("operator", (dom.html_elements, dom.drop_subtrees, blocks.template_cards, blocks.generic_cards, blocks.html_products,
                                      blocks.page_services, blocks.page_addresses, inspect.card_structure))
def test_elements_stay_in_the_page_row(spark, sf_dir, operator):
    assert "Exchange" not in plan_of(operator(scan_pages(X.table(spark, sf_dir, "pages"))))


def test_site_filter_reaches_the_scan(spark, sf_dir):
    plan = plan_of(P.page_links(scan_pages(X.table(spark, sf_dir, "pages")).where(F.col("url") == "x")))
    assert "EqualTo(url,x)" in plan


def test_markup_is_shuffled_at_most_once(spark, sf_dir, tmp_path):
    pages = X.table(spark, sf_dir, "pages").withColumn("fetched_at", F.timestamp_seconds("page_id"))
    pages.unionByName(pages).repartition(16).write.parquet(f"{tmp_path}/pages")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = facts.page_facts(latest_pages(read_pages(spark, f"{tmp_path}/pages")))
        plan = df._jdf.queryExecution().executedPlan()
        outputs = [x for x in nodes(plan) if x.nodeName() == "Exchange"]
        wide = [x for x in outputs if "html" in x.output().toString()]
        assert len(wide) <= 1 and not re.search("Window|CartesianProduct", plan.toString())
        assert df.count() == pages.count()
        e = site_build.build_entities(read_pages(spark, f"{tmp_path}/pages"), spark.createDataFrame(
            [], "trigger_url string, api_url string, content_type string, body string, fetched_at timestamp"))
        for name in ("pages", "contacts", "products", "services", "links", "org"):
            assert "html" not in plan_of(getattr(e, name))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def nodes(plan):
    """All nodes of an adaptive plan before it runs."""
    todo = [plan.inputPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        node = todo.pop()
        yield node
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]


def test_facts_equal_the_single_extractors(spark, sf_dir):
    """One look at each page finds what the extractors find one by one."""
    pages = X.shop_pages(spark, sf_dir).unionByName(X.jsonld_pages(spark, sf_dir)).unionByName(X.org_pages(spark, sf_dir)).unionByName(
        X.service_pages(spark, sf_dir).select("site", "url", "html")).dropDuplicates(["url"])
    none = spark.createDataFrame([], "trigger_url string, api_url string, content_type string, body string, fetched_at timestamp")
    e = site_build.build_entities(pages, none)

    def same(a, b):
        columns = sorted(a.columns)
        return sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))

    assert same(e.pages, P.build_pages(pages)) and same(e.links, P.page_links(pages)) and same(e.services, blocks.page_services(pages))
    assert same(e.contacts, site_build.all_contacts(pages)) and same(e.org, structured.jsonld_org(pages))
    assert same(e.products, keys.merge_products(structured.jsonld_products(pages), blocks.html_products(pages)))


@pytest.mark.parametrize("name", ["translate_tables", "markdown_products"])
def test_shop_pages_are_parsed_once(spark, sf_dir, name):
    """Products that are read several times are stored first, so no plan of the result holds their parsing."""
    from pagelake.plans import registered

    assert "catalog-block-view" not in plan_of(registered.registered()[name](spark, sf_dir))


def test_report_rows_are_built_once(spark, tmp_path):
    from pagelake.sources import reports

    built = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def item(i):
        built.add(1)
        return str(i)

    rows = spark.range(50).select(F.lit("s").alias("site"), F.lit("pages").alias("section"), item("id").alias("item"))
    reports.write_json_report(rows, str(tmp_path / "report"))
    assert built.value == 50 and reports.read_report(spark, str(tmp_path / "report")).count() == 50


def test_scans_are_dealt_over_several_tasks_per_core(spark, sf_dir):
    from pagelake.sources.pages import spread

    assert spread(X.table(spark, sf_dir, "part")).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_derived_pages_keep_several_tasks_per_core(spark, tmp_path):
    """Their small rows must not be joined into a task per core, as parsing them takes long."""
    parts = spark.range(2000).selectExpr("id p_partkey", "concat('part ', id) p_name", "concat('Brand#', id % 25) p_brand", "'TYPE' p_type",
                                         "int(id % 50) p_size", "double(id) p_retailprice")
    customers = spark.range(2000).selectExpr("id c_custkey", "concat('Customer ', id) c_name", "'HOUSEHOLD' c_mktsegment")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    for pages in (X.shop_pages(spark, str(tmp_path)), X.service_pages(spark, str(tmp_path))):
        assert pages.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        assert pages.groupBy("url").count().where("count > 1").isEmpty()


def test_elements_are_read_by_their_number(page_df):
    """A slice converts the whole page for every block and text."""
    assert "slice(" not in plan_of(blocks.page_services(page_df(("https://a.example/x", "<p>x</p>"))))


def test_markdown_report_covers_all_sites(spark, tmp_path):
    """Addresses, networks and names of organizations, products of item pages and texts of service pages are in the report."""
    from pagelake.plans import registered

    tables = {
        "part": spark.range(4).selectExpr("id p_partkey", "concat('bolt ', id) p_name", "concat('Brand#', id) p_brand", "'SMALL' p_type", "7 p_size", "9.5D p_retailprice"),
        "customer": spark.range(4).selectExpr("id c_custkey", "concat('Customer#', id) c_name", "'HOUSEHOLD' c_mktsegment"),
        "supplier": spark.range(2).selectExpr("id s_suppkey", "concat('Supplier', id) s_name", "1 s_nationkey"),
        "nation": spark.range(2).selectExpr("int(id) n_nationkey", "concat('N', id) n_name"),
        "pages": spark.range(1).selectExpr("id page_id", "'https://a.example/' url", "'<title>A</title><p>x</p>' html"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    lines = registered.registered()["markdown_report"](spark, str(tmp_path)).collect()
    assert {r.site for r in lines} == {
        "a.example", "org0.example.org", "org1.example.org", "svc0.example.com", *(f"brand{i}.example.com" for i in range(4)),
        *(f"shop{i}.example.net" for i in range(4)), *(f"made{i}.example.net" for i in range(4))}

    def shown(site, section):
        return [r.line for r in sorted(lines, key=lambda r: (r.ord_no, r.ord_text, r.sub)) if (r.site, r.section) == (site, section)]

    about = " ".join(["Supplier1"] * 60)
    assert shown("org1.example.org", 0) == ["# About\n", "## Общая информация\n", f"\n{about}\n", "\n**Организация:** Supplier1 Ltd\n", "\n## Контакты\n"]
    assert shown("org1.example.org", 1) == ["**Email:**", "- Info@org1.example.org"]
    assert shown("org1.example.org", 2) == ["\n**Телефоны:**", "- +7 (495) 000-000001", "- 8 800 1"]
    assert shown("org1.example.org", 3) == ["\n**Адреса:**", "- 1 Main St, N1", "- Prop street 1"]
    assert shown("org1.example.org", 4) == ["\n**Соцсети:**", "- Instagram: https://instagram.com/org1"]
    assert shown("shop0.example.net", 5)[3:] == ["| bolt 0 <0> & co | 9.50 USD |  | S-0 |"]
    text, url = "HOUSEHOLD 0 " + "Customer#0 " * 30 + "second HOUSEHOLD 1 HOUSEHOLD 2 short <2> ab dropped", "https://svc0.example.com/s/0"
    assert shown("svc0.example.com", 7) == ["\n## Содержимое страниц\n", f"\n### {url}\n", f"**URL:** {url}\n", text, ""]
