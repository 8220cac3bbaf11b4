"""JSON and Markdown site reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_page_text, page_heading, truncate_with_rest
from ..operators.groups import top_per_group
from ..operators.profile import REPORT_PRODUCTS, REPORT_SERVICES, SHORT_CHARS, info_pages, unique_products, unique_services
from .tables import scratch_path, stored_rows

# columns of the report sections
SECTIONS = {
    "pages": ("url", "title", "h1", "scraped_at"),
    "contacts": ("page_url", "type", "value"),
    "products": ("source_url", "name", "price", "old_price", "currency", "sku", "brand", "category", "description",
                 "image_url", "product_url", "in_stock"),
    "services": ("page_url", "name", "description"),
    "api_calls": ("trigger_url", "api_url"),
}
COMPANY = ("key", "value")


def json_report(profile: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """(site, section, item): the report of every site, one JSON object per row.

    The same shape serves a site with one page and one with a billion. Section ``company`` has the profile facts.
    """
    rows = None
    for name, cols in {"company": COMPANY, **SECTIONS}.items():
        df = profile if name == "company" else sections[name]
        item = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cols]), {"ignoreNullFields": "false"})
        part = df.select("site", F.lit(name).alias("section"), item.alias("item"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def write_json_report(report: DataFrame, path: str) -> None:
    """JSON lines in site, section and item order; files have a normal size whatever the sizes of the sites.

    The rows are stored first, so ranging them does not build them twice.
    """
    order = ["site", "section", "item"]
    stored_rows(report, "report-rows").repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(site, section, item) of a report written by ``write_json_report``."""
    return spark.read.schema("site string, section string, item string").json(path)


def report_section(report: DataFrame, section: str) -> DataFrame:
    """Rows of one section."""
    schema = ", ".join(f"{c} string" for c in {"company": COMPANY, **SECTIONS}[section])
    return report.where(F.col("section") == section).select("site", F.from_json("item", schema).alias("r")).select("site", "r.*")


def _first_names(rows: DataFrame, cols: tuple[str, ...], source: str, limit: int) -> DataFrame:
    """First row per name in the order of pages, then the first ``limit`` of these per site."""
    rest = [c for c in cols if c not in ("name", "description")]
    first = rows.groupBy("site", "name").agg(F.min(F.struct(source, *rest, "description")).alias("r"))
    top = top_per_group(first, ["site"], [F.asc(f"r.{source}"), F.asc("name")], limit)
    cut = truncate_with_rest(F.col("r.description"), SHORT_CHARS)
    return top.select("site", "rank", "name", *[F.col(f"r.{c}").alias(c) for c in rest], cut["head"].alias("description"), cut["rest"].alias("more"))


def top_products(report: DataFrame, limit: int = REPORT_PRODUCTS) -> DataFrame:
    """(site, rank, name, price, description, more): the first products of a report by name."""
    return _first_names(report_section(report, "products"), ("name", "price", "description"), "source_url", limit)


def top_services(report: DataFrame, limit: int = REPORT_SERVICES) -> DataFrame:
    """(site, rank, name, description, more): the first services of a report by name."""
    return _first_names(report_section(report, "services"), ("name", "description"), "page_url", limit)


def report_totals(report: DataFrame) -> DataFrame:
    """(site, pages, contacts): sizes of the two sections."""
    return report.groupBy("site").agg(*[F.count_if(F.col("section") == s).alias(s) for s in ("pages", "contacts")])


# --- Markdown ---------------------------------------------------------------------------

LINE = "struct<sub:int,line:string>"


def _lines(*lines: Column) -> Column:
    """array<struct(sub, line)> of the given lines; NULL lines are left out."""
    rows = F.array(*[F.struct(F.lit(i).alias("sub"), x.alias("line")) for i, x in enumerate(lines)])
    return F.filter(rows.cast(f"array<{LINE}>"), lambda r: r["line"].isNotNull())


def _given(c: Column, line: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", line)


def markdown_lines(profile: DataFrame, pages: DataFrame, contacts: DataFrame, products: DataFrame,
                   services: DataFrame) -> DataFrame:
    """(site, section, ord_no, ord_text, sub, line): report lines in sort order, without any per-site list.

    Section numbers: 0 general, 1-4 contacts (e-mail, phone, address, social), 5 products,
    6 services, 7 page texts. A header sorts first in its section through ord_no -1.
    """
    def emit(df: DataFrame, section: int, ord_no: Column, ord_text: Column, lines: Column) -> DataFrame:
        return df.select("site", F.lit(section).alias("section"), ord_no.cast("bigint").alias("ord_no"),
                         ord_text.alias("ord_text"), F.explode(lines).alias("l")) \
            .select("site", "section", "ord_no", "ord_text", "l.sub", "l.line")

    none, top, row = F.lit(""), F.lit(-1), F.lit(0)
    wide = profile.groupBy("site").agg(*[
        F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
        for k in ("site_title", "meta_description", "org_name", "org_description")])
    title = F.coalesce(*[F.nullif(F.col(k), F.lit("")) for k in ("site_title", "org_name")], F.col("site"))
    out = emit(wide, 0, row, none, _lines(
        F.concat(F.lit("# "), title, F.lit("\n")),
        F.lit("## Общая информация\n"),
        _given(F.col("meta_description"), F.concat("meta_description", F.lit("\n"))),
        _given(F.col("org_description"), F.concat(F.lit("\n"), "org_description", F.lit("\n"))),
        _given(F.col("org_name"), F.concat(F.lit("\n**Организация:** "), "org_name", F.lit("\n"))),
        F.lit("\n## Контакты\n")))

    # the values of the four contact sections come from one aggregate, which the headers share
    headers = {1: "**Email:**", 2: "\n**Телефоны:**", 3: "\n**Адреса:**", 4: "\n**Соцсети:**"}
    social = F.col("type").startswith("social:")
    kind = F.when(F.col("type") == "email", 1).when(F.col("type") == "phone", 2).when(F.col("type") == "address", 3).when(social, 4)
    label = F.when(social, F.expr("concat(substring(type, 8), ': ')")).otherwise(F.concat("value", F.lit("")))
    values = contacts.where(kind.isNotNull()).groupBy("site", kind.alias("section"), label.alias("label")).agg(F.min("value").alias("value"))
    shown = F.when(F.col("section") == 4, F.concat("label", "value")).otherwise(F.col("value"))
    titles = F.create_map(*[F.lit(x) for item in headers.items() for x in item])
    for rows, ord_no, text, line in ((values, row, shown, F.concat(F.lit("- "), shown)),
                                     (values.select("site", "section").distinct(), top, none, titles[F.col("section")])):
        out = out.unionByName(rows.select(
            "site", "section", ord_no.cast("bigint").alias("ord_no"), text.alias("ord_text"), F.lit(0).alias("sub"), line.alias("line")))

    def counted(df: DataFrame, no: int, header: Column, *more: str) -> DataFrame:
        n = df.groupBy("site").agg(F.count(F.lit(1)).cast("string").alias("n"))
        return emit(n, no, top, none, _lines(header, *[F.lit(m) for m in more]))

    def priced(c: str) -> Column:
        return F.when(F.col(c) != "", F.trim(F.concat_ws(" ", c, "currency"))).otherwise(F.lit(""))

    p = unique_products(products)
    cells = F.concat(F.lit("| "), "name", F.lit(" | "), priced("price"), F.lit(" | "), priced("old_price"),
                     F.lit(" | "), "sku", F.lit(" |"))
    s = unique_services(services)
    info = info_pages(pages, "markdown")
    heading = page_heading(F.col("title"), F.col("h1"), F.col("url"), F.col("site"), markdown=True)
    return (
        out
        .unionByName(counted(p, 5, F.concat(F.lit("\n## Товары ("), "n", F.lit(")\n")),
                             "| Название | Цена | Старая цена | Артикул |", "|---|---|---|---|"))
        .unionByName(emit(p, 5, row, F.col("name"), _lines(cells)))
        .unionByName(counted(s, 6, F.concat(F.lit("\n## Услуги ("), "n", F.lit(")\n"))))
        .unionByName(emit(s, 6, row, F.col("name"), _lines(
            F.concat(F.lit("### "), "name", F.lit("\n")),
            _given(F.col("description"), F.concat("description", F.lit("\n"))))))
        .unionByName(emit(info.select("site").distinct(), 7, top, none, _lines(F.lit("\n## Содержимое страниц\n"))))
        .unionByName(emit(info, 7, F.col("url_length"), F.col("url"), _lines(
            F.concat(F.lit("\n### "), heading, F.lit("\n")),
            F.concat(F.lit("**URL:** "), "url", F.lit("\n")),
            clean_page_text(F.col("raw_text")), F.lit(""))))
    )


def write_markdown(lines: DataFrame, path: str) -> None:
    """Report lines in order, one JSON object each; the lines of a site in file order are its report.

    The lines are stored first, so ranging them does not build them twice.
    """
    spark, order = lines.sparkSession, ["site", "section", "ord_no", "ord_text", "sub"]
    kept = scratch_path(spark, "lines")
    lines.write.parquet(kept)
    spark.read.schema(lines.schema).parquet(kept).repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("site", "line").write.mode("overwrite").json(path)
