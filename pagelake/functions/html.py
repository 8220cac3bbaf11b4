"""HTML as column expressions: tokens, attributes, element slices, text and main content.

Everything here works inside one row, so the jobs built on it need no shuffle.
The tag pattern reads quoted attribute values as a unit and uses possessive
quantifiers, so a long tag costs linear time and constant stack.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DECODE, clean_text, decode_entities, let, let_sql, strip_text

TAG = r"</?[a-z][^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+>"
COMMENT = r"<!--.*?(?:-->|\z)"
DECLARATION = r"<(?:[!?]|/(?![a-z]))[^>]*+>"


def _raw_block(tags: str) -> str:
    return rf"<({tags})\b(?![^>]*/>).*?(?:</\1\s*>|\z)"


# script and style bodies are never text; noscript and svg are dropped as well
# everywhere except for the main text, which is read from the untouched page
NON_TEXT = rf"(?is){COMMENT}|{_raw_block('script|style')}|{DECLARATION}"
NON_CONTENT = rf"(?is){COMMENT}|{_raw_block('script|style|noscript|svg')}|{DECLARATION}"
# comments stay in the searched source, script-like blocks do not
SCRIPT_BLOCKS = rf"(?is){_raw_block('script|style|noscript|svg')}"
TOKEN = rf"(?is){COMMENT}|{_raw_block('script|style|noscript|svg')}|{TAG}|{DECLARATION}|[^<]++|<"
OPEN_TOKEN = rf"(?is){COMMENT}|{_raw_block('script|style')}|{TAG}|{DECLARATION}|[^<]++|<"
RAW_OPEN = r"(?i)^<(?:script|style|noscript|svg)\b(?![^>]*/>)"
SCRIPT_OPEN = r"(?i)^<(?:script|style)\b(?![^>]*/>)"
TAG_NAME = r"^</?([a-zA-Z][^\s/>]*)"
ANY_TAG = rf"(?is){TAG}|<!>"

VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
)

# Page furniture, and where the main text is looked for, in this order.
FURNITURE = ("header", "footer", "nav", "aside")
FURNITURE_CLASS_PARTS = ("header", "footer", "menu", "sidebar", "breadcrumb")
FURNITURE_ID_PARTS = ("header", "footer", "nav")
CONTENT_SELECTORS = (
    "main", "article", "[role='main']", "#content", ".content", ".main-content", ".page-content",
    ".entry-content", ".article-content", ".post-content", ".text-content", "#main",
    ".inner-content", ".body-content",
)
CONTENT_MIN_CHARS = 100
RENDER_MIN_CHARS = 200
RENDER_MARKERS = r"(ng-app|data-reactroot|__NEXT_DATA__|__vue|ReactDOM\.render)"
CATALOG_WORDS = r"(?i)(catalog|product-list|goods-list)"
CATALOG_CONTAINERS = (".product-list", ".goods-list", ".catalog__items", "#catalog-items")
CATALOG_MIN_CHARS = 30


def html_token_array(html: Column, raw_blocks: bool = True) -> Column:
    """Ordered tokens: comments, script-like blocks, tags, declarations and text runs.

    Without ``raw_blocks`` only script and style are one token, and the markup inside noscript and svg is read.
    """
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN if raw_blocks else OPEN_TOKEN), F.lit(0))


def token_kind(tok: Column) -> Column:
    return (
        F.when(~F.startswith(tok, F.lit("<")), "text")
        .when(F.startswith(tok, F.lit("<!--")), "comment")
        .when(tok.rlike(r"(?i)^<(script|style|noscript|svg)\b(?![^>]*/>)"), "raw")
        .when(tok.rlike(r"^</[a-zA-Z]"), "close")
        .when(tok.rlike(r"^<[a-zA-Z]"), F.when(token_tag(tok).isin(*VOID_TAGS), "void").otherwise("open"))
        .when(tok.rlike(r"^<[!?/]"), "decl")
        .otherwise("text")
    )


def token_tag(tok: Column) -> Column:
    """Lower-case tag name of a tag token, '' for anything else."""
    return F.lower(F.regexp_extract(tok, TAG_NAME, 1))


def _attr_sql(name: str) -> str:
    lead = r"(?is)^<[^\s>/]+(?:[^>=\"\x27]*=\s*(?:\"[^\"]*\"|\x27[^\x27]*\x27|[^\s\"\x27>]+))*?[^>=\"\x27]*?[\s\"\x27/]"
    value = rf"{lead}{name}\s*=\s*(\"[^\"]*\"|\x27[^\x27]*\x27|[^\s\"\x27>]+)"
    bare = rf"{lead}{name}(\s*=)?\s*[/>\s]"
    unquoted = "if(left(v, 1) IN ('\"', '\\''), substring(v, 2, length(v) - 2), v)"
    return f"""t -> CASE WHEN contains(lower(t), '{name}') THEN
      element_at(transform(array(regexp_extract(t, r'{value}', 1)), v ->
        CASE WHEN v <> '' THEN element_at(transform(array({unquoted}), {DECODE}), 1) WHEN t rlike r'{bare}' THEN '' END), 1) END"""


def attr(tok: Column, name: str) -> Column:
    """Decoded attribute value of an open tag; NULL when absent, '' when empty."""
    return let_sql(tok, _attr_sql(name))


def class_list(tok: Column) -> Column:
    """Class names of an open tag, an empty array when it has none."""
    names = F.split(clean_text(attr(tok, "class")), " ")
    return F.filter(names, lambda x: x != "")


def visible_html(html: Column) -> Column:
    """Page source with comments, declarations and script-like blocks replaced by '<!>'."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), NON_CONTENT, "<!>")


def markup_text(markup: Column, separator: str = "") -> Column:
    """Text of already cleaned markup with ``separator`` in place of every tag."""
    return decode_entities(F.regexp_replace(markup, ANY_TAG, separator))


def page_text(html: Column, separator: str = "") -> Column:
    """Cleaned text of a whole page; script and style bodies are left out."""
    return clean_text(markup_text(F.regexp_replace(F.coalesce(html, F.lit("")), NON_TEXT, "<!>"), separator))


def balanced_slice(markup: Column, start: Column, tag: Column) -> Column:
    """Source of the element of ``tag`` that opens at 1-based ``start``, to its matching close."""
    rest = F.substring(markup, start, F.lit(1 << 30))
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"(?:[\s/>]))")))
    kind = "struct<depth:int,size:int,done:boolean>"
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done")).cast(kind)

    def step(s: Column, p: Column) -> Column:
        closing = F.startswith(p, F.lit("</"))
        depth = s["depth"] + F.when(closing, -1).otherwise(1)
        ends = closing & (depth == 0)
        return F.when(s["done"], s).otherwise(
            F.struct(
                depth.alias("depth"),
                (s["size"] + F.when(ends, 0).otherwise(F.length(p))).alias("size"),
                ends.alias("done"),
            ).cast(kind)
        )

    return F.when(tag.isin(*VOID_TAGS), F.lit("")).otherwise(
        F.left(rest, F.aggregate(pieces, zero, step)["size"])
    )


def without_subtrees(markup: Column, tags=FURNITURE) -> Column:
    """Markup without the subtrees of the given tags."""
    names = "|".join(tags)
    pieces = F.split(markup, rf"(?i)(?=</?(?:{names})(?:[\s/>]))")
    kind = "struct<depth:int,kept:array<string>>"
    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept")).cast(kind)
    own_close = rf"(?is)^</(?:{names})[^>]*>"

    def step(s: Column, p: Column) -> Column:
        opens = p.rlike(rf"(?i)^<(?:{names})(?:[\s/>])")
        closes = p.rlike(rf"(?i)^</(?:{names})(?:[\s/>])")
        depth = F.greatest(s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0), F.lit(0))
        body = F.regexp_replace(p, own_close, "<!>")
        kept = F.when(depth == 0, F.array_append(s["kept"], body)).otherwise(s["kept"])
        return F.struct(depth.alias("depth"), kept.alias("kept")).cast(kind)

    return F.array_join(F.aggregate(pieces, zero, step)["kept"], "")


def _attribute_pattern(name: str, value: str, word: bool) -> str:
    """Pattern of an open tag whose attribute equals ``value`` (or holds it as a word)."""
    v = value.replace("-", r"\-")
    if word:
        quoted = [rf"{q}(?:[^{q}]*\s)?{v}(?:\s[^{q}]*)?{q}" for q in ('"', "'")]
    else:
        quoted = [f"{q}{v}{q}" for q in ('"', "'")]
    lead = r"<[a-z][^\s>/]*(?:[^>=\"']*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))*?[^>=\"']*?[\s\"'/]"
    return rf"(?is){lead}{name}\s*=\s*(?:{'|'.join(quoted)}|{v}(?=[\s>/]))"


def selector_pattern(selector: str) -> str:
    """Open-tag pattern of a simple selector: tag, .class, #id or [attr='value']."""
    if selector.startswith("."):
        return _attribute_pattern("class", selector[1:], word=True)
    if selector.startswith("#"):
        return _attribute_pattern("id", selector[1:], word=False)
    if selector.startswith("["):
        name, value = selector.strip("[]").replace("'", "").split("=")
        return _attribute_pattern(name, value, word=False)
    return rf"(?i)<{selector}(?=[\s/>])"


def first_element(markup: Column, pattern: Column) -> Column:
    """Source of the first element whose open tag matches, '' when there is none."""
    at = F.regexp_instr(markup, pattern)
    return let(at, lambda p: F.when(p > 0, balanced_slice(
        markup, p, F.lower(F.regexp_extract(F.substring(markup, p, F.lit(80)), r"^<([a-zA-Z][^\s/>]*)", 1))
    )).otherwise(F.lit("")))


def main_content(html: Column) -> Column:
    """Cleaned main text of a page.

    The first container of the selector list whose first element holds more than 100
    characters, else all text outside header, footer, nav and aside. The text is whole.
    """
    body = without_subtrees(F.regexp_replace(F.coalesce(html, F.lit("")), NON_TEXT, "<!>"))
    # the bare word is a cheap test that spares most pages the attribute patterns
    candidates = F.array(*[
        F.struct(F.lit(re.sub(r"\W", " ", s).split()[-1]).alias("word"), F.lit(selector_pattern(s)).alias("pattern"))
        for s in CONTENT_SELECTORS
    ])

    def pick(markup: Column) -> Column:
        def try_one(low: Column, found: Column, c: Column) -> Column:
            text = clean_text(markup_text(first_element(markup, c["pattern"]), " "))
            return F.when((found != "") | ~F.contains(low, c["word"]), found).otherwise(
                let(text, lambda t: F.when(F.length(t) > CONTENT_MIN_CHARS, t).otherwise(F.lit("")))
            )

        chosen = let(F.lower(markup), lambda low: F.aggregate(
            candidates, F.lit(""), lambda found, c: try_one(low, found, c)))
        return let(chosen, lambda c: F.when(c != "", c).otherwise(clean_text(markup_text(markup, " "))))

    return let(body, pick)


def first_tag(markup: Column, tag: str, name: str | None = None) -> Column:
    """First open tag of a kind, optionally with attribute name=``name`` (any case), else ''."""
    pattern = rf"(?is)<{tag}(?=[\s/>])[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+>"
    if name is None:
        return F.regexp_extract(markup, pattern, 0)
    tags = F.regexp_extract_all(markup, F.lit(pattern), F.lit(0))
    return F.coalesce(F.try_element_at(F.filter(tags, lambda t: F.lower(attr(t, "name")) == name), F.lit(1)), F.lit(""))


def page_title(markup: Column) -> Column:
    """Title text; '' when the title tag holds anything but one text run."""
    body = F.regexp_extract(markup, r"(?is)<title(?=[\s>])[^>]*>(.*?)</title\s*>", 1)
    return F.when(~F.contains(body, F.lit("<")), clean_text(decode_entities(body))).otherwise(F.lit(""))


def first_heading(markup: Column) -> Column:
    return clean_text(markup_text(first_element(markup, F.lit(r"(?i)<h1(?=[\s/>])"))))


def meta_content(markup: Column, name: str) -> Column:
    return clean_text(attr(first_tag(markup, "meta", name), "content"))


def anchors(markup: Column) -> Column:
    """array<struct(pos, href, text)> of all anchors that carry an href."""
    found = F.regexp_extract_all(markup, F.lit(r"(?is)<a(?=[\s/>]).*?(?=</a\b|<a[\s/>]|\z)"), F.lit(0))
    rows = F.transform(
        found,
        lambda a, i: F.struct(
            i.alias("pos"),
            attr(F.regexp_extract(a, rf"(?is)^{TAG}", 0), "href").alias("href"),
            clean_text(markup_text(a)).alias("text"),
        ),
    )
    return F.filter(rows, lambda r: r["href"].isNotNull())


def jsonld_bodies(html: Column) -> Column:
    """array<string>: bodies of <script type="application/ld+json">, in page order."""
    blocks = F.regexp_extract_all(
        F.coalesce(html, F.lit("")), F.lit(rf"(?is){COMMENT}|<script\b.*?</script\s*>"), F.lit(0))
    kept = F.filter(blocks, lambda b: b.rlike(r"(?i)^<script") & F.contains(b, F.lit("ld+json")))
    typed = F.filter(kept, lambda b: attr(F.regexp_extract(b, rf"(?is)^{TAG}", 0), "type") == "application/ld+json")
    return F.transform(typed, lambda b: F.regexp_replace(b, rf"(?is)^{TAG}|</script\s*>$", ""))


def needs_render_quick(html: Column) -> Column:
    """Render flag from the page row alone: empty page, thin text or a client-side framework."""
    empty = F.coalesce(html, F.lit("")) == ""
    return empty | (F.length(page_text(html)) < RENDER_MIN_CHARS) | html.rlike(RENDER_MARKERS)


def needs_render(html: Column) -> Column:
    """Render flag including known catalog containers that came empty."""
    markup = F.regexp_replace(F.coalesce(html, F.lit("")), NON_TEXT, "<!>")
    empty_box = F.lit(False)
    for s in CATALOG_CONTAINERS:
        element = first_element(markup, F.lit(selector_pattern(s)))
        empty_box = empty_box | let(
            element, lambda e: (e != "") & (F.length(strip_text(markup_text(e))) < CATALOG_MIN_CHARS))
    return F.when(needs_render_quick(html), True).when(html.rlike(CATALOG_WORDS), empty_box).otherwise(False)
