"""Text clean-up and pattern extraction as Spark column expressions."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# The contact patterns that define the results.
EMAIL_LOCAL = r"[a-zA-Z0-9._%+\-]"
EMAIL_DOMAIN = r"[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?U)(?:\+?[78][\s\-]?)?(?:\(?\d{3}\)?[\s\-]?)?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"
PHONE_DIGITS = (7, 12)
PHONE_NOISE = ("2016", "2017", "2026", "322774")

# A run of address characters gives the same verdict from every start inside it,
# so a match may only begin at the start of a run or right after the last match.
# This keeps the scan linear on long unbroken runs (inline data, minified code).
EMAIL = rf"(?:\G|(?<!{EMAIL_LOCAL})){EMAIL_LOCAL}++@{EMAIL_DOMAIN}"

# Unicode white space plus the four separators that Java leaves out of \s, written out
# because the Unicode mode of \s is much slower. Single spaces are not matched: they stay.
SPACE = r"\t-\r\x1c-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# Characters of two wide ranges without white space are told by one look, before the long class is tried.
NO_SPACE = r"(?![!-~\xA1-\u167F])"
SPACES = rf"{NO_SPACE}(?:[{SPACE}]{{2,}}|[{SPACE}&&[^ ]])"
CLEAN = f"x -> trim(regexp_replace(coalesce(x, ''), r'{SPACES}', ' '))"
# the characters of SPACE one by one
SPACE_CHARS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Character references of the HTML standard that occur in page text.
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "iexcl": "¡", "cent": "¢", "pound": "£", "curren": "¤", "yen": "¥", "sect": "§",
    "copy": "©", "laquo": "«", "not": "¬", "shy": "­", "reg": "®", "deg": "°",
    "plusmn": "±", "para": "¶", "middot": "·", "raquo": "»", "frac12": "½",
    "iquest": "¿", "times": "×", "divide": "÷", "agrave": "à", "aacute": "á",
    "acirc": "â", "auml": "ä", "ccedil": "ç", "egrave": "è", "eacute": "é",
    "ecirc": "ê", "iacute": "í", "ntilde": "ñ", "oacute": "ó", "ocirc": "ô",
    "ouml": "ö", "uacute": "ú", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü",
    "szlig": "ß", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bdquo": "„", "bull": "•", "hellip": "…",
    "lsaquo": "‹", "rsaquo": "›", "euro": "€", "trade": "™", "larr": "←",
    "rarr": "→", "numero": "№",
}


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a Column -> Column function)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(c: Column) -> Column:
    """NULL becomes '', white-space runs become one space, ends are trimmed."""
    return let_sql(c, CLEAN)


def strip_text(c: Column) -> Column:
    """Remove white space at both ends only."""
    return F.trim(c, F.lit(SPACE_CHARS))


def let_sql(value: Column, function: str) -> Column:
    """Like ``let`` with the body as a SQL lambda, for the larger expressions.

    The text is parsed in one step, while a Column body costs a driver round trip per operator.
    """
    return F.element_at(F.call_function("transform", F.array(value), F.expr(function)), 1)


def built_once(make):
    """Keep the Column of a parameterless builder for the lifetime of the JVM it lives in.

    A Column over named columns can serve any number of plans; building a large one takes
    thousands of driver round trips.
    """
    kept: dict[int, Column] = {}

    @functools.wraps(make)
    def column() -> Column:
        gateway = id(SparkContext._gateway)
        if gateway not in kept:
            kept[gateway] = make()
        return kept[gateway]

    return column


def _decode_sql() -> str:
    pairs = "\n".join(f"{k}\t{v}" for k, v in NAMED_ENTITIES.items()).replace("'", "\\'")
    # more than seven digits is never a code point (and would overflow conv)
    code = "conv(substring(r, if(substring(r, 2, 1) in ('x', 'X'), 3, 2)), if(substring(r, 2, 1) in ('x', 'X'), 16, 10), 10)"
    char = f"""
      CASE WHEN NOT startswith(r, '#') THEN try_element_at(str_to_map('{pairs}', '\n', '\t'), r)
           WHEN length(r) <= 9 THEN element_at(transform(array(cast({code} AS int)), n ->
             CASE WHEN n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111
                  THEN decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END), 1) END"""
    piece = f"""
      element_at(transform(array(regexp_extract(p, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);', 1)), r ->
        coalesce(concat({char}, substring(p, length(r) + 2)), concat('&', p))), 1)"""
    return f"""x -> CASE WHEN contains(x, '&') THEN
      array_join(transform(split(x, '&'), (p, i) -> CASE WHEN i = 0 THEN p ELSE {piece} END), '') ELSE x END"""


DECODE = _decode_sql()


def decode_entities(c: Column) -> Column:
    """Resolve named and numeric character references once, left to right."""
    return let_sql(c, DECODE)


def extract_emails(c: Column) -> Column:
    """Distinct lower-cased e-mail addresses in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def digit_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\D", ""))


def extract_phones(c: Column) -> Column:
    """Distinct cleaned phone-like strings holding 7 to 12 digits."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PHONE), F.lit(0))
    kept = F.filter(found, lambda x: digit_count(x).between(*PHONE_DIGITS))
    return F.array_distinct(F.transform(kept, clean_text))


def plausible_phone(c: Column, noise: Sequence[str] = PHONE_NOISE) -> Column:
    """True when at least 7 digits are present and no known noise substring is."""
    ok = digit_count(c) >= PHONE_DIGITS[0]
    for n in noise:
        ok = ok & ~F.contains(c, F.lit(n))
    return ok


def strip_site_suffix(title: Column, site: Column) -> Column:
    """Drop a trailing ' - site' or ' – site' from a title."""
    t = strip_text(F.coalesce(title, F.lit("")))
    head = strip_text(F.left(t, F.length(t) - F.length(site)))
    dashed = F.endswith(t, site) & F.right(head, F.lit(1)).isin("-", "–")
    return F.when(dashed, strip_text(F.left(head, F.length(head) - 1))).otherwise(t)


def page_heading(title: Column, h1: Column, url: Column, site: Column, markdown: bool = False) -> Column:
    """Heading of a page in a report, with the fallbacks of the two report kinds."""
    def or_none(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    choices = [or_none(strip_site_suffix(title, site))]
    if markdown:
        choices.append(or_none(strip_text(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?s) [-–] .*\z", ""))))
    return F.coalesce(*choices, or_none(h1), url)


def truncate_with_rest(c: Column, n: int) -> Column:
    """struct(head, rest): the first n characters and how many were left over."""
    t = F.coalesce(c, F.lit(""))
    return F.struct(
        F.left(t, F.lit(n)).alias("head"),
        F.greatest(F.length(t) - n, F.lit(0)).alias("rest"),
    )


def chunk_text(c: Column, size: int = 4500, limit: int | None = 27000) -> Column:
    """Whole text as array<struct(start, chunk, within)>.

    ``within`` tells whether the chunk starts inside the first ``limit`` characters, the
    part that is handed to a translator; a chunk never straddles the limit.
    """
    t = F.coalesce(c, F.lit(""))
    starts = F.when(
        F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size))
    ).otherwise(F.array().cast("array<int>"))
    inside = (lambda i: F.lit(True)) if limit is None else (lambda i: i < limit)
    return F.transform(
        starts,
        lambda i: F.struct(i.alias("start"), F.substring(t, i + 1, F.lit(size)).alias("chunk"), inside(i).alias("within")),
    )


# Words and character classes of the page-text noise rules.
HOME_WORD = "Главная"
TAIL_LINKS = r"Условия\s+оплаты|Условия\s+доставки|Возврат|Главная|Наверх"
TAIL_ENDS = ("оплаты", "доставки", "Возврат", "Главная", "Наверх")
MORE_WORDS = r"Показать\s+еще"
MENU_FIRST = "А-ЯA-ZЁ№"
MENU_CHARS = "а-яa-zА-ЯA-ZЁ«»\"№\\p{Nd}"
MENU_MIN_ITEMS = 4
MENU_MAX_REST = 30


def _menu_tail_length(text: Column) -> Column:
    """Length of the trailing run of at least four short capitalised menu items, else 0.

    A menu item is a space, a capital and 1 to 30 further letters, digits, quotes or spaces.
    Reading the words from the right keeps, for each capital within reach, the largest number
    of items that fit between it and the end, so the work is linear in the length of the tail
    (a nested-quantifier pattern would try every way of splitting it).
    """
    # the run at the end is the one at the start of the reversed text, so the rest is not searched
    run = F.reverse(F.regexp_extract(F.reverse(text), rf"\A[ {MENU_CHARS}]+", 0))
    tail = F.regexp_replace(run, r"\A[^ ]*", "")
    words = F.reverse(F.split(F.substring(tail, 2, 1 << 30), " "))
    state = F.struct(
        F.lit(0).alias("behind"),  # characters to the right of the current word
        F.array().cast("array<struct<at:int,items:int>>").alias("near"),
        F.lit(0).alias("cut"),
    )

    def step(s: Column, w: Column) -> Column:
        at = s["behind"] + F.length(w)  # offset of the word's first character from the end
        reachable = F.filter(s["near"], lambda n: (at - n["at"] - 2).between(1, MENU_MAX_REST))
        via = F.array_max(F.transform(reachable, lambda n: n["items"])) + 1
        last = F.when((at - 1).between(1, MENU_MAX_REST), F.lit(1))
        items = F.when(w.rlike(f"^[{MENU_FIRST}]"), F.greatest(via, last))
        near = F.filter(s["near"], lambda n: at - n["at"] <= MENU_MAX_REST + 1)
        grown = F.when(
            items.isNotNull(), F.array_append(near, F.struct(at.alias("at"), items.alias("items")))
        ).otherwise(near)
        cut = F.when(items >= MENU_MIN_ITEMS, at + 1).otherwise(s["cut"])
        return F.struct((at + 1).alias("behind"), grown.cast("array<struct<at:int,items:int>>").alias("near"), cut.alias("cut"))

    # the widening cast to nullable fields keeps the accumulator type stable between steps
    kind = "struct<behind:int,near:array<struct<at:int,items:int>>,cut:int>"
    folded = F.aggregate(words, state.cast(kind), lambda s, w: step(s, w).cast(kind))
    return F.coalesce(folded["cut"], F.lit(0))


def clean_page_text(c: Column) -> Column:
    """Remove breadcrumbs, trailing navigation, pagination and repeated words from page text."""
    flags = "(?Ud)"
    t = clean_text(c)
    t = strip_text(F.regexp_replace(
        t, rf"{flags}\A.{{0,50}}{HOME_WORD}\s*[—\-]\s*.{{0,200}}(?=\s{{2,}}|\s[А-ЯA-Z][а-яa-z])", ""))
    t = let(t, lambda x: F.when(
        x.rlike(rf"{flags}\A(?:\S+ )?{HOME_WORD}"),
        strip_text(F.regexp_replace(x, rf"{flags}\A[^\n]{{0,300}}{HOME_WORD}[^\n]{{0,200}}\s+", "")),
    ).otherwise(x))
    # a pattern that must reach the end is only searched for in texts that end like it; the text has no space there
    linked = lambda x: reduce(Column.__or__, [F.endswith(x, F.lit(w)) for w in TAIL_ENDS])
    t = let(t, lambda x: F.when(linked(x), strip_text(F.regexp_replace(x, rf"{flags}(?:\s*(?:{TAIL_LINKS})){{2,}}\s*\z", ""))).otherwise(x))
    t = let(t, lambda x: strip_text(F.left(x, F.length(x) - _menu_tail_length(x))))
    t = F.regexp_replace(t, rf"{flags}{MORE_WORDS}\s*[\d\s]*", "")
    t = strip_text(let(t, lambda x: F.when(
        F.right(strip_text(x), F.lit(1)).rlike(rf"{flags}\d"), F.regexp_replace(x, rf"{flags}(?:\s+\d+){{3,}}\s*\z", "")).otherwise(x)))
    return F.regexp_replace(t, rf"{flags}\b(\w{{4,}})\s+(?:\1\s+){{2,}}", "")
