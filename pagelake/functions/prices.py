"""Price strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, let

# The price pattern and the ordered currency marks.
PRICE = (
    r"(?iuU)(?:[$€£¥₽₴₸]\s*\d[\d\s,\.]*"
    r"|\d[\d\s,\.]*\s*(?:[$€£¥₽₴₸]|руб\.?|грн\.?|тг\.?|USD|EUR|RUB|UAH|KZT))"
)
CURRENCIES = (
    ("₽", "RUB"), ("руб", "RUB"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"),
    ("₴", "UAH"), ("₸", "KZT"), ("rub", "RUB"), ("usd", "USD"), ("eur", "EUR"),
)


def price_and_currency(c: Column) -> Column:
    """struct(price, currency): the first price-like substring and its currency code."""
    raw = clean_text(F.regexp_extract(F.coalesce(c, F.lit("")), PRICE, 0))
    low = F.lower(raw)
    code = F.lit("")
    for mark, name in reversed(CURRENCIES):
        code = F.when(F.contains(low, F.lit(mark)), name).otherwise(code)
    return F.struct(raw.alias("price"), code.alias("currency"))


def price_number(c: Column, decimal_mark: str | None = None) -> Column:
    """The number in a price text as decimal(18,2), NULL where there is none.

    The first run of digits, marks and blanks counts. Blanks and apostrophes group digits. Of commas and dots, where both occur,
    the last one is the decimal mark; one that occurs several times groups digits; a single one groups digits exactly
    if three digits follow it (``1.234``), unless ``decimal_mark`` says that it is the decimal mark. Digits past the
    second decimal are rounded.
    """
    run = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)\d(?:[\d.,'’\s]*\d)?", 0)
    bare = F.regexp_replace(run, r"(?U)[\s'’]", "")

    def number(x: Column) -> Column:
        mark = F.regexp_extract(x, r"([.,])\d*$", 1)  # the last mark
        both = F.contains(x, F.lit(".")) & F.contains(x, F.lit(","))
        last_again = F.length(x) - F.length(F.replace(x, mark, F.lit(""))) > 1
        three = x.rlike(r"[.,]\d{3}$")
        if decimal_mark is None:
            decimal = (mark != "") & ~last_again & (both | ~three)
        else:
            decimal = (mark == decimal_mark) & ~last_again
        whole = F.when(decimal, F.regexp_replace(x, r"[.,]\d*$", "")).otherwise(x)
        cents = F.when(decimal, F.regexp_extract(x, r"[.,](\d*)$", 1)).otherwise(F.lit(""))
        return F.concat(F.regexp_replace(whole, r"[.,]", ""), F.lit("."), F.when(cents == "", F.lit("0")).otherwise(cents))

    return F.when(run != "", let(bare, number).try_cast("decimal(38,18)").try_cast("decimal(18,2)"))
