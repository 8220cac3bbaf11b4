"""Translation of stored texts by a dictionary table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip_text
from .keys import first_wins

TEXT_COLUMNS = {
    "pages": ("title", "description", "h1", "raw_text"),
    "products": ("name", "description"),
    "services": ("name", "description"),
}
# what identifies a row, and the translated column that is part of its key
ROW_KEYS = {"pages": (["site", "url"], None), "products": (["site", "source_url"], "name"), "services": (["site", "page_url"], "name")}
ORG_KEYS = ("org_name", "org_description")
MIN_CHARS = 20

# Frequent function words per language, for telling languages apart.
STOP_WORDS = {
    "de": ("aber", "als", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine",
           "einen", "einer", "er", "es", "für", "hat", "ich", "im", "in", "ist", "mit", "nach", "nicht", "sich",
           "sie", "sind", "und", "vom", "von", "war", "was", "wie", "wir", "zu", "zum", "zur"),
    "en": ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her", "his",
           "in", "is", "it", "not", "of", "on", "or", "that", "the", "their", "they", "this", "to", "was", "we",
           "were", "which", "will", "with", "you"),
    "es": ("al", "como", "con", "de", "del", "el", "en", "entre", "es", "esta", "fue", "ha", "la", "las", "lo", "los",
           "más", "no", "o", "para", "pero", "por", "que", "se", "ser", "si", "sin", "sobre", "son", "su", "sus",
           "un", "una", "y"),
    "fr": ("à", "au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "ils",
           "je", "la", "le", "les", "mais", "ne", "nous", "on", "ou", "par", "pas", "plus", "pour", "qui", "que",
           "sa", "se", "ses", "son", "sont", "sur", "un", "une", "vous"),
}


def distinct_texts(tables: Mapping[str, DataFrame], company: DataFrame) -> DataFrame:
    """(text): distinct non-empty values of the translatable columns of all tables."""
    parts = [
        df.select(F.explode(F.array(*TEXT_COLUMNS[name])).alias("text")) for name, df in tables.items()
    ] + [company.where(F.col("key").isin(*ORG_KEYS)).select(F.col("value").alias("text"))]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.where(F.col("text") != "").distinct()


def detect_language(text: Column, stop_words: Mapping[str, Sequence[str]] = STOP_WORDS,
                    sample_chars: int | None = None) -> Column:
    """Language with the most stop words in the text (or its first ``sample_chars``); ties go to the lower code.

    NULL when the text is shorter than 20 characters or holds no stop word.
    """
    sample = strip_text(text if sample_chars is None else F.left(text, F.lit(sample_chars)))
    words = F.split(F.lower(sample), r"[^\p{L}]+")

    def best(w: Column) -> Column:
        scores = [
            F.struct(F.size(F.filter(w, lambda x: x.isin(*stop_words[lang]))).alias("n"), F.lit(-i).alias("i"),
                     F.lit(lang).alias("lang"))
            for i, lang in enumerate(sorted(stop_words))]
        return let(F.array_max(F.array(*scores)), lambda s: F.when(s["n"] > 0, s["lang"]))

    return F.when(F.length(strip_text(F.coalesce(text, F.lit("")))) >= MIN_CHARS, let(words, best))


def is_translatable(text: Column, lang: str = "en") -> Column:
    """True for texts in the source language; undetectable texts are left alone."""
    return F.coalesce(detect_language(text) == lang, F.lit(False))


def apply_dictionary(df: DataFrame, keys: Sequence[str], columns: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """Replace the text of ``columns`` by its dictionary translation where one exists.

    All text columns meet the dictionary in one join on a 256-bit hash, so texts themselves are not join keys; only
    hits go back to their rows. A text that fills many rows is a skewed key, which the adaptive planner splits (the
    dictionary has one row per text). ``keys`` must identify a row.
    """
    cells = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.unhex(F.sha2(c, 256)).alias("h")) for c in columns])).alias("t")) \
        .select(*keys, "t.col", "t.h").where(F.col("h").isNotNull())
    lookup = dictionary.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).select(F.unhex(F.sha2("src", 256)).alias("h"), "dst")
    hits = cells.join(lookup, "h").groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("col", "dst"))).alias("_hit"))
    joined = df.join(hits, list(keys), "left")
    return joined.select(*[
        (F.coalesce(F.try_element_at("_hit", F.lit(c)), F.col(c)) if c in columns else F.col(c)).alias(c)
        for c in df.columns])


def translate_tables(tables: Mapping[str, DataFrame], company: DataFrame, dictionary: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Entity tables and company table with all their texts translated.

    Two names of one page may translate alike; then the first-wins rule is applied again and the row whose original
    name sorts first stays.
    """
    out = {}
    for name, df in tables.items():
        keys, rule = ROW_KEYS[name]
        done = apply_dictionary(df.withColumn("_was", F.col(rule)) if rule else df, keys if not rule else [*keys, "_was"],
                                TEXT_COLUMNS[name], dictionary)
        out[name] = first_wins(done, [*keys, rule], ["_was"]).drop("_was") if rule else done
    return out, translate_company(company, dictionary)


def translate_company(company: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Company table with org_name and org_description translated."""
    org = F.col("key").isin(*ORG_KEYS)
    done = apply_dictionary(company.where(org), ["site", "key"], ["value"], dictionary)
    return company.where(~org).unionByName(done)
