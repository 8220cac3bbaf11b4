"""Document fingerprints: one-permutation MinHash with optimal densification, in column expressions only.

The hashes of a text's five-word shingles (lower case, split at white space; a shorter text is one shingle) are
binned once by their high bits, and each of 128 bins keeps its least hash. An empty bin takes over the value of
the filled bin that comes first in its own hashed order of bins. The low eight bits of every bin, packed as hex,
are the fingerprint; the likeness of two fingerprints is their share of equal bins, corrected for chance.

Defined results: a null text counts as empty; a text without words has the empty fingerprint, which is like
another empty one (1) and unlike any other (0); equal texts have equal fingerprints; documents with one id are
ordered by a hash of the text, null ids come first; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
BIN_BITS, CODE_BITS = 7, 8
BINS = 1 << BIN_BITS
BUCKET_ROWS, MOST_BUCKETS, COARSE = 2_000, 100_000, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def bin_of(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS).cast("int")


def code_of(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << CODE_BITS) - 1)))), CODE_BITS // 4, "0")


def packed_bins(hashes: Column) -> Column:
    """Hex codes of all bins from sorted hashes: the first of every bin, the empty ones filled up."""
    def filled_up(least: Column) -> Column:
        own = F.transform(least, lambda m: F.struct(bin_of(m).alias("bin"), code_of(m).alias("code")))
        empty = F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), F.transform(least, bin_of))
        taken = F.transform(empty, lambda j: F.struct(j.alias("bin"), code_of(F.array_min(F.transform(
            least, lambda m: F.struct(F.xxhash64(j, bin_of(m)).alias("order"), m.alias("value"))))["value"]).alias("code")))
        return F.array_join(F.transform(F.sort_array(F.concat(own, taken)), lambda b: b["code"]), "")

    return let(hashes, lambda s: let(
        F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))), filled_up))


def shingle_hashes(words: Column) -> Column:
    """Hashes of the runs of five words, given the hashes of the words."""
    runs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))),
                       lambda h, i: F.xxhash64(h, *(F.get(words, i + k) for k in range(1, SHINGLE))))
    return F.when(F.size(words) < SHINGLE, F.array(F.xxhash64(words))).otherwise(runs)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a whole text: 256 hex digits, or nothing for a text without words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(
        F.size(h) == 0, F.lit("")).otherwise(packed_bins(F.sort_array(shingle_hashes(h)))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, from 0 to 1."""
    digits = CODE_BITS // 4
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * digits + 1, F.lit(digits)) == F.substring(b, i * digits + 1, F.lit(digits))))
    chance = 1 / (1 << CODE_BITS)
    share = (equal / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def with_next(rows: DataFrame, columns: list[str], computed: dict[str, Column] | None = None) -> DataFrame:
    """Each row with ``computed`` and with ``next_*`` of the row after it by (``doc_id``, ``tie``); after the last comes the first.

    Rows are dealt to ranges of ids: coarse quantiles, cut evenly. Every range also gets a copy of the first row
    of the range after it, so the window over a range sees each row's successor. What is ``computed`` comes after the
    dealing: once for a row and once more for each copy.
    """
    computed = computed or {}
    count = rows.count()
    if not count:
        return rows.withColumns(computed).select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    edges = rows.agg(F.percentile_approx("doc_id", [i / COARSE for i in range(COARSE + 1)], 10_000)).first()[0] or [0, 0]
    fine = max(1, min(count // BUCKET_ROWS, MOST_BUCKETS) // COARSE)
    lows, highs = F.lit(edges[:-1]), F.lit(edges[1:])

    def placed(part: Column) -> Column:
        lo, hi = F.get(lows, part), F.get(highs, part)
        step = F.floor((F.col("doc_id") - lo).cast("double") * fine / F.greatest(hi - lo, F.lit(1)).cast("double"))
        return part * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), step)).cast("int")

    part = F.greatest(F.lit(0), F.size(F.filter(lows, lambda x: x <= F.col("doc_id"))) - 1)
    # an id that several quantiles name is spread by its ties; null ids are spread alike, before all others
    same = F.size(F.filter(lows, lambda x: x == F.col("doc_id"))) - 1
    share = F.col("tie").cast("double") / 2.0 ** 64 + 0.5
    spread = lambda n: F.least(n - 1, F.floor(share * n)).cast("int")
    dealt = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), spread(F.lit(256)) - 256).when(
        same > 0, (part - same) * fine + spread(same * fine)).otherwise(let(part, placed)))
    # at most MOST_BUCKETS + COARSE + 256 rows
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("f")).select("bucket", "f.doc_id", "f.tie") \
        .orderBy("bucket").collect()
    before = [(firsts[i - 1].bucket, r.bucket, r.doc_id, r.tie) for i, r in enumerate(firsts)]
    kind = rows.schema["doc_id"].dataType.simpleString()
    heads = rows.sparkSession.createDataFrame(before, f"to int, own int, id {kind}, mark bigint")
    copies = dealt.join(F.broadcast(heads), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("mark"))) \
        .dropDuplicates(["own"]).select(*rows.columns, F.col("to").alias("bucket"), F.lit(1).alias("copy"))
    order = Window.partitionBy("bucket").orderBy("copy", "doc_id", "tie")
    both = dealt.withColumn("copy", F.lit(0)).unionByName(copies).repartition("bucket").withColumns(computed)
    return both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("copy = 0").drop("copy", "bucket")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with their likeness.

    The edited text has its second half (the last floor(n/2) code points) replaced by as many first code points of
    the next document.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    paired = with_next(rows, ["text", "fingerprint"], {"fingerprint": fingerprint(F.col("text"))}) \
        .select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
                F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited")) \
        .withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return paired.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
                         likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                         likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
