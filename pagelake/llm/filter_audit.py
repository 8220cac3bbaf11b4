"""Interaction of filters: what every filter does in every order, from one wide packed counter per part.

The outcome of a row under all orders depends on little: which filters it fails (its mask) and what its loss would mean
(labelled good, labelled toxic). Every such case maps to one big integer, whose 64-bit fields hold what happens to one row
of that case at each of the 5! * 5 = 600 steps. Adding integers adds all fields at once, and a field cannot run into the
next one as long as a part has fewer than 2^63 rows. Rows are counted per (part, case) on the map side, so a part
gives at most 128 integers to add, whatever share of the rows it holds.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BYTES = 8
BLANK = r"[\x20\x09-\x0D]+"
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in (*OUTCOMES, "shapley"))


def failures(text: Column) -> Column:
    """Mask of the failure conditions that a text alone decides: A (1), B (2), C (4), D (8)."""
    words = F.array_remove(F.split(text, BLANK), "")
    lengths = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    # the one-element arrays keep words from being split again for each use
    few = F.transform(F.array(lengths), lambda x: F.when(x["n"] < 200, 1).otherwise(0)
                      + F.when(100 * x["d"].cast("long") < 50 * x["n"].cast("long"), 2).otherwise(0))[0]
    return few + F.when(100 * capitals.cast("long") > 3 * F.length(text).cast("long"), 4).otherwise(0) \
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


@cache
def packed(mask: int, good: int, toxic: int) -> int:
    """The integer of one row that fails the filters in ``mask``."""
    fields = np.zeros((len(ORDERS), len(FILTERS), len(OUTCOMES)), "<u8")
    for o, order in enumerate(ORDERS):
        gone = 0
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails, here = bool(mask & bit), bool(mask & bit) and not gone
            fields[o, s] = (not gone and not fails, here, fails and gone, mask == bit, here and good, here and toxic)
            gone |= here
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """(120, 5, 6) counts; raises OverflowError where a sum went beyond the last field."""
    size = len(ORDERS) * len(FILTERS) * len(OUTCOMES) * FIELD_BYTES
    return np.frombuffer(total.to_bytes(size, "little"), "<u8").reshape(len(ORDERS), len(FILTERS), len(OUTCOMES)).astype("i8")


def audit_part(cases: pa.Table) -> pa.Table:
    """600 rows of one part from its counted cases (part, mask, good, toxic, n)."""
    total = sum(packed(c["mask"], c["good"], c["toxic"]) * c["n"] for c in cases.to_pylist())
    counts = unpacked(total)
    removed = counts[:, :, OUTCOMES.index("removed")]
    steps = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    shapley = np.zeros(len(FILTERS), "i8")
    np.add.at(shapley, steps.ravel(), removed.ravel())
    names = ["part", "filter_order", "step", *OUTCOMES, "shapley"]
    n = steps.size
    columns = [pa.array([cases.column("part")[0].as_py()] * n, pa.string()),
               pa.array([o for o in ORDERS for _ in FILTERS], pa.string()),
               pa.array(np.tile(np.arange(1, 6, dtype="i4"), len(ORDERS)), pa.int32()),
               *[pa.array(counts[:, :, k].ravel(), pa.int64()) for k in range(len(OUTCOMES))],
               pa.array(shapley[steps].ravel(), pa.int64())]
    return pa.table(columns, names=names)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic), one row per document; E (16) is a text that a smaller doc_id has too."""
    text = F.coalesce("text", F.lit(""))
    facts = stored(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                               F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask")), "facts")
    first = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    again = F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), 16).otherwise(0)
    return facts.join(first, ["digest", "doc_id"], "left").join(flags, "doc_id", "left").select(
        "part", (F.col("mask") + again).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step.

    Null and empty texts have no words and fail A only (and E). Null languages count as the part ''. Rows that
    repeat a doc_id are all counted, and are no copies of each other by that; rows without a doc_id have no smaller one, so
    they never fail E, and are no earlier copy. Of several labels of a document the worst and the best both count: it is
    good or toxic where any label says so. No documents give no rows; further columns are ignored.
    """
    cases = masks(docs, labels).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return cases.groupBy("part").applyInArrow(audit_part, RESULT)
