"""Key rules: which row survives when several share a key.

Both rules are plain aggregates, so Spark combines rows on the map side and a key
repeated a billion times reaches its reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# rank of the three product origins: API rows are stored before structured data, cards last
ORIGIN_RANK = {"api": 0, "jsonld": 1, "card": 2}


def order_number(document: Column, item: Column) -> Column:
    """struct(document, item): place of an item inside a document, in the order of both."""
    return F.struct(document.cast("bigint").alias("document"), item.cast("bigint").alias("item"))


def _one_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # equal order values fall back to the row itself, so the result never depends on task timing
    candidate = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(F.lit(0), *rest).alias("_row"))
    out = df.groupBy(*keys).agg(pick(candidate).alias("_best"))
    return out.select(*[c if c in keys else F.col(f"_best._row.{c}").alias(c) for c in df.columns])


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """UNIQUE + INSERT OR IGNORE: keep the row with the lowest order per key."""
    return _one_row(df, keys, order, F.min)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """PRIMARY KEY + INSERT OR REPLACE: keep the row with the highest order per key."""
    return _one_row(df, keys, order, F.max)


def merge_products(*sources: DataFrame) -> DataFrame:
    """Union of product rows, one per (site, source_url, name): API, then JSON-LD, then cards."""
    union = sources[0]
    for s in sources[1:]:
        union = union.unionByName(s)
    rank = F.coalesce(*[F.when(F.col("origin") == o, r) for o, r in ORIGIN_RANK.items()])
    ranked = union.withColumn("_rank", rank)
    return first_wins(ranked, ["site", "source_url", "name"], ["_rank", "seq"]).drop("_rank")
