"""Group-wise helpers that stay within bounds when one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# up to this k Spark cuts each group to k rows before the shuffle on its own
GROUP_LIMIT = 1000
SALTS = 64


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank.

    Small k is pruned before the shuffle by Spark. Larger k first takes the top k of salted
    sub-groups in parallel, so the final sort of a hot group sees at most SALTS * k rows.
    """
    if k > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k).drop("_r", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= k)
