"""Landed web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import site_of


TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan that has fewer tasks than there are cores.

    Parsing is CPU-bound, and a table in one small file is one task whatever the cluster size.
    Scans with enough tasks, as of any large table, are left as they are.
    The tasks of a stream are not known before it runs, so its rows are always dealt.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return dealt(df) if df.isStreaming or df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows evenly over several tasks per core, or those of equal ``keys`` to one task.

    The adaptive planner joins the tasks of its own shuffles by their bytes until each core has about one, which is too few
    where a row takes much longer to parse than to read. It leaves these as they are.
    """
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if keys else tasks, *keys)


def scan_pages(df: DataFrame) -> DataFrame:
    """Add ``site`` and drop failed fetches (status 400 and above; unknown status stays)."""
    kept = df.where(F.coalesce(F.col("status"), F.lit(200)) < 400) if "status" in df.columns else df
    return kept.withColumn("site", site_of(F.col("url")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages with ``row_id``, the file and the row that hold a page."""
    rows = spark.read.parquet(path).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("row_id"))
    return scan_pages(spread(rows))


def latest_pages(df: DataFrame, order: str = "fetched_at") -> DataFrame:
    """One row per url, the last delivery wins; without an order column, or among equals, the greatest hash of the markup.

    With ``row_id`` (see ``read_pages``) the winners are found on narrow rows, one per url and task, and fetched by a
    semi-join, so markup is shuffled at most once, and not at all where the winners are few enough to be sent to the tasks.
    Other pages are ranked: a task keeps one row per url before anything is shuffled.
    """
    by = [F.col(order)] if order in df.columns else []
    by.append(F.xxhash64("html"))
    if "row_id" in df.columns:
        best = df.groupBy("url").agg(F.max(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(by)], "row_id")).alias("_best"))
        return df.join(best.select(F.col("_best.row_id").alias("row_id")), "row_id", "left_semi").drop("row_id")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(*[F.desc(c) for c in by]))).where("_n = 1").drop("_n")
