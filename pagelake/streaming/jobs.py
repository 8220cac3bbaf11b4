"""Incremental versions of the batch jobs.

All three run with ``availableNow``: they take whatever has landed since the last run and stop,
so the same code serves a schedule and a continuous deployment.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keys import last_wins
from ..operators.pages import build_pages, page_contacts
from ..operators.structured import api_products
from ..sources.landed import api_responses, json_responses

COMPACT_EVERY = 16
KEEP_SECONDS = 86_400


def _append(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(target))


def stream_api_responses(landed: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append usable JSON responses as they land. Stateless."""
    return _append(api_responses(landed), target, checkpoint)


def stream_api_products(landed: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the products of new responses; ``merge_products`` settles repeats on read."""
    return _append(api_products(json_responses(landed)), target, checkpoint)


def stream_contacts(pages: DataFrame, target: str, checkpoint: str, late_by: str | None = "30 days") -> StreamingQuery:
    """Append each contact of a page once, however often the page is delivered.

    The pages need ``fetched_at``; the state holds the contacts seen within ``late_by``, so a page that comes again
    later than that gives its contacts again (``contacts_by_type`` settles such repeats on read), and a page that lands
    more than ``late_by`` after a newer one is left to the batch job. With None nothing is too late, and the state holds
    every contact for ever.
    """
    keys = ["site", "page_url", "type", "value"]
    if late_by is None:
        once = page_contacts(pages).dropDuplicates(keys)
    else:
        once = page_contacts(pages.withWatermark("fetched_at", late_by), keep=("fetched_at",)) \
            .dropDuplicatesWithinWatermark(keys)
    return _append(once, target, checkpoint)


def stream_page_upsert(pages: DataFrame, target: str, checkpoint: str, compact_every: int = COMPACT_EVERY,
                       keep_seconds: int = KEEP_SECONDS) -> StreamingQuery:
    """Store page rows of each micro-batch in a folder of its own; ``current_pages`` merges on read.

    A replayed batch overwrites its own folder, so retries change nothing, and no batch rewrites what earlier ones
    stored. After every ``compact_every`` batches the merged state is stored as a snapshot, so a read never merges
    more than one snapshot and that many batches. Folders that the last snapshot but one covers are removed once they are
    ``keep_seconds`` old: no replay needs them, since a batch is only repeated until the next one is planned, and readers
    that listed them have had that long to finish.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        build_pages(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact_pages(spark, target, f"{target}/snapshot_id={batch_id}", batch_id)
            remove_covered(spark, target, keep_seconds)

    return (pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _stored_ids(spark: SparkSession, target: str, kind: str) -> list[int]:
    """Numbers of the complete folders of a kind."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")
                  and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")))


def remove_covered(spark: SparkSession, target: str, keep_seconds: int = KEEP_SECONDS) -> None:
    """Remove batches and snapshots that the last complete snapshot but one covers and that nobody can be reading."""
    snapshots = _stored_ids(spark, target, "snapshot_id")
    if len(snapshots) < 2:
        return
    covering = snapshots[-2]
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    newest = (time.time() - keep_seconds) * 1000
    for folder in fs.listStatus(path):
        kind, _, number = folder.getPath().getName().partition("=")
        covered = kind == "batch_id" and int(number) <= covering or kind == "snapshot_id" and int(number) < covering
        if covered and folder.getModificationTime() <= newest:
            fs.delete(folder.getPath(), True)


def current_pages(spark: SparkSession, target: str, until: int | None = None) -> DataFrame:
    """Latest row per url: the last fetch wins, then the last batch. ``until`` is the last batch that counts."""
    def usable(kind: str) -> list[int]:
        return [i for i in _stored_ids(spark, target, kind) if until is None or i <= until]

    base = max((i for i in usable("snapshot_id") if until is None or i < until), default=-1)
    parts = [spark.read.parquet(f"{target}/batch_id={i}").withColumn("_batch", F.lit(i)) for i in usable("batch_id") if i > base]
    if base >= 0:
        parts.append(spark.read.parquet(f"{target}/snapshot_id={base}").withColumn("_batch", F.lit(base)))
    stored = reduce(DataFrame.unionByName, parts).withColumn("_at", F.coalesce("scraped_at", F.timestamp_seconds(F.lit(0))))
    return last_wins(stored, ["site", "url"], ["_at", "_batch"]).drop("_at", "_batch")


def compact_pages(spark: SparkSession, target: str, compacted: str, until: int | None = None) -> None:
    """Write the merged state to one folder."""
    current_pages(spark, target, until).write.mode("overwrite").parquet(compacted)
