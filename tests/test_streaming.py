"""Streams equal their batch twins and survive replays."""

from pyspark.sql import functions as F

from pagelake.operators import pages as P
from pagelake.plans import fixtures as X
from pagelake.sources import tables
from pagelake.sources.pages import scan_pages
from pagelake.streaming import jobs


def landed_files(spark, sf_dir, base):
    """Pages in three deliveries; some pages come again later with a new title."""
    pages = X.table(spark, sf_dir, "pages").select("url", "html", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("fetched_at"))
    again = pages.where("hash(url) % 4 = 0").select(
        "url", F.regexp_replace("html", "<title>.*?</title>", "<title>changed</title>").alias("html"),
        (F.col("fetched_at") + F.expr("interval 1 day")).alias("fetched_at"))
    for i, part in enumerate((pages.where("hash(url) % 2 = 0"), pages.where("hash(url) % 2 <> 0"), again)):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = scan_pages(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    return stream, again.count(), pages.count()


def test_upsert_keeps_the_latest_and_replays_safely(spark, sf_dir):
    base = tables.scratch_path(spark, "s")
    stream, changed, total = landed_files(spark, sf_dir, base)
    jobs.stream_page_upsert(stream, f"{base}/out", f"{base}/ck").awaitTermination()
    first = jobs.current_pages(spark, f"{base}/out")
    assert first.count() == total and first.where("title = 'changed'").count() == changed
    # a lost checkpoint replays every batch
    jobs.stream_page_upsert(stream, f"{base}/out", f"{base}/ck2").awaitTermination()
    assert jobs.current_pages(spark, f"{base}/out").exceptAll(first).count() == 0


def test_upsert_reads_a_snapshot_and_what_came_after(spark, sf_dir):
    base = tables.scratch_path(spark, "s")
    stream, changed, total = landed_files(spark, sf_dir, base)
    jobs.stream_page_upsert(stream, f"{base}/out", f"{base}/ck", compact_every=2).awaitTermination()
    assert jobs._stored_ids(spark, f"{base}/out", "snapshot_id") == [1]
    got = jobs.current_pages(spark, f"{base}/out")
    assert got.count() == total and got.where("title = 'changed'").count() == changed
    # without the batches that the snapshot covers the state is the same
    jobs.compact_pages(spark, f"{base}/out", f"{base}/all")
    assert spark.read.parquet(f"{base}/all").exceptAll(got).count() == 0


def test_contacts_once_per_page(spark, sf_dir):
    base = tables.scratch_path(spark, "s")
    stream, _, _ = landed_files(spark, sf_dir, base)
    expected = P.page_contacts(scan_pages(X.table(spark, sf_dir, "pages"))).count()
    jobs.stream_contacts(stream, f"{base}/out", f"{base}/ck", late_by=None).awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == expected
    jobs.stream_contacts(stream, f"{base}/out2", f"{base}/ck2").awaitTermination()
    assert spark.read.parquet(f"{base}/out2").drop("fetched_at").distinct().count() == expected


def test_state_of_contacts_is_bounded(spark):
    base = tables.scratch_path(spark, "s")
    for day in range(1000, 1200, 20):
        spark.createDataFrame([(f"http://a.org/{day}", f"mail u{day}@x.org", day * 86_400)], "url string, html string, t long") \
            .select("url", "html", F.timestamp_seconds("t").alias("fetched_at")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    schema = "url string, html string, fetched_at timestamp"
    stream = scan_pages(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    query = jobs.stream_contacts(stream, f"{base}/out", f"{base}/ck")
    query.awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == 10
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_old_batches_are_removed(spark, sf_dir):
    base = tables.scratch_path(spark, "s")
    pages = X.table(spark, sf_dir, "pages").select("url", "html").limit(6)
    for k in range(14):
        pages.withColumn("html", F.regexp_replace("html", "<title>.*?</title>", f"<title>t{k}</title>")) \
            .withColumn("fetched_at", F.timestamp_seconds(F.lit(k))).where(F.lit(k) % 2 == F.xxhash64("url") % 2).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = scan_pages(spark.readStream.schema("url string, html string, fetched_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    for out, keep in (("all", 3600), ("few", 0)):
        jobs.stream_page_upsert(stream, f"{base}/{out}", f"{base}/ck-{out}", compact_every=2, keep_seconds=keep).awaitTermination()
    batches = {out: jobs._stored_ids(spark, f"{base}/{out}", "batch_id") for out in ("all", "few")}
    assert len(batches["all"]) >= 10 and len(batches["few"]) <= 4
    assert len(jobs._stored_ids(spark, f"{base}/few", "snapshot_id")) <= 2
    few, every = (jobs.current_pages(spark, f"{base}/{out}") for out in ("few", "all"))
    assert few.exceptAll(every).count() == 0 and every.exceptAll(few).count() == 0


def test_stream_of_one_file_is_dealt_over_many_tasks(spark, sf_dir):
    from pagelake.plans import registered

    source = registered._stream(spark, sf_dir, "part")
    assert source.isStreaming and "Repartition" in source._jdf.queryExecution().analyzed().toString()


def test_bracket_count_of_a_long_body_is_one_match_per_run(spark):
    from pagelake.functions import variants as V

    body = '{"a":[{"b":"' + "x" * 50_000 + '"},{"c":{}}]}'
    df = spark.createDataFrame([(body,)], "body string")
    found = V.json_objects(F.col("body"), None)["objects"]
    assert df.select(F.size(found).alias("n")).first().n == 4
    assert "{]+" in df.select(found)._jdf.queryExecution().analyzed().toString()
