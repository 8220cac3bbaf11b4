"""Entity tables on storage, wiped and reloaded per site."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import first_wins, last_wins

# key columns and surviving row per table; api_responses is append-only
TABLE_KEYS = {
    "pages": (["site", "url"], last_wins),
    "contacts": (["site", "page_url", "type", "value"], first_wins),
    "products": (["site", "source_url", "name"], first_wins),
    "services": (["site", "page_url", "name"], first_wins),
    "company_info": (["site", "key"], last_wins),
    "links": (["site", "from_url", "to_url"], first_wins),
    "api_responses": (None, None),
}
SITE_BUCKETS = 256


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``, else one in the home of the default file system.

    A machine-local file system is shared only when the master is local too; anything else is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        fs = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration())
        home = fs.getHomeDirectory().toString()
        refuse_machine_local(home, context.master)
        folder = "/tmp/pagelake-shared" if home.startswith("file:") else f"{home.rstrip('/')}/.pagelake"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def refuse_machine_local(folder: str, master: str) -> None:
    if folder.startswith("file:") and not re.match(r"local($|\[)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a written folder holds any data."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(folder) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(folder))


def stored_rows(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; what follows scans it instead of computing it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_site_bucket(df: DataFrame) -> DataFrame:
    """Hash bucket of the site: the storage partition, so millions of sites make few folders."""
    return df.withColumn("site_bucket", F.pmod(F.xxhash64("site"), F.lit(SITE_BUCKETS)).cast("int"))


def apply_key_rule(df: DataFrame, table: str, order: list[str]) -> DataFrame:
    keys, rule = TABLE_KEYS[table]
    return df if rule is None else rule(df, keys, order)


def write_tables(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Write each (DataFrame, order columns) after its key rule; the sites in the data are replaced."""
    for name, (df, order) in tables.items():
        replace_sites(apply_key_rule(df, name, order), f"{path}/{name}")


def replace_sites(df: DataFrame, path: str) -> None:
    """Wipe and reload the sites in ``df``; other sites of the table stay untouched.

    The rows are stored once; the buckets and sites that they touch are read from there, so ``df`` is computed once.
    Only the buckets that hold one of these sites are rewritten (dynamic partition overwrite,
    moved in place when the whole job has succeeded). The rebalance hint lets the adaptive
    planner split a bucket with a very large site into several files of normal size.
    """
    new = stored_rows(with_site_bucket(df), "staged")
    try:
        stored = df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        result = new
    else:
        # at most SITE_BUCKETS values, used to prune the stored partitions
        touched = [r.site_bucket for r in new.select("site_bucket").distinct().collect()]
        kept = stored.where(F.col("site_bucket").isin(touched)).join(new.select("site").distinct(), "site", "left_anti")
        result = new.unionByName(kept)
    result.hint("rebalance", "site_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("site_bucket").parquet(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("site_bucket")
