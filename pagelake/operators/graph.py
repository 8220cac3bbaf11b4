"""Link-graph jobs: next URLs to fetch, breadth-first depth, pagination chains."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_followable, normalize_url, site_of
from ..sources.tables import has_files, scratch_path, shared_dir, stored_rows
from .groups import top_per_group
from .keys import first_wins

# candidates are taken in this order
PRIORITY = {"pagination": 0, "seed": 1, "sitemap": 2, "link": 3}
URL_BUCKETS = 8


def frontier_candidates(seeds: DataFrame, sitemap: DataFrame, links: DataFrame, next_pages: DataFrame) -> DataFrame:
    """(site, url, kind, depth, seq): everything that may be fetched next, in one table.

    ``seeds`` has url; ``sitemap`` (site, url, path, pos); ``links`` (from_url, to_url); ``next_pages`` (url, next_url).
    Links and next pages are ordered by the page that names them.
    """
    def shaped(df: DataFrame, kind: str, url: str, seq) -> DataFrame:
        u = normalize_url(F.col(url))
        return df.where(F.col(url).isNotNull()).select(site_of(u).alias("site"), u.alias("url"), F.lit(kind).alias("kind"),
                                                       F.lit(0).alias("depth"), seq.alias("seq"))

    return shaped(seeds, "seed", "url", F.lit("")) \
        .unionByName(shaped(sitemap, "sitemap", "url", F.format_string("%s %010d", "path", "pos"))) \
        .unionByName(shaped(links, "link", "to_url", F.col("from_url"))) \
        .unionByName(shaped(next_pages, "pagination", "next_url", F.col("url")))


def frontier_round(candidates: DataFrame, visited: DataFrame, budget: int) -> DataFrame:
    """Next URLs per site: (site, url, kind, depth, seq, rank).

    ``candidates`` has site, url, kind, depth and seq; ``visited`` has url. Pagination goes first,
    then seeds, sitemap entries and links in order of discovery.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, r) for k, r in PRIORITY.items()])
    usable = candidates.withColumn("url", normalize_url(F.col("url"))) \
        .where(is_followable(F.col("url"), F.col("site"))).withColumn("_p", rank)
    fresh = first_wins(usable, ["site", "url"], ["_p", "depth", "seq"]).join(
        visited.select(normalize_url(F.col("url")).alias("url")).distinct(), "url", "left_anti")
    order = [F.asc("_p"), F.asc("depth"), F.asc("seq"), F.asc("url")]
    return top_per_group(fresh, ["site"], order, budget).select("site", "url", "kind", "depth", "seq", "rank")


def _buckets(df: DataFrame) -> list[int]:
    """Buckets that occur, a list of bounded length."""
    return sorted(r.bucket for r in df.select("bucket").distinct().collect())


def bfs_depth(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_pages: int | None = None,
              url_buckets: int = URL_BUCKETS) -> DataFrame:
    """(site, url, depth): depth at which each page is first reached over the edges.

    ``edges`` has from_url and to_url, ``seeds`` has url. Edges and reached pages are stored in buckets of their url, the
    pages of each level in folders of their own. A level reads the last level, the edges in its buckets, and those
    buckets of the reached pages that its targets fall into; so a long chain reads little per level, however many levels
    came before. Every level writes a file per bucket, so ``url_buckets`` should grow with the graph. The walk ends when
    nothing new is reached, or at ``max_depth`` where one is given.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    kept, reached = scratch_path(spark, "edges"), scratch_path(spark, "reached")

    def bucketed(df: DataFrame, url: str) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(url), F.lit(url_buckets)).cast("int"))

    bucketed(edges.select("from_url", "to_url").distinct(), "from_url").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(kept)
    with_edges = set(_buckets(spark.read.schema("bucket int").parquet(kept))) if has_files(spark, kept) else set()

    def store(level: DataFrame, depth: int, within: list[int]) -> list[int]:
        """Write the pages of a level; the buckets that got some."""
        level.withColumn("depth", F.lit(depth)).write.mode("append").partitionBy("bucket", "depth").parquet(reached)
        return [b for b in within if has_files(spark, f"{reached}/bucket={b}/depth={depth}")]

    def read(folders: list[str], base: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).option("basePath", base).parquet(*folders)

    links, pages = "from_url string, to_url string, bucket int", "url string, bucket int, depth int"
    first = stored_rows(bucketed(seeds.select("url").distinct(), "url"), "seeds")
    last = store(first, 0, _buckets(first))
    used = set(last)
    for depth in (count(1) if max_depth is None else range(1, max_depth + 1)):
        sources = [b for b in last if b in with_edges]
        if not sources:
            break
        frontier = read([f"{reached}/bucket={b}/depth={depth - 1}" for b in sources], reached, pages)
        steps = read([f"{kept}/bucket={b}" for b in sources], kept, links)
        found = frontier.select("url").join(steps, F.col("url") == F.col("from_url")).select(F.col("to_url").alias("url")).distinct()
        targets = stored_rows(bucketed(found, "url"), "targets")
        touched = _buckets(targets)
        known = [f"{reached}/bucket={b}" for b in touched if b in used]
        fresh = targets.join(read(known, reached, pages).select("url"), "url", "left_anti") if known else targets
        last = store(fresh, depth, touched)
        used.update(last)
    if not used:
        found = first.select("url", F.lit(0).alias("depth"))
    else:
        found = spark.read.schema(pages).parquet(reached)
    found = found.withColumn("site", site_of(F.col("url"))).select("site", "url", "depth")
    if max_pages is None:
        return found
    return top_per_group(found, ["site"], [F.asc("depth"), F.asc("url")], max_pages).drop("rank")


def pagination_chain(next_pages: DataFrame) -> DataFrame:
    """(url, chain, position): place of every page in its chain of next pages.

    ``next_pages`` has url and next_url. The chain is named after its first page. When several
    pages name the same next page, the lowest url is its predecessor. Each round doubles the
    distance a page looks back, so a chain of n pages takes log2(n) rounds. Pages on a loop have
    no first page and get NULL.
    """
    shared_dir(next_pages.sparkSession)
    steps = next_pages.where("url <> next_url").groupBy(F.col("next_url").alias("url")).agg(F.min("url").alias("prev"))
    nodes = next_pages.select(F.explode(F.array("url", "next_url")).alias("url")).distinct()
    state = nodes.join(steps, "url", "left").select(
        "url", F.coalesce("prev", "url").alias("chain"), F.when(F.col("prev").isNull(), 0).otherwise(1).alias("position"),
        F.col("prev").isNull().alias("done")).checkpoint()
    open_before = None
    while True:
        open_now = state.where("not done").count()
        if open_now == 0 or open_now == open_before:
            break
        open_before = open_now
        back = state.select(F.col("url").alias("b"), F.col("chain").alias("b_chain"),
                            F.col("position").alias("b_position"), F.col("done").alias("b_done"))
        moved = state.where("not done").join(back, F.col("chain") == F.col("b")).select(
            "url", F.col("b_chain").alias("chain"), (F.col("position") + F.col("b_position")).alias("position"),
            F.col("b_done").alias("done"))
        state = state.where("done").unionByName(moved).checkpoint()
    return state.select("url", F.when(F.col("done"), F.col("chain")).alias("chain"),
                        F.when(F.col("done"), F.col("position")).alias("position"))
