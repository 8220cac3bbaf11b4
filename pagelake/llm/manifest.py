"""Merkle manifest of a table, with an inclusion proof for every row, by butterfly exchange.

The rows of a source are the leaves of a tree of fanout 3, in the order of their ids; the roots of all sources are the
leaves of one more tree. Leaves are held in aligned blocks of 3^6 (by default), so the lower levels of a tree never cross
block borders. Above them, blocks work like the nodes of a butterfly network: in round r the (up to) three blocks whose numbers
differ only in digit r to the base 3 swap the roots of the subtrees they have reached so far. Each of them then hashes the
common ancestor itself and keeps the other two roots as the next part of its proof. After the last round every block holds
the whole upper proof and the root; nothing is sent down again. At the ragged right edge of a tree the last subtree
has fewer blocks than its siblings, and its blocks send to several.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, stored

FANOUT = 3
DEPTH = 6  # levels inside a block: 729 leaves
PARTS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"  # per level: the siblings to the left and to the right, concatenated
STORE_EVERY = 4  # rounds between two stored states


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(text: Column) -> Column:
    """Digest of a row with ``text`` in place of its text."""
    def field(value: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c).cast("string")) for c in PARTS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, changed, row): digests of the original and of the tampered row.

    ``tree`` is the source behind a plus sign, and empty for no source, which sorts it first.
    """
    text = F.col("text")
    tampered = (remainder(F.col("doc_id"), 2) == 0) & F.contains(text, F.lit("\n"))
    leaf = leaf_digest(text)
    return docs.select(F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("tree"), "doc_id", leaf.alias("leaf"),
                       F.when(tampered, leaf_digest(F.replace(text, F.lit("\n"), F.lit("")))).alias("changed"),
                       F.monotonically_increasing_id().alias("row"))


def placed(rows: DataFrame, order: Sequence[str], name: str, depth: int) -> DataFrame:
    """Add ``pos``, the place of a row in its tree by ``order``, its block, and ``n``, the number of rows of the tree.

    Rows are sorted by ranges, so a large tree spreads over many tasks; a tree's places in a range follow from the
    counts of the ranges before it. Rows that are equal in ``order`` must be split by its last column.
    """
    by = ["tree", *order]
    ranged = rows.repartitionByRange(*[F.asc(c) for c in by]).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("_range", F.shiftright("_id", 33)), name)
    runs = ranged.groupBy("tree", "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "_range", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                       F.sum("_rows").over(whole).alias("n"))
    return ranged.join(runs, ["tree", "_range"]).withColumn("pos", F.col("_before") + F.col("_id") - F.col("_first")) \
        .withColumn("block", F.expr(f"pos div {FANOUT ** depth}")).drop("_id", "_range", "_first", "_before")


def levels(nodes: list[str], n: int, depth: int) -> list[list[str]]:
    """Levels of a block above its leaves, in a tree with ``n`` leaves: ``depth`` of them, or up to the root."""
    found = [nodes]
    while n > 1 and len(found) <= depth:
        nodes = [sha256("".join(nodes[i:i + FANOUT])) for i in range(0, len(nodes), FANOUT)]
        found.append(nodes)
        n = -(-n // FANOUT)
    return found


def block_root(block: pa.Table, depth: int) -> pa.Table:
    block = block.sort_by("pos")
    n = block.column("n")[0].as_py()
    top = levels(block.column("leaf").to_pylist(), n, depth)[-1][0]
    return pa.table({"tree": block.column("tree")[:1], "block": block.column("block")[:1],
                     "blocks": pa.array([-(-n // FANOUT ** depth)], pa.int64()), "node": pa.array([top], pa.string())})


def swapped(state: DataFrame, span: int) -> DataFrame:
    """One round: blocks whose numbers differ only in the digit of value ``span`` swap their nodes."""
    rest = state.where(F.col("blocks") <= span)
    active = state.where(F.col("blocks") > span).select(
        "*", F.expr(f"block div {span * FANOUT}").alias("_group"), F.expr(f"block div {span} % {FANOUT}").alias("_digit"))
    start = F.col("_group") * (span * FANOUT)
    own = F.least(F.lit(span), F.col("blocks") - start - F.col("_digit") * span)  # blocks of my subtree
    most = F.least(F.lit(span), F.col("blocks") - start)  # and of the first one, which has no fewer
    lane = F.col("block") % span
    sent = active.withColumn("_to", F.explode(F.sequence(lane, most - 1, own))).withColumn("_mine", F.col("_to") == lane)
    meeting = Window.partitionBy("tree", "_group", "_to")  # one block of each sibling subtree, with its node
    met = sent.withColumn("_nodes", F.array_sort(F.collect_list(F.struct(F.col("_digit").alias("d"), "node")).over(meeting))).where("_mine")

    def joined(keep: Column | None) -> Column:
        nodes = F.col("_nodes") if keep is None else F.filter("_nodes", lambda x: keep(x["d"]))
        return F.array_join(F.transform(nodes, lambda x: x["node"]), "")

    step = F.struct(joined(lambda d: d < F.col("_digit")).alias("l"), joined(lambda d: d > F.col("_digit")).alias("r"))
    done = met.select("tree", "block", "blocks", F.sha2(joined(None), 256).alias("node"), F.array_append("up", step).cast(PATH).alias("up"))
    return done.unionByName(rest)


def butterfly(rows: DataFrame, name: str, depth: int) -> DataFrame:
    """(tree, block, blocks, node, up): the root of the tree and the upper proof, known to each of its blocks."""
    state = stored(rows.select("tree", "block", "pos", "n", "leaf").groupBy("tree", "block").applyInArrow(
        lambda block: block_root(block, depth), "tree string, block bigint, blocks bigint, node string").withColumn("up", F.array().cast(PATH)), name)
    most = state.agg(F.max("blocks")).first()[0] or 0
    span, rounds = 1, 0
    while span < most:
        state, span, rounds = swapped(state, span), span * FANOUT, rounds + 1
        if rounds % STORE_EVERY == 0:
            state = stored(state, name)
    return stored(state, name) if rounds % STORE_EVERY else state


def block_paths(block: pa.Table, upper: pa.Table, depth: int) -> pa.Table:
    """Rows of a block with their whole proofs, and the nodes that the block knows."""
    block = block.sort_by("pos")
    found = levels(block.column("leaf").to_pylist(), block.column("n")[0].as_py(), depth)[:-1]
    above = upper.column("up")[0].as_py()
    paths = []
    for i in range(block.num_rows):
        path = []
        for nodes in found:
            start = i - i % FANOUT
            path.append({"l": "".join(nodes[start:i]), "r": "".join(nodes[i + 1:start + FANOUT])})
            i //= FANOUT
        paths.append(path + above)
    kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    out = block.select([c for c in block.column_names if c not in ("tree", "block", "pos", "n")]).append_column("path", pa.array(paths, kind))
    for c in upper.column_names:
        if c not in ("block", "up"):
            out = out.append_column(c, pa.array([upper.column(c)[0].as_py()] * out.num_rows, pa.string()))
    return out


def with_paths(rows: DataFrame, upper: DataFrame, more: Sequence[str], depth: int) -> DataFrame:
    """The columns ``more`` of the rows, their proofs, and the columns of ``upper`` (all text but its block and proof)."""
    keep = rows.select(*more).schema.fields
    told = [c for c in upper.columns if c not in ("block", "up")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keep), f"path {PATH}", *(f"{c} string" for c in told)])
    left = rows.select("tree", "block", "pos", "n", *more).groupBy("tree", "block")
    return left.cogroup(upper.groupBy("tree", "block")).applyInArrow(
        lambda block, above: block_paths(block, above, depth), schema)


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["l"], node, p["r"]), 256))


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: ``doc_id, leaf, path, subroot, root, changed`` (digest of the tampered row, null for the others).

    Rows without a doc_id come first in their source and, for the tampering, count as the empty text; rows that repeat a
    doc_id are ordered by their leaf, and equal rows are leaves of their own. Rows without a source are a tree that sorts
    first, apart from the source ''. Null fields count as ``-``, unlike empty texts. No documents give no rows, and
    further columns are no part of a leaf.
    """
    rows = stored(placed(stored(leaves(docs), "leaves"), ["doc_id", "leaf", "row"], "ranges", depth), "places")
    upper = butterfly(rows, "blocks", depth)
    sources = upper.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("node").alias("leaf"))
    sources = stored(placed(sources, ["source"], "sources", depth), "sources")
    last = butterfly(sources, "top", depth).select("tree", "block", "up", F.col("node").alias("root"))
    top = with_paths(sources, last, ["source", "leaf"], depth) \
        .select(F.col("source").alias("tree"), F.col("leaf").alias("subroot"), "root", F.col("path").alias("above"))
    known = upper.join(top, "tree").select("tree", "block", F.concat("up", "above").alias("up"), "subroot", "root")
    return with_paths(rows, known, ["doc_id", "leaf", "changed"], depth)


def verified(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``manifest`` with the digest of each proof, and the root recomputed from the tampered leaf, else the original one."""
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["l"], p["r"])), "")
    found = manifest(docs, depth).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return found.select("*", F.sha2(siblings, 256).alias("proof_sha256"), (F.col("folded_root") == F.col("root")).alias("verified"))
