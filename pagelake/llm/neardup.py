"""Near-duplicate classes by DartMinHash signatures, banding and an exact check.

A text is a weighted set: its shingles of five words (lower case, split at white space), weighted by how often
they occur; a shorter text is one shingle. Two texts are near copies when their weighted Jaccard similarity is
0.8 or more, and classes are the connected components of that relation together with equality of words.

DartMinHash: every element's region (height = weight, length = rank, without end) receives darts at hashed places
with equal density, each aimed at one coordinate of the signature. Only darts up to a rank that fills the
signature are thrown; each coordinate keeps its earliest one. Signatures of 384 coordinates are cut into 48 bands
of 8, so a pair at 0.8 shares a band with probability above 0.9998.

Work stays linear in the members of a bucket: each is compared with one member drawn by hash, first on packed
low-order codes; pairs within five standard errors of the bound are settled on the shingle sets. The pairs found
are joined into components. Only buckets that still hold several components are looked at again: members outside
the component of the drawn one visit that component, and each component's visitors are compared with all that
share such a bucket, in cells of bounded size that give at most one link of a visitor to a component.

Defined results: null, empty and blank texts have no words and form one class of equal texts; equal texts are
one class however many there are; repeated rows each get a result row; a class is named by its least ``doc_id``
(null if no member has one); columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored

SIMILARITY = 0.8
SHINGLE = 5
COORDINATES, BAND_ROWS = 384, 8
BANDS = COORDINATES // BAND_ROWS
CODE_BITS = 4
PACKED = COORDINATES * CODE_BITS // 64
MARGIN = 0.11  # five standard errors of an estimate at the bound
THROWN_UNITS = 200_000
CELL_UNITS = 100_000  # shingles on either side of a cell, about
SLOTS = 1 << 20
SEEN_TEXTS = 1_000_000  # distinct texts that a task remembers

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_BASE_INVERSE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            one = np.full(size, base)
            one[0] = 1
            _powers[name] = np.cumprod(one)
    return _powers["up"], _powers["down"]


def shingle_hashes(words: bytes, size: int = SHINGLE, block: int = 40_000) -> np.ndarray:
    """64-bit hash of every shingle: differences of one polynomial prefix sum, brought back to position 0."""
    if not words:
        return np.empty(0, np.uint64)
    buf = np.frombuffer(words, np.uint8)
    blanks = np.flatnonzero(buf == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(buf)]])
    if len(starts) < size:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1:]
    out = []
    for k in range(0, len(starts), block):
        a, b = starts[k:k + block], ends[k:k + block]
        part = buf[a[0]:b[-1]].astype(np.uint64) + np.uint64(1)
        up, down = powers(len(part))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
        out.append(mixed((sums[b - a[0]] - sums[a - a[0]]) * down[a - a[0]]))
    return np.concatenate(out)


def units(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regions cut at whole heights: hash of each cell and the share of it that the weight covers."""
    cells = np.ceil(weights).astype(np.int64)
    height = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
    covered = np.minimum(1.0, np.repeat(weights, cells) - height)
    return mixed(np.repeat(elements, cells) + height.astype(np.uint64) * _STEP), covered


def throw_darts(cells: np.ndarray, covered: np.ndarray, sizes: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Earliest dart of each coordinate, by its rank, for sets given as consecutive cells (``sizes`` of them, none empty).

    Darts fall on a cell at exponential steps of rank, ``k`` per unit of weight and rank.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    totals = np.bincount(owner, covered, len(sizes))
    best = np.full(len(sizes) * k, np.inf)
    bound = (log(k) + 3) / totals
    whole = bool((covered >= 1).all())
    todo = np.ones(len(sizes), dtype=bool)
    while todo.any():
        live = np.flatnonzero(todo[owner])
        for at in range(0, len(live), THROWN_UNITS):
            some = live[at:at + THROWN_UNITS]
            cell, who, part, rank, n = cells[some], owner[some], covered[some], np.zeros(len(some)), 0
            while len(cell):
                n += 1
                dart = mixed(cell + np.uint64(n * int(_STEP) & (1 << 64) - 1))
                rank = rank - np.log1p(-(dart >> np.uint64(16)).astype(float) / (1 << 48)) / k
                near = rank <= bound[who]
                cell, who, part, rank, dart = cell[near], who[near], part[near], rank[near], dart[near]
                place = who * k + (((dart & np.uint64(0xFFFF)) * np.uint64(k)) >> np.uint64(16)).astype(np.int64)
                if whole:
                    np.minimum.at(best, place, rank)
                else:
                    inside = (mixed(dart) >> np.uint64(16)).astype(float) / (1 << 48) < part
                    np.minimum.at(best, place[inside], rank[inside])
        todo = np.isinf(best.reshape(-1, k)).any(axis=1)
        bound = np.where(todo, 2 * bound, bound)
    return best.reshape(-1, k)


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of units, signatures and, for the rows that have one, band keys and packed codes."""
    found = []
    for words in texts:
        elements, counts = np.unique(shingle_hashes(words), return_counts=True)
        found.append(units(elements, counts.astype(float)))
    sizes = np.array([len(c) for c, _ in found], dtype=np.int64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return sizes, filled, np.empty((0, BANDS), np.int64), np.empty((0, PACKED), np.int64)
    sign = throw_darts(np.concatenate([found[i][0] for i in filled]), np.concatenate([found[i][1] for i in filled]),
                       sizes[filled]).view(np.uint64)
    keys = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(filled), BANDS))
    for r in range(BAND_ROWS):
        keys = mixed(keys ^ sign[:, r::BAND_ROWS])
    codes = (mixed(sign) & np.uint64((1 << CODE_BITS) - 1)).reshape(len(filled), PACKED, -1)
    shift = np.arange(codes.shape[2], dtype=np.uint64) * np.uint64(CODE_BITS)
    return sizes, filled, keys.view(np.int64), np.bitwise_or.reduce(codes << shift, axis=2).view(np.int64)


def packed_units(words: bytes) -> bytes:
    """The weighted set of a text as sorted 32-bit hashes of its unit cells."""
    elements, counts = np.unique(shingle_hashes(words), return_counts=True)
    return np.unique((units(elements, counts.astype(float))[0] >> np.uint64(32)).astype(np.uint32)).tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed sets."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def links_between(left: list[bytes], right: list[bytes], left_label: list[bytes], right_label: list[bytes]) -> list[tuple[int, int]]:
    """Similar pairs with different labels, one for each set on the left and label on the right."""
    sets = [np.frombuffer(x, np.uint32) for x in right]
    sizes = np.array([len(x) for x in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    out = []
    for i, x in enumerate(left):
        own = np.frombuffer(x, np.uint32)
        lo, hi = np.searchsorted(every, own), np.searchsorted(every, own, side="right")
        n = hi - lo
        places = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[places], minlength=len(sets))
        found = np.flatnonzero(shared >= SIMILARITY * (len(own) + sizes - shared) - 1e-9)
        done = {left_label[i]}
        for j in found.tolist():
            if right_label[j] not in done:
                done.add(right_label[j])
                out.append((i, j))
    return out


# -- Spark -----------------------------------------------------------------------------------------------------------

def with_row_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row_key", F.xxhash64("doc_id", "text"))


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, row_key, node`` (digest of the words), ``short`` (64 bits of it), ``n, bands, codes``.

    Of equal texts in a task only the first has bands and codes, so thousands of copies fill no bucket.
    """
    source = with_row_key(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            words = [normal(t) for t in b.column("text").to_pylist()]
            distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
            sizes, filled, keys, codes = signatures(list(distinct))
            at = np.full(len(distinct), -1)
            at[filled] = np.arange(len(filled))
            row = np.array([distinct[w] for w in words], dtype=np.int64)
            nodes = [blake2b(w, digest_size=16).digest() for w in words]
            if len(seen) > SEEN_TEXTS:  # a text that is met again then shows its bands once more
                seen.clear()
            shown = at[row] >= 0
            for i, node in enumerate(nodes):
                if node in seen:
                    shown[i] = False
                seen.add(node)
            lists = []
            for values in (keys, codes):
                width = values.shape[1] * shown
                flat = values[at[row][shown]].ravel()
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(flat, pa.int64())))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("__row_key"), pa.array(nodes, pa.binary()),
                pa.array([int.from_bytes(x[:8], "big", signed=True) for x in nodes], pa.int64()), pa.array(sizes[row]), *lists,
            ], names=["doc_id", "row_key", "node", "short", "n", "bands", "codes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(source, run, f"doc_id {kind}, row_key bigint, node binary, short bigint, n bigint, bands array<bigint>, codes array<bigint>")


def estimate(a: str, b: str) -> Column:
    """Similarity estimated from two arrays of packed codes, corrected for codes that agree by chance."""
    differ = F.lit(0)
    for i in range(PACKED):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for step in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 1 / (1 << CODE_BITS)
    return 1 - differ / F.lit(COORDINATES * (1 - chance))


def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` texts (``node, short, n, codes, row_key``) with their packed sets.

    Rows that cannot be wanted are left out before the shuffle, by a table of at most SLOTS numbers.
    """
    slots = wanted.select(F.pmod("row_key", F.lit(SLOTS)).alias("slot")).distinct()
    texts = with_row_key(docs.select("doc_id", "text")).withColumn("slot", F.pmod("__row_key", F.lit(SLOTS))) \
        .join(F.broadcast(slots), "slot", "left_semi").select(F.col("__row_key").alias("row_key"), "text")
    both = wanted.join(texts, "row_key").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([packed_units(normal(t)) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "short", "n", "codes")), sets], names=["node", "short", "n", "codes", "units"])

    return map_texts(both.select("node", "short", "n", "codes", "text"), run, "node binary, short bigint, n bigint, codes array<bigint>, units binary")


def star_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges ``a, b`` (nodes) between the members of a bucket and its drawn one."""
    def side(name: str) -> DataFrame:
        return texts.select(F.col("short").alias(f"short_{name}"), F.col("node").alias(f"node_{name}"), F.col("n").alias(f"n_{name}"),
                            F.col("codes").alias(f"codes_{name}"))

    pairs = members.where(~F.col("drawn")).join(members.where("drawn").select("key", F.col("short").alias("center")), "key") \
        .select(F.least("short", "center").alias("short_a"), F.greatest("short", "center").alias("short_b")).distinct()
    pairs = stored(pairs.join(side("a"), "short_a").join(side("b"), "short_b")
                   .where(F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b"))
                   .select("node_a", "node_b", estimate("codes_a", "codes_b").alias("likely"))
                   .where(F.col("likely") >= SIMILARITY - MARGIN), "pairs")
    sure = pairs.where(F.col("likely") >= SIMILARITY + MARGIN).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    sets = texts.select("node", "units")
    doubt = pairs.where(F.col("likely") < SIMILARITY + MARGIN).join(sets.toDF("node_a", "units_a"), "node_a") \
        .join(sets.toDF("node_b", "units_b"), "node_b").select("node_a", "node_b", "units_a", "units_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([similarity(x, y) >= SIMILARITY for x, y in
                             zip(b.column("units_a").to_pylist(), b.column("units_b").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("node_a").filter(keep), b.column("node_b").filter(keep)], names=["a", "b"])

    return sure.unionByName(map_texts(doubt, run, "a binary, b binary", "units_a"))


def visitor_links(members: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges across components among the members of buckets that hold several."""
    known = texts.select("short", "node").join(labels, "node", "left").select("short", "node", F.coalesce("label", "node").alias("label"))
    placed = members.join(known, "short").select("key", "drawn", "node", "label")
    several = placed.groupBy("key").agg(F.min(F.xxhash64("label")).alias("lo"), F.max(F.xxhash64("label")).alias("hi")).where("lo < hi").select("key")
    placed = stored(placed.join(several, "key", "left_semi"), "placed")
    at = placed.join(placed.where("drawn").select("key", F.col("label").alias("group")), "key").select("group", "node", "label").distinct() \
        .withColumn("visits", F.col("group") != F.col("label")).join(texts.select("node", "n"), "node")
    sizes = at.groupBy("group").agg(
        F.ceil(F.sum("n") / F.lit(CELL_UNITS)).cast("int").alias("n_all"),
        F.ceil(F.sum(F.when(F.col("visits"), F.col("n")).otherwise(0)) / F.lit(CELL_UNITS)).cast("int").alias("n_visiting")).where("n_visiting > 0")
    sized = at.join(sizes, "group").join(texts.select("node", "units"), "node")

    def dealt(n: str, others: str, left: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        rows = (sized.where("visits") if left else sized).withColumn("own", own).withColumn("other", other)
        return rows.select("group", F.col("own" if left else "other").alias("i"), F.col("other" if left else "own").alias("j"),
                           F.lit(left).alias("left"), "node", "label", "units")

    def compare(cell: pa.Table) -> pa.Table:
        left = cell.filter(cell.column("left"))
        right = cell.filter(pa.compute.invert(cell.column("left")))
        found = []
        if left.num_rows and right.num_rows:
            names = [left.column("node").to_pylist(), right.column("node").to_pylist()]
            found = [(names[0][i], names[1][j]) for i, j in links_between(
                left.column("units").to_pylist(), right.column("units").to_pylist(), left.column("label").to_pylist(), right.column("label").to_pylist())]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    cells = dealt("n_visiting", "n_all", True).unionByName(dealt("n_all", "n_visiting", False))
    return cells.groupBy("group", "i", "j").applyInArrow(compare, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of its component, for every node that has an edge.

    Alternates two star contractions, each an aggregate and a join, until the edges are stars.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.toDF("node", "label")
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = linked.select("a", F.col("m").alias("b")).unionByName(linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "edges")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and ``node, label`` for the texts that have a near copy."""
    rows = stored(sketches(docs), "sketches")
    buckets = rows.select("short", F.explode("bands").alias("key"))
    draw = F.xxhash64("short", "key")
    shared = buckets.groupBy("key").agg(F.min(draw).alias("drawn"), F.max(draw).alias("last")).where("drawn < last").select("key", "drawn")
    members = stored(buckets.join(shared, "key").select("key", "short", (draw == F.col("drawn")).alias("drawn")).distinct(), "members")
    wanted = rows.where(F.size("codes") > 0).select("node", "short", "n", "codes", "row_key").join(members.select("short").distinct(), "short", "left_semi").dropDuplicates(["node"])
    texts = stored(candidate_sets(docs, stored(wanted, "wanted")), "candidates")
    edges = stored(star_links(members, texts), "links")
    labels = components(edges)
    more = stored(visitor_links(members, texts, labels), "links")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    return rows, labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size`` for every row; rows without a copy are classes of their own."""
    rows, labels = classes(docs)
    placed = rows.select("doc_id", "node").join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    named = placed.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(named, "label").select("doc_id", "class_id", "class_size")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the one with the least ``doc_id`` (nulls last)."""
    rows, labels = classes(docs)
    placed = rows.join(labels, "node", "left").select("doc_id", "row_key", F.coalesce("label", "node").alias("label"))
    kept = placed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row_key")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__kept"), F.col("k.row_key").alias("__row_key")).distinct()
    return with_row_key(docs).join(kept, "__row_key").where(F.col("doc_id").eqNullSafe(F.col("__kept"))) \
        .dropDuplicates(["__row_key", "doc_id"]).select(*docs.columns)
