"""Nearest neighbours by randomly rotated one-bit codes.

A vector, less the mean of all, is scaled to length one and turned by a random rotation (into twice as many dimensions, by
default). The signs are its code; two scalars correct it: the length, and the inner product of the turned
vector with the code read as a vector of +-1 / sqrt(bits). With them the packed bits estimate the inner product with any query
without bias, and the error has a known bound, which shrinks with the root of the number of bits. A vector is compared
exactly only where the bound leaves it a chance to be among the k nearest found so far.

All rows are indexed. Queries go out in blocks of bounded size; each pass reads the codes once and keeps k rows per
query and task, and the passes' rows are merged per query.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import BATCH_ROWS, give_back_memory, shared_folder, stored, with_fields

BITS_PER_DIMENSION = 2
SIGMAS = 4.0  # an estimate is off by more than this many standard errors with a probability of 3e-5
BLOCK_BYTES = 16 << 20  # queries that are sent to the tasks at once, as numbers of 8 bytes
TILE = 128  # queries estimated together
PAIRS = 1 << 15  # pairs compared exactly together
SEED = 20_240_521
SIGNS = np.where(np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1, 1.0, -1.0).astype("f4")  # of the bits of every byte
FOUND = "query_id bigint, vec_id bigint, score double"
BLOCK_OF = "pmod(xxhash64(vec_id), {blocks})"

Batches = Iterator[pa.RecordBatch]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding), one row per id: vectors of finite components that are not all zero."""
    kind = vectors.schema["embedding"].dataType
    exact = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col("embedding").cast("array<float>" if exact else "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    return good.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def without_extra_copies(vectors: DataFrame, k: int) -> DataFrame:
    """At most k + 1 rows of each vector, those of the smallest ids: no query can have others among its k nearest."""
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    return vectors.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n")


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, one matrix per length."""
    column = batch.column("embedding")
    lengths = np.diff(column.offsets.to_numpy())
    values = np.asarray(column.flatten(), dtype="f8")
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)]


def rotation(size: int, bits_per_dimension: int) -> np.ndarray:
    """(bits, size) with orthonormal columns, the same in every task; bits are a multiple of eight."""
    bits = -(-size * bits_per_dimension // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng([SEED, size]).standard_normal((bits, size)))
    return q * np.sign(np.diag(r))


def means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector per length; tasks send sums, and the driver sees as many numbers as a vector has components."""
    def sums(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows, m in matrices(batch):
                size = m.shape[1]
                total[size] = total.get(size, np.zeros(size + 1)) + np.append(m.sum(axis=0), len(rows))
        yield pa.RecordBatch.from_pydict({"size": list(total), "sums": [t.tolist() for t in total.values()]},
                                         schema=pa.schema([("size", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    parts = vectors.mapInArrow(sums, "size int, sums array<double>").select("size", F.posexplode("sums").alias("i", "x"))
    found: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("size", "i").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["size"], {})[r.i] = r.x
    # a mean in single precision does not depend on the order of the sums
    return {size: np.array([v[i] / v[size] for i in range(size)], "f4").astype("f8") for size, v in found.items()}


def encoder(centres: dict[int, np.ndarray], bits_per_dimension: int) -> Callable[[Batches], Batches]:
    """Packed codes with their scalars: length, alignment of the code, and the part of the mean in it."""
    def encode(batches: Batches) -> Batches:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            codes, scalars = [b""] * n, np.zeros((n, 2))
            for rows, m in matrices(batch):
                size = m.shape[1]
                turn = turns.setdefault(size, rotation(size, bits_per_dimension))
                with np.errstate(all="ignore"):  # an overflow gives no estimate, and so an exact comparison
                    rest = m - centres[size]
                    length = np.sqrt((rest * rest).sum(axis=1))
                    turned = rest @ turn.T / np.where(length > 0, length, 1)[:, None]
                    scalars[rows, 0] = length
                    scalars[rows, 1] = np.where(length > 0, np.abs(turned).sum(axis=1) / math.sqrt(len(turn)), 1)
                for i, code in zip(rows, np.packbits(turned > 0, axis=1), strict=True):
                    codes[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array(codes, pa.binary()), pa.array(scalars[:, 0]), pa.array(scalars[:, 1])],
                names=["vec_id", "embedding", "code", "length", "alignment"])
        give_back_memory()

    return encode


class Nearest:
    """The k nearest found so far for a matrix of queries, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, sigmas: float) -> None:
        self.ids, self.queries, self.k, self.bits = ids, queries, k, len(turn)
        self.wide = sigmas / math.sqrt(max(1, self.bits - 1))
        with np.errstate(all="ignore"):
            rest = queries - centre
            self.length = np.sqrt((rest * rest).sum(axis=1))
            self.turned = (rest @ turn.T).astype("f4")
        self.score = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo("i8").max)
        self.count = np.zeros(len(ids), "i8")

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, alignment: np.ndarray) -> None:
        for start in range(0, len(self.ids), TILE):
            self.add_tile(slice(start, start + TILE), ids, vectors, codes, length, alignment)

    def add_tile(self, tile: slice, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, alignment: np.ndarray) -> None:
        other = self.ids[tile, None] != ids[None, :]
        lower, upper = self.bounds(tile, codes, length, alignment)
        limit = np.where(self.count[tile] >= self.k, self.score[tile, -1], np.inf)
        new = ~np.isfinite(limit)
        if new.any() and len(ids) > self.k:  # before k are known: the k-th smallest upper bound
            limit[new] = np.sqrt(np.partition(np.where(other[new] & np.isfinite(upper[new]), upper[new], np.inf), self.k - 1, axis=1)[:, self.k - 1])
        with np.errstate(all="ignore"):
            chances = other & ~(lower > (limit * limit)[:, None])
        q, c = np.nonzero(chances)
        for start in range(0, len(q), PAIRS):
            self.compare(tile.start + q[start:start + PAIRS], c[start:start + PAIRS], ids, vectors)

    def bounds(self, tile: slice, codes: np.ndarray, length: np.ndarray, alignment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the squared distances, from table look-ups by the bytes of the codes."""
        turned, q_length = self.turned[tile], self.length[tile, None]
        with np.errstate(all="ignore"):
            tables = turned.reshape(len(turned), -1, 8) @ SIGNS.T  # inner products with all values of each byte
            inner = np.zeros((len(turned), len(codes)), "f4")
            for b in range(codes.shape[1]):
                inner += tables[:, b].take(codes[:, b], axis=1)
            inner = inner * (length / (alignment * math.sqrt(self.bits)))[None, :]
            # plus a little for single precision
            error = q_length * (length * (np.sqrt(np.maximum(0, 1 / alignment ** 2 - 1)) * self.wide + 1e-5))[None, :]
            middle = q_length ** 2 + (length ** 2)[None, :] - 2 * inner
            return middle - 2 * error, middle + 2 * error

    def compare(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Exact distances, components added from first to last."""
        total = np.zeros(len(q))
        with np.errstate(all="ignore"):
            for j in range(vectors.shape[1]):
                gap = self.queries[q, j] - vectors[c, j]
                total += gap * gap
        score = np.sqrt(total)
        touched = np.unique(q)
        old_q, old_k = np.nonzero(np.arange(self.k)[None, :] < self.count[touched, None])
        all_q = np.concatenate([touched[old_q], q])
        all_s = np.concatenate([self.score[touched[old_q], old_k], score])
        all_i = np.concatenate([self.found[touched[old_q], old_k], ids[c]])
        order = np.lexsort((all_i, all_s, all_q))
        all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
        starts = np.flatnonzero(np.append(True, all_q[1:] != all_q[:-1]))
        place = np.arange(len(all_q)) - np.repeat(starts, np.diff(np.append(starts, len(all_q))))
        best = place < self.k
        self.score[all_q[best], place[best]], self.found[all_q[best], place[best]] = all_s[best], all_i[best]
        self.count[touched] = np.minimum(self.k, np.diff(np.append(starts, len(all_q))))

    def rows(self) -> pa.RecordBatch:
        q, j = np.nonzero(np.arange(self.k)[None, :] < self.count[:, None])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, j]), pa.array(self.score[q, j])],
                                          names=["query_id", "vec_id", "score"])


def searcher(block: Broadcast, centres: dict[int, np.ndarray], k: int,
             bits_per_dimension: int, sigmas: float) -> Callable[[Batches], Batches]:
    """The k nearest rows of a task for each query of a block."""
    def search(batches: Batches) -> Batches:
        best = {size: Nearest(ids, q, centres[size], rotation(size, bits_per_dimension), k, sigmas) for size, (ids, q) in block.value.items()}
        for batch in batches:
            ids, codes = batch.column("vec_id").to_numpy(), batch.column("code").to_pylist()
            length, alignment = batch.column("length").to_numpy(), batch.column("alignment").to_numpy()
            for rows, m in matrices(batch):
                if m.shape[1] in best:
                    packed = np.frombuffer(b"".join(codes[i] for i in rows), "u1").reshape(len(rows), -1)
                    best[m.shape[1]].add(ids[rows], m, packed, length[rows], alignment[rows])
        for b in best.values():
            yield b.rows()
        give_back_memory()

    return search


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, bits_per_dimension: int = BITS_PER_DIMENSION,
                       sigmas: float = SIGMAS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows of every query, by Euclidean distance.

    A vec_id stands for one row: of several the smallest vector counts. Rows without a vec_id, and vectors that are null,
    empty, zero or hold a null or non-finite component, take no part. Vectors are compared with those of the same length,
    of which a table has few. Ties go to the smaller vec_id, so of equal vectors only the k + 1 with the smallest ids
    can be found, and only those are indexed: a vector that makes up a large part of the table costs no more than others.
    Fewer candidates than k are all returned; no vectors or no queries give no rows.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    good = stored(usable(vectors), "vectors")
    centres = means(good)
    codes = stored(without_extra_copies(good, k).mapInArrow(encoder(centres, bits_per_dimension), with_fields(
        good, good.columns, "code binary, length double, alignment double")), "codes")
    queries = good.where(is_query).withColumn("bytes", F.size("embedding") * 8 + 8)
    blocks = block_count(queries, block_bytes)
    path = f"{shared_folder(spark)}/llm-nearest-{uuid.uuid4().hex}"
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    for b in range(blocks):
        rows = queries.where(F.expr(BLOCK_OF.format(blocks=blocks)) == b).collect()
        sent = {}
        for size in {len(r.embedding) for r in rows}:
            same = sorted((r.vec_id, r.embedding) for r in rows if len(r.embedding) == size)
            sent[size] = np.array([i for i, _ in same], "i8"), np.array([v for _, v in same], "f8")
        held = spark.sparkContext.broadcast(sent)
        near = codes.mapInArrow(searcher(held, centres, k, bits_per_dimension, sigmas), FOUND)
        near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).write.mode("append").parquet(path)
        held.destroy()
    return spark.read.schema(f"{FOUND}, rank int").parquet(path).select("query_id", "rank", "vec_id", "score")


def block_count(queries: DataFrame, block_bytes: int) -> int:
    """Number of hash blocks of which none has more than ``block_bytes``, unless by a single query."""
    blocks, largest = 1, queries.agg(F.sum("bytes").alias("x"), F.max("bytes").alias("one")).first()
    while largest.x and largest.x > max(block_bytes, largest.one):
        blocks = max(2 * blocks, math.ceil(largest.x * blocks / block_bytes))
        sizes = queries.groupBy(F.expr(BLOCK_OF.format(blocks=blocks)).alias("b")).agg(F.sum("bytes").alias("x"), F.max("bytes").alias("one"))
        largest = sizes.orderBy(F.desc("x")).first()
    return blocks
