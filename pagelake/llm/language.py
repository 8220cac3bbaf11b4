"""Language identification by nearest centroids of TF-IDF character n-grams.

One, two and three letters in a row (lower case, every run of other characters as one blank) are hashed into 8,192
dimensions. Document frequencies cover all training documents. A bounded sample of each language is clustered by
spherical k-means, so that a language has several centroids; a text gets the language of the centroid with the
highest cosine. A text further from its centroid than nearly all sampled texts of it is marked as rejected.

Defined results: null texts and texts without letters are ``und`` with score 0; so is every text when nothing can
be learned; a language without a sampled text is not learned; equal scores go to the first language by name;
repeated rows are scored alike; only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, remainder, stored

DIMENSIONS = 8192
SAMPLE_DOCS = 1000  # expected texts of a language in the sample; with fewer, all of them
CENTROIDS, STEPS = 4, 8
REJECTED_SHARE = 0.005  # of the sampled texts of a centroid lie further out than its limit
BLOCK = 1 << 20
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of a whole text, or None without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other characters, the first after a letter
    line = np.where(letter, points, 32)[keep].astype(np.uint64)
    line = np.concatenate([[np.uint64(32)], line, [np.uint64(32)]])
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    for i in range(0, len(line), BLOCK):
        part = line[i:i + BLOCK + 2]
        code = np.zeros(len(part), dtype=np.uint64)
        for n in range(3):
            grams = code[: len(part) - n] * np.uint64(0x1F123BB5) + part[n:] + np.uint64(n + 1)
            code = grams
            mine = grams[:BLOCK]
            hashed = (mine * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)
            out += np.bincount(hashed.astype(np.int64), minlength=DIMENSIONS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors of rows of counts."""
    v = np.log1p(counts) * idf
    return (v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)).astype(np.float32)


def clustered(vectors: np.ndarray, k: int = CENTROIDS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts; centroids, and the cosine below which a text is rejected."""
    centers = [vectors.mean(axis=0)]
    while len(centers) < min(k, len(vectors)):
        nearest = np.max(vectors @ np.stack(centers).T, axis=1)
        centers.append(vectors[int(nearest.argmin())])
    centers = np.stack(centers)
    for _ in range(steps):
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        own = (vectors @ centers.T).argmax(axis=1)
        centers = np.stack([vectors[own == c].mean(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))])
    centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    cosine = vectors @ centers.T
    own = cosine.argmax(axis=1)
    limits = [np.quantile(cosine[own == c, c], REJECTED_SHARE) if (own == c).any() else 0.0 for c in range(len(centers))]
    return centers.astype(np.float32), np.array(limits)


def training_counts(train: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``lang, dims, counts``: sampled texts with their language; and, with null lang, document frequencies of a task."""
    source = train.select("text", "lang", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)).alias("__draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMENSIONS + 1, dtype=np.int64)  # the last: number of documents
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], names=["lang", "dims", "counts"])

        for b in batches:
            found = []
            for text, lang, draw in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "__draw")), strict=True):
                counts = gram_counts(text)
                if counts is None:
                    continue
                dims = np.flatnonzero(counts)
                df[dims] += 1
                df[-1] += 1
                if draw < shares[lang]:
                    found.append((lang, dims.astype(np.int32), counts[dims]))
            if found:
                yield rows(found)
        dims = np.flatnonzero(df)
        yield rows([(None, dims.astype(np.int32), df[dims])])

    return map_texts(source, run, "lang string, dims array<int>, counts array<bigint>")


def fitted(train: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Languages, inverse document frequencies, centroids with their language, and limits."""
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    shares = {lang: min(1.0, sample_docs / n) for lang, n in sizes.items()}
    counts = stored(training_counts(train, shares), "grams")
    df = np.zeros(DIMENSIONS + 1)
    summed = counts.where("lang is null").select(F.explode(F.arrays_zip("dims", "counts")).alias("x")) \
        .groupBy("x.dims").agg(F.sum("x.counts").alias("n"))
    for r in summed.collect():  # DIMENSIONS + 1 rows at most
        df[r.dims] = r.n
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.05
    langs, centers, owner, limits = [], [], [], []
    for lang in sorted(sizes):
        sample = counts.where(F.col("lang") == lang).select("dims", "counts").toPandas()
        if not len(sample):
            continue
        rows = np.zeros((len(sample), DIMENSIONS), dtype=np.float32)
        for i, (d, c) in enumerate(zip(sample.dims, sample.counts, strict=True)):
            rows[i, d] = c
        c, limit = clustered(weighted(rows, idf.astype(np.float32)))
        langs.append(lang)
        centers.append(c)
        limits.append(limit)
        owner += [len(langs) - 1] * len(c)
    return {"langs": langs, "idf": idf.astype(np.float32), "centers": np.concatenate([np.zeros((0, DIMENSIONS), np.float32), *centers]),
            "owner": np.array(owner, dtype=np.int64), "limits": np.concatenate([np.zeros(0), *limits])}


def languages(docs: DataFrame, held_out: int = 2, folds: int = 4, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every document."""
    fold = remainder(F.col("doc_id"), folds)
    model = fitted(docs.where(F.col("lang").isNotNull() & (fold != held_out)).select("doc_id", "text", "lang"), sample_docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = b.column("text").to_pylist()
            names, scores, far = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
            for start in range(0, len(texts), 256):
                counts = [gram_counts(t) for t in texts[start:start + 256]]
                rows = [i for i, c in enumerate(counts) if c is not None]
                if not rows or not m["langs"]:
                    continue
                cosine = weighted(np.stack([counts[i] for i in rows]).astype(np.float32), m["idf"]) @ m["centers"].T
                best = cosine.argmax(axis=1)
                for i, c, v in zip(rows, best.tolist(), cosine[np.arange(len(rows)), best].tolist(), strict=True):
                    names[start + i] = m["langs"][m["owner"][c]]
                    scores[start + i] = min(1.0, max(0.0, v))
                    far[start + i] = bool(v < m["limits"][c])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(far, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", (fold == held_out).alias("held_out"), "text"), run,
                     f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
