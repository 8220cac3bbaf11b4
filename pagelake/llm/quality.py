"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of every whole text are computed once. Shallow trees are grown on a bounded sample of the
labelled rows, every path from a root becomes a conjunctive rule, an L1-penalised logistic regression
chooses few rules, and those are compiled into one Spark column expression over the statistics.

Defined results: a null text counts as empty; empty texts are scored like any other; a document without
a label takes no part in the fit; several labels of one id count as their minimum; repeated rows are
scored once each; with no labelled rows, or rows of one class only, every score is the smoothed share of
label 1 (0.5 without labels). Only ``doc_id`` and ``text`` are read, so further columns are harmless.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory, map_texts, remainder, stored, with_fields

SAMPLE_ROWS = 20_000  # most labelled rows of the fit
TREE_ROWS = 1_000  # most rows of either class that one tree draws from the sample
N_TREES, DEPTH, CUTS = 48, 3, 24
PENALTY = 2e-3
CHUNK = 1 << 20

STATS = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "newline", "other_bytes", "exclaim", "pipe",
    "symbol", "sentence_mark", "bracket", "distinct_words", "top_word", "long_words", "one_char_words",
    "repeated_lines", "top_line", "capital_words", "marked_words",
)
STAT = "__stat_"
COLUMNS = [STAT + x for x in STATS]
_SYMBOLS = [ord(c) for c in "#$%&*+/<=>@\\^_`~"]


def text_stats(text: str | None) -> list[float]:
    """Statistics of one whole text, in the order of STATS."""
    text = text or ""
    raw = text.encode()
    hist = np.zeros(256, dtype=np.int64)
    for i in range(0, len(raw), CHUNK):
        hist += np.bincount(np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - i), i), minlength=256)
    n = max(1, len(raw))
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    words = text.split()
    counts = Counter(words)
    n_words = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    line_counts = Counter(lines)
    n_lines = max(1, len(lines))
    lengths = np.fromiter(map(len, counts), np.int64, len(counts))
    times = np.fromiter(counts.values(), np.int64, len(counts))
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum())
    capital = sum(c for w, c in counts.items() if w[0].isupper())
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float((lengths * times).sum() / n_words),
        float(hist[65:91].sum() / letters), float(hist[48:58].sum() / n), float((hist[32] + hist[9]) / n),
        float(hist[10] / n), float(hist[128:].sum() / n), float(hist[33] / n), float(hist[124] / n),
        float(hist[_SYMBOLS].sum() / n), float((hist[46] + hist[44] + hist[63]) / n),
        float(hist[[40, 41, 91, 93, 123, 125]].sum() / n), len(counts) / n_words,
        max(counts.values(), default=0) / n_words, float(times[lengths > 14].sum() / n_words),
        float(times[lengths == 1].sum() / n_words), 1 - len(line_counts) / n_lines if lines else 0.0,
        max(line_counts.values(), default=0) / n_lines, capital / n_words, marked / n_words,
    ]


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns and one double per statistic (``STAT`` prefix), for every row."""
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")

    def run(batches):
        for b in batches:
            rows = [text_stats(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *cols], names=[*keep, *COLUMNS])

    return map_texts(source, run, with_fields(docs, keep, ", ".join(f"{x} double" for x in COLUMNS)))


# -- fit (numpy, on the bounded sample) ---------------------------------------------------------------------------

Condition = tuple[int, bool, float]  # statistic, greater than, threshold


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> list[tuple[Condition, ...]]:
    """Grow one tree by Gini gain on a random half of the statistics; return the path of every node but the root."""
    found: list[tuple[Condition, ...]] = []

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            found.append(path)
        labels = y[rows]
        if len(path) == depth or len(rows) < 20 or labels.min() == labels.max():
            return
        best, base = None, len(rows) * labels.mean() * (1 - labels.mean())
        for f in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
            values = x[rows, f]
            for cut in np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 2)[1:-1])):
                right = values > cut
                k = int(right.sum())
                if k < 5 or k > len(rows) - 5:
                    continue
                p, q = labels[right].mean(), labels[~right].mean()
                gain = base - k * p * (1 - p) - (len(rows) - k) * q * (1 - q)
                if best is None or gain > best[0]:
                    best = (gain, int(f), float(cut))
        if best is None or best[0] <= 1e-9:
            return
        _, f, cut = best
        right = x[rows, f] > cut
        grow(rows[right], (*path, (f, True, cut)))
        grow(rows[~right], (*path, (f, False, cut)))

    grow(np.arange(len(y)), ())
    return found


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, greater, cut in rule:
        out &= (x[:, f] > cut) == greater
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 200) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient steps; the intercept is free.

    ``z`` holds truth values. Rows in which the same rules hold are one row with its counts.
    """
    n, m = z.shape
    _, first, pattern = np.unique(np.packbits(z, axis=1), axis=0, return_index=True, return_inverse=True)
    rows, pattern = z[first].astype(np.float32), pattern.ravel()
    total, ones = np.bincount(pattern), np.bincount(pattern, y)
    # the largest eigenvalue bounds the curvature; the intercept adds 1 at most
    gram = (rows.T * total.astype(np.float32)) @ rows / n
    step = 4.0 / ((float(np.linalg.eigvalsh(gram)[-1]) if m else 0.0) + 1.0)
    share = (y.sum() + 0.5) / (n + 1)
    w, b = np.zeros(m, np.float32), float(np.log(share / (1 - share)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        err = total / (1 + np.exp(-np.clip(rows @ v + c, -30, 30))) - ones
        w2 = v - step * (rows.T @ err.astype(np.float32)) / n
        w2 = (np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)).astype(np.float32)
        b2 = c - step * float(err.sum()) / n
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = (w2 + (t - 1) / t2 * (w2 - w)).astype(np.float32), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[list[tuple[tuple[Condition, ...], float]], float]:
    """Rules with their weights, and the intercept."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) < 20 or y.min() == y.max():
        return [], float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    classes = [np.flatnonzero(y == v) for v in (0, 1)]
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(N_TREES):
        rows = np.concatenate([rng.choice(c, min(TREE_ROWS, len(c))) for c in classes])  # both classes alike
        rules.update(dict.fromkeys(tree_rules(x[rows], y[rows], rng)))
    kept: dict[bytes, tuple[Condition, ...]] = {}
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        on = holds(rule, x)
        if 0 < on.sum() < len(x):
            kept.setdefault(np.packbits(on).tobytes(), rule)
    z = np.stack([holds(r, x) for r in kept.values()], axis=1)
    w, b = lasso_logistic(z, y.astype(float))
    give_back_memory()
    return [(r, float(v)) for r, v in zip(kept.values(), w, strict=True) if abs(v) > 1e-6], b


def compiled(rules: list[tuple[tuple[Condition, ...], float]], intercept: float) -> Column:
    """Score as one column expression over the statistics.

    The weights are added by a fold, not by a chain of sums: of a chain Spark makes one method with all rules, and to
    compile that took the driver some 200 MB.
    """
    terms = []
    for rule, weight in rules:
        tests = [F.col(COLUMNS[f]) > cut if greater else F.col(COLUMNS[f]) <= cut for f, greater, cut in rule]
        terms.append(F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(F.lit(0.0)))
    total = F.aggregate(F.array(*terms), F.lit(intercept), lambda a, x: a + x) if terms else F.lit(intercept)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fitted_score(stats: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3,
                 sample_rows: int = SAMPLE_ROWS) -> Column:
    """Score expression learned from the labelled rows of ``stats`` outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()) \
        .where(remainder(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.min("quality").alias("__label"))
    rows = stats.select("doc_id", *COLUMNS).join(known, "doc_id")
    order = [F.xxhash64("doc_id"), "doc_id", *COLUMNS]
    # the smallest hashes come first, so rows above a bound on the hash need not be sent: about 1.5 times the sample is
    share = min(1.0, 1.5 * sample_rows / max(1, known.count()))
    low = rows.where(F.xxhash64("doc_id") <= int(-(2 ** 63) + share * 2 ** 64)) if share < 1 else rows
    sample = low.orderBy(*order).limit(sample_rows).select(*COLUMNS, "__label").toPandas()
    if len(sample) < sample_rows and share < 1:  # fewer labelled documents than labels: the same rows without the bound
        sample = rows.orderBy(*order).limit(sample_rows).select(*COLUMNS, "__label").toPandas()
    return compiled(*fit_rules(sample[COLUMNS].to_numpy(float), sample["__label"].to_numpy(int)))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3,
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the statistics behind the score, one row per document."""
    stats = stored(with_stats(docs, "doc_id"), "stats")
    score = fitted_score(stats, labels, held_out, folds, sample_rows)
    return stats.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), score.alias("score"),
                        (score >= 0.5).cast("int").alias("predicted"),
                        *(F.col(c).alias(s) for c, s in zip(COLUMNS, STATS, strict=True)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that the classifier accepts, with the columns of ``docs``; the labels are used as in ``quality_scores``."""
    stats = stored(with_stats(docs, *docs.columns), "stats")
    return stats.where(fitted_score(stats, labels) >= 0.5).select(*docs.columns)
