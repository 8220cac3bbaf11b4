"""Document log-likelihood by a gated recurrent language model with a class-factored output.

Token counts cover all training documents and come from one distributed count. The 1,024 most frequent tokens are
symbols of the network, in 16 classes of 64; every other token belongs to one of 32 tail classes (by its last two
bytes), and within a tail class it has its smoothed share of the counts, with one more share for an unseen token.
The network (one gated recurrent layer, numpy) predicts the class and then the symbol within the class. It is
trained by truncated backpropagation inside Spark tasks on every training document once: their hash deals them over
the rounds and over trainers, whose number grows with the square root of the corpus; each trainer reads its documents in the
order of their hash, so the network does not depend on how the input is partitioned. After each round the weights of
all trainers are averaged, by sums that meet in groups. Training reads
documents in pieces of 2,048 tokens, so that long ones do not leave lanes empty. To score, the state runs through whole
documents, window by window, many documents side by side.

Counts of frequent tokens go to the tasks in a table of bounded size; those of all others are joined.

Defined results: a null text counts as empty and has just its end token; repeated rows are scored alike; without
training documents all counts are 0 and the network keeps its first weights; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import pairwise, product
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, one_thread, remainder, stored

SYMBOLS, CLASS_SIZE, TAIL_CLASSES = 1024, 64, 32
CLASSES = SYMBOLS // CLASS_SIZE
HIDDEN = 24
HEAD_TOKENS = 300_000  # frequent tokens whose counts every task holds
FLUSHED_TOKENS = 400_000  # rare tokens that are remembered
COUNTED_TOKENS = 4_000_000  # tokens that a counting task holds
RATES = (0.04, 0.02, 0.01)  # learning rates, one for each round
TRAIN_LANES, TRAIN_STEPS, TRAIN_CHUNK, TRAIN_PIECE = 256, 16, 1_500_000, 2_048
LANES, STEPS, SCORE_CHUNK = 256, 24, 3_000_000  # tokens scored side by side: one long document should not leave the other lanes empty
TRAINER_UNIT = 40_000  # a round of n tokens has sqrt(n / TRAINER_UNIT) trainers
MERGED = 64  # networks that are added in one task
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Words in the order of the text, A-Z in lower case, split at blanks and U+0009 to U+000D."""
    return text.encode().lower().split() if text else []


def tail_class(word: bytes) -> int:
    return crc32(word[-2:]) % TAIL_CLASSES


def words_of_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (see ``words_of``) of many texts in one array, and how many each text has."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    lists = pc.ascii_split_whitespace(texts)
    words, sizes = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) & (sizes > 0)  # split into one empty word
    if blank.any():
        words = words.filter(pc.not_equal(pc.binary_length(words), 0))
        sizes[blank] = 0
    return words, sizes


def with_ends(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the words of many texts with a 0, the end token, after each text."""
    out = np.zeros(len(values) + len(sizes), dtype=np.int32)
    out[np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes)] = values
    return out


@cache
def tail_table() -> np.ndarray:
    """The tail class of every ending of two bytes, and behind them of every single byte."""
    return np.array([tail_class(bytes(pair)) for pair in product(range(256), repeat=2)] + [tail_class(bytes([b])) for b in range(256)], np.int32)


def tail_classes(words: pa.Array) -> np.ndarray:
    """``tail_class`` of many words, none of them empty."""
    if not len(words):
        return np.zeros(0, dtype=np.int32)
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data, last, single = np.frombuffer(data, np.uint8), edges[1:] - 1, np.diff(edges) == 1
    return tail_table()[np.where(single, 65536, data[last - ~single].astype(np.int64) * 256) + data[last]]


# -- counts ---------------------------------------------------------------------------------------------------------

def token_counts(train: DataFrame) -> DataFrame:
    """``word binary, c bigint`` over all training documents; the end token is the empty word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Array] = []
        size = ends = 0

        def rows():
            found = pa.chunked_array(kept, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "c"])

        for b in batches:
            words, sizes = words_of_all(b.column("text"))
            kept.append(words)
            size, ends = size + len(words), ends + len(sizes)
            if size > COUNTED_TOKENS:
                yield rows()
                kept, size = [], 0
        if size:
            yield rows()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "c"])

    return map_texts(train.select("text"), run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Frequent tokens with their counts, and the smoothed sizes of the tail classes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int, tails: np.ndarray):
        self.words, self.counts, self.n, self.v = words, counts, n, v
        self.tails = tails  # with the share of one unseen token


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = counts.where(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(HEAD_TOKENS).toArrow()
    ends = counts.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0
    words = [END, *top.column("word").to_pylist()]
    known = np.array([ends, *top.column("c").to_pylist()], dtype=np.int64)
    tails = np.full(TAIL_CLASSES, 0.5)
    kind = (F.crc32(F.expr("substring(word, -2, 2)")) % TAIL_CLASSES).cast("int")
    for r in counts.groupBy(kind.alias("k")).agg(F.sum(F.col("c") + 0.5).alias("s")).collect():
        tails[r.k] += float(r.s)
    for w, c in zip(words[:SYMBOLS], known[:SYMBOLS].tolist(), strict=True):
        if c:
            tails[tail_class(w)] -= c + 0.5
    return Vocabulary(words, known, int(total.n or 0), int(total.v), np.maximum(tails, 0.5))


# -- network --------------------------------------------------------------------------------------------------------

def first_weights(vocab: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; output biases from the counts, so that training begins at the unigram model."""
    rng = np.random.default_rng(seed)
    share = np.full(SYMBOLS, 1e-6)
    used = min(SYMBOLS, len(vocab.words))
    share[:used] = vocab.counts[:used] + 0.5
    share = share.reshape(CLASSES, CLASS_SIZE)
    sizes = np.concatenate([share.sum(axis=1), vocab.tails])
    w = {
        "input": rng.normal(0, 0.1, (SYMBOLS + TAIL_CLASSES, 3 * HIDDEN)),
        "state": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN)),
        "class": rng.normal(0, 0.02, (HIDDEN, CLASSES + TAIL_CLASSES)), "class_bias": np.log(sizes / sizes.sum()),
        "symbol": rng.normal(0, 0.02, (CLASSES, HIDDEN, CLASS_SIZE)), "symbol_bias": np.log(share / share.sum(axis=1, keepdims=True)),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in the memory of ``x``."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def run_states(w: dict[str, np.ndarray], x: np.ndarray, new: np.ndarray, h: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States after each step of ``x`` (steps, lanes) from ``h``; ``new`` marks document starts, where the state is 0.

    Inside, lanes are columns, so that every gate is one piece of memory; ``trace`` takes the states before each step,
    the gates and the candidates in that form.
    """
    inputs = w["input"][x].transpose(0, 2, 1).astype(h.dtype, order="C")  # becomes the gates
    turned = np.ascontiguousarray(w["state"].T)
    out = np.empty((len(x), HIDDEN, x.shape[1]), dtype=h.dtype)
    before, candidates = np.empty_like(out), np.empty_like(out)
    starts = new.any(axis=1)
    h = h.T
    for t, gates in enumerate(inputs):
        before[t] = h
        if starts[t]:
            before[t, :, new[t]] = 0
        s = turned @ before[t]
        gates[:2 * HIDDEN] += s[:2 * HIDDEN]
        sigmoid(gates[:2 * HIDDEN])
        c = np.multiply(gates[HIDDEN:2 * HIDDEN], s[2 * HIDDEN:], out=candidates[t])
        c += gates[2 * HIDDEN:]
        np.tanh(c, out=c)
        gates[2 * HIDDEN:] = s[2 * HIDDEN:]
        h = np.subtract(c, before[t], out=out[t])
        h *= gates[:HIDDEN]
        h += before[t]
    if trace is not None:
        trace += [before, inputs, candidates]
    return np.ascontiguousarray(out.transpose(0, 2, 1))


def softmax(a: np.ndarray, parts: Sequence[slice] = (slice(None),)) -> np.ndarray:
    """Shares of each row, in the memory of ``a``, part by part. States lie within 1, so only wild weights need the bound."""
    np.minimum(a, 80, out=a)
    np.exp(a, out=a)
    ones = np.ones(a.shape[1], a.dtype)
    for part in parts:
        a[part] /= (a[part] @ ones + a.dtype.type(1e-30))[:, None]
    return a


def log_picked(a: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One entry of the log-softmax of each row, in the memory of ``a``; bounded like ``softmax``."""
    np.minimum(a, 80, out=a)
    picked = a[np.arange(len(a)), places]
    np.exp(a, out=a)
    return picked - np.log(a @ np.ones(a.shape[1], a.dtype) + a.dtype.type(1e-30))


def class_groups(y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Places of the targets that are symbols, class by class, and the classes with their stretches of it."""
    order = np.argsort(y.astype(np.int16), kind="stable")  # numbers this short are sorted by their digits
    edges = np.searchsorted(y[order], np.arange(CLASSES + 1) * CLASS_SIZE).tolist()
    return order[:edges[-1]], [(k, slice(a, b)) for k, (a, b) in enumerate(pairwise(edges)) if a < b]


def symbol_logits(w: dict[str, np.ndarray], own: np.ndarray, groups: list[tuple[int, slice]]) -> np.ndarray:
    """A row per state: the logits of the symbols of its target's class."""
    d = np.empty((len(own), CLASS_SIZE), own.dtype)
    for k, part in groups:
        np.matmul(own[part], w["symbol"][k], out=d[part])
        d[part] += w["symbol_bias"][k]
    return d


def target_classes(y: np.ndarray) -> np.ndarray:
    return np.where(y < SYMBOLS, y // CLASS_SIZE, y - SYMBOLS + CLASSES)


def log_probabilities(w: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target: its class, and its place within a symbol class."""
    out = log_picked(h @ w["class"] + w["class_bias"], target_classes(y)).astype(float)
    at, groups = class_groups(y)
    out[at] += log_picked(symbol_logits(w, h[at], groups), y[at] % CLASS_SIZE)
    return out


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, new: np.ndarray, live: np.ndarray,
              h: np.ndarray, with_loss: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradient of the mean loss over one window by backpropagation that stops at its start; last state; loss."""
    trace: list = []
    states = run_states(w, x, new, h, trace)
    rows, targets = states.reshape(-1, HIDDEN), y.ravel()
    keep = live.ravel().astype(h.dtype)[:, None] / h.dtype.type(max(1, int(live.sum())))
    kinds, every, loss = target_classes(targets), np.arange(len(targets)), 0.0
    d = rows @ w["class"]
    d += w["class_bias"]
    softmax(d)
    if with_loss:
        loss -= float((np.log(np.maximum(d[every, kinds], 1e-30)) * keep[:, 0]).sum())
    d[every, kinds] -= 1
    d *= keep
    g = {k: np.zeros_like(w[k]) for k in ("input", "state", "symbol", "symbol_bias")}
    g["class"], g["class_bias"] = rows.T @ d, d.sum(axis=0)
    back = d @ w["class"].T
    at, groups = class_groups(targets)
    own, place, kept, every = rows[at], targets[at] % CLASS_SIZE, keep[at], every[:len(at)]
    d = softmax(symbol_logits(w, own, groups), [part for _, part in groups])
    if with_loss:
        loss -= float((np.log(np.maximum(d[every, place], 1e-30)) * kept[:, 0]).sum())
    d[every, place] -= 1
    d *= kept
    inward = np.empty_like(own)
    for k, part in groups:
        g["symbol"][k], g["symbol_bias"][k] = own[part].T @ d[part], d[part].sum(axis=0)
        np.matmul(d[part], w["symbol"][k].T, out=inward[part])
    back[at] += inward
    # lanes are columns from here on; what a step's error is multiplied by is known for all steps at once
    back = np.ascontiguousarray(back.reshape(states.shape).transpose(0, 2, 1))
    before, gates, c = trace
    z, r, s = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
    stay = 1 - z
    to_z = c - before
    to_z *= z
    to_z *= stay
    to_c = 1 - c * c
    to_c *= z
    to_r = 1 - r
    to_r *= r
    to_r *= s
    inner, to_state = np.empty_like(gates), np.empty_like(gates)
    starts, later = new.any(axis=1), np.zeros_like(back[0])
    for t in range(len(x) - 1, -1, -1):
        dh, own = back[t], inner[t]
        dh += later
        np.multiply(dh, to_z[t], out=own[:HIDDEN])
        np.multiply(dh, to_c[t], out=own[2 * HIDDEN:])
        np.multiply(own[2 * HIDDEN:], to_r[t], out=own[HIDDEN:2 * HIDDEN])
        to_state[t, :2 * HIDDEN] = own[:2 * HIDDEN]
        np.multiply(own[2 * HIDDEN:], r[t], out=to_state[t, 2 * HIDDEN:])
        later = w["state"] @ to_state[t]
        dh *= stay[t]
        later += dh
        if starts[t]:
            later[:, new[t]] = 0
    g["state"] = (before @ to_state.transpose(0, 2, 1)).sum(axis=0)
    order = np.argsort(x.ravel().astype(np.int16), kind="stable")
    sorted_x = x.ravel()[order]
    first = np.flatnonzero(np.diff(sorted_x, prepend=-1))
    g["input"][sorted_x[first]] = np.add.reduceat(inner.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order], first, axis=0)
    return g, states[-1], loss


class Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = w, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * np.float32(min(1.0, 1.0 / (size + 1e-12)))
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * x
            v *= 0.99
            x *= x
            v += 0.01 * x
            part = np.sqrt(v)
            part += 1e-8
            np.divide(m, part, out=part)
            part *= np.float32(self.rate * (1 - 0.99 ** self.t) ** 0.5 / (1 - 0.9 ** self.t))
            self.w[k] -= part


# -- documents in lanes ---------------------------------------------------------------------------------------------

def lanes_of(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents (target symbols, end included) laid end to end in lanes of about equal length.

    Returns inputs, targets, document starts and the document of each place (-1: filling), all (steps, lanes).
    """
    sizes = np.array([len(d) for d in docs])
    n = max(1, min(most, len(docs), int(sizes.sum() // max(1, sizes.max(initial=1)))))
    loads = np.zeros(n, dtype=np.int64)
    lanes: list[list[int]] = [[] for _ in range(n)]
    for i in np.argsort(-sizes, kind="stable"):
        k = int(loads.argmin())
        lanes[k].append(int(i))
        loads[k] += sizes[i]
    steps = int(loads.max(initial=0))
    x = np.zeros((steps, n), dtype=np.int32)
    y, new, owner = x.copy(), np.zeros((steps, n), dtype=bool), np.full((steps, n), -1, dtype=np.int32)
    for k, lane in enumerate(lanes):
        at = 0
        for i in lane:
            d = docs[i]
            y[at:at + len(d), k] = d
            x[at + 1:at + len(d), k] = d[:-1]  # the end symbol, 0, comes before the first
            new[at, k] = True
            owner[at:at + len(d), k] = i
            at += len(d)
    return x, y, new, owner


def document_logs(w: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of every document; the state is carried from window to window."""
    x, y, new, owner = lanes_of(docs, LANES)
    total = np.zeros(len(docs) + 1)
    h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
    for t in range(0, len(x), STEPS):
        states = run_states(w, x[t:t + STEPS], new[t:t + STEPS], h)
        h = states[-1]
        at = owner[t:t + STEPS].ravel()
        live = np.flatnonzero(at >= 0)
        logs = log_probabilities(w, states.reshape(-1, HIDDEN)[live], y[t:t + STEPS].ravel()[live])
        total += np.bincount(at[live], logs, len(docs) + 1)
    return total[:-1]


def train_on(w: dict[str, np.ndarray], docs: list[np.ndarray], adam: Adam) -> None:
    x, y, new, owner = lanes_of([d[i:i + TRAIN_PIECE] for d in docs for i in range(0, len(d), TRAIN_PIECE)], TRAIN_LANES)
    h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
    for t in range(0, len(x), TRAIN_STEPS):
        part = slice(t, t + TRAIN_STEPS)
        g, h, _ = gradients(w, x[part], y[part], new[part], owner[part] >= 0, h, with_loss=False)
        adam.step(g)


def symbols_of(words: pa.Array, sizes: np.ndarray, head: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Head numbers of the tokens of many texts (-1: none) and their symbols, ends included."""
    numbers = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy(zero_copy_only=False)
    symbols = numbers.copy()
    tails = np.flatnonzero((numbers < 0) | (numbers >= SYMBOLS))
    symbols[tails] = SYMBOLS + tail_classes(words.take(pa.array(tails)))
    return with_ends(numbers, sizes), with_ends(symbols, sizes)


def documents(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Tokens of many texts, text by text; every text has an end as well."""
    return np.split(values, np.cumsum(sizes + 1)[:-1]) if len(sizes) else []


def word_counts(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """list<struct(word, n)> for every text."""
    coded = words.dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    pairs, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    counted = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % kinds)), pa.array(n, pa.int64())], names=["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // kinds, np.arange(len(sizes) + 1)), pa.int32()), counted)


class Symbols(dict):
    """Symbols of tokens; those of rare tokens are remembered, for as many as a counting task holds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSHED_TOKENS:
            for old in [w for w, s in self.items() if s >= SYMBOLS]:
                del self[old]
        self[word] = symbol = SYMBOLS + tail_class(word)
        return symbol

    def of(self, words: list[bytes]) -> np.ndarray:
        """Symbols of a document's tokens, its end included."""
        out = np.zeros(len(words) + 1, dtype=np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out


# -- Spark ----------------------------------------------------------------------------------------------------------

def trained(train: DataFrame, vocab: Vocabulary, rates: tuple[float, ...] = RATES) -> dict[str, np.ndarray]:
    """Weights after one round per rate; every training document belongs to one round."""
    context = train.sparkSession.sparkContext
    w = first_weights(vocab)
    frequent = context.broadcast(vocab.words[:SYMBOLS])
    trainers = max(1, math.ceil(math.sqrt(vocab.n / max(1, len(rates)) / TRAINER_UNIT)))
    draw = F.xxhash64("doc_id", "text")
    for k, rate in enumerate(rates):
        sent = context.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            one_thread()
            own = {name: v.copy() for name, v in sent.value.items()}
            adam, docs, size, seen = Adam(own, rate), [], 0, 0
            head = pa.array(frequent.value, pa.binary())
            for b in batches:
                words, sizes = words_of_all(b.column("text"))
                for doc in documents(symbols_of(words, sizes, head)[1], sizes):
                    docs.append(doc)
                    size += len(doc)
                    if size >= TRAIN_CHUNK:
                        train_on(own, docs, adam)
                        docs, size, seen = [], 0, seen + size
            if docs:
                train_on(own, docs, adam)
            if seen + size:
                total = flat(own).astype(float) * (seen + size)
                yield pa.RecordBatch.from_arrays([pa.array([float(seen + size)]), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])

        dealt = train.withColumn("draw", draw).where(F.pmod("draw", F.lit(len(rates))) == k) \
            .repartitionById(trainers, F.pmod(F.xxhash64("draw"), F.lit(trainers)).cast("int")).sortWithinPartitions("draw", "doc_id", "text")
        values = map_texts(dealt.select("text"), run, "n double, w binary").withColumn("id", F.spark_partition_id().cast("bigint"))
        n, total = added(stored(values, "weights"))
        if n:
            w = shaped(total / n, w)
    return w


def added(parts: DataFrame) -> tuple[float, np.ndarray]:
    """Sum of ``n`` and of the vectors ``w``; tasks add them in groups of at most MERGED, until one is left."""
    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        total = sum(np.frombuffer(x.as_py()) for x in rows.column("w"))
        return pa.table({"n": [sum(rows.column("n").to_pylist())], "w": pa.array([total.tobytes()], pa.binary()), "id": rows.column("group")[:1]})

    size = (parts.agg(F.max("id")).first()[0] or 0) + 1
    while size > 1:
        size = -(-size // MERGED)
        parts = parts.withColumn("group", F.col("id") % size).groupBy("group").applyInArrow(add, "n double, w binary, id bigint")
    last = parts.first()
    return (last.n, np.frombuffer(last.w)) if last else (0.0, np.zeros(0))


def document_scores(docs: DataFrame, held_out: int = 1, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, logarithms to base 10."""
    fold = remainder(F.col("doc_id"), folds)
    train = docs.where(fold != held_out).select("doc_id", "text")
    counts = stored(token_counts(train), "counts")
    vocab = vocabulary(counts)
    weights = trained(train, vocab)
    sent = docs.sparkSession.sparkContext.broadcast((vocab, weights))  # HEAD_TOKENS words and one network
    norm = float(np.log10(vocab.n + 0.5 * (vocab.v + 1)))
    source = docs.select("doc_id", (fold == held_out).alias("held_out"), F.monotonically_increasing_id().alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        vocab, w = sent.value
        head, logs = pa.array(vocab.words, pa.binary()), np.log10(vocab.counts + 0.5)
        tail_logs = np.log10(vocab.tails)
        kept: list[tuple] = []
        size = 0

        def scored_rows() -> pa.RecordBatch:
            columns, sizes, known, symbols, rest = zip(*kept)
            ids, held_out, rows = (pa.concat_arrays(c) for c in zip(*columns))
            sizes, every, symbols = np.concatenate(sizes), np.concatenate(known), np.concatenate(symbols)
            network = document_logs(w, documents(symbols, sizes)) / np.log(10)
            doc = np.repeat(np.arange(len(ids)), sizes + 1)
            known, below, outside = every >= 0, every >= SYMBOLS, symbols >= SYMBOLS

            def summed(chosen: np.ndarray, of: np.ndarray) -> np.ndarray:
                return np.bincount(doc[chosen], of, len(ids))

            extra = summed(below, logs[every[below]]) - summed(outside, tail_logs[symbols[outside] - SYMBOLS])
            return pa.RecordBatch.from_arrays([
                ids, held_out, rows, pa.array(sizes + 1, pa.int64()), pa.array(summed(known, vocab.counts[every[known]] > 0).astype(np.int64)),
                pa.array(summed(known, logs[every[known]])), pa.array(network + extra), pa.concat_arrays(rest)],
                names=["doc_id", "held_out", "row", "n_tokens", "n_head", "head_score", "network_score", "rest"])

        for b in batches:
            words, sizes = words_of_all(b.column("text"))
            numbers, symbols = symbols_of(words, sizes, head)
            doc, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(words))
            rare = numbers[place + doc] < 0
            kept.append(([b.column(c) for c in ("doc_id", "held_out", "row")], sizes, numbers, symbols,
                         word_counts(words.take(pa.array(place[rare])), np.bincount(doc[rare], minlength=len(sizes)))))
            size += len(numbers)
            if size >= SCORE_CHUNK:
                yield scored_rows()
                kept, size = [], 0
        if kept:
            yield scored_rows()

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stored(map_texts(source, run, f"doc_id {kind}, held_out boolean, row bigint, n_tokens bigint, n_head bigint, head_score double, "
                              "network_score double, rest array<struct<word:binary,n:bigint>>"), "scored")
    rare = scored.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n")
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_score"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_rare"))
    more = F.coalesce("rare_score", F.lit(0.0))
    return scored.drop("rest").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"), (F.col("head_score") + more - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("network_score") + more).alias("score"))
