"""Benchmark decontamination: an FM-index for each training shard, searched for all benchmark windows.

A task cuts its documents into shards of bounded size. Words that no benchmark item uses are separators, runs
too short for any window are left out, and the rest of a shard is indexed: suffix array by prefix doubling,
Burrows-Wheeler transform, wavelet-matrix ranks and every eighth suffix position. All windows are searched
backwards at once; occurrences are located by walking to a sampled position; their word ranges are merged into
removal spans. The benchmark is the stated query set: it is sent in blocks of bounded size, documents never move.

Words are maximal runs of letters, digits and code points from U+0080, with A-Z in lower case. A window is ten
consecutive words of an item; a shorter item is one window; an item without words has none.

Defined results: null or empty texts have no words and are clean; equal documents get equal results; items that
share an id count as one; a null item id reads as the empty string; no benchmark means no hits; columns other
than ``text`` pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, with_fields

WINDOW = 10
BLOCK_WINDOWS = 100_000  # windows in one broadcast block
SHARD_WORDS = 1_000_000  # words of the documents that a task holds at once
INDEX_SYMBOLS = 500_000  # symbols in one index
SAMPLE_STEP = 8

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TO_BLANK = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_BLANK).split() if text else []


class FmIndex:
    """FM-index of an array of symbols from 0 to ``top``; 0 separates and is never searched.

    Inside, symbols are one higher, and a single 0 ends the text.
    """

    def __init__(self, symbols: np.ndarray, top: int):
        symbols = np.concatenate([symbols.astype(np.int64) + 1, [0]])
        top, n = top + 1, len(symbols)
        suffixes = self.suffix_array(symbols)
        self.last = symbols[suffixes - 1]  # of the whole text: the ending 0
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))]).astype(np.int64)
        self.sampled = suffixes % SAMPLE_STEP == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = suffixes[self.sampled]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = self.last
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)])
            zeros = n - int(before[-1])
            self.levels.append((bit, before, zeros))
            row = np.concatenate([row[ones == 0], row[ones == 1]])
        self.first = self._descend(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))  # where each symbol's rows end up

    @staticmethod
    def suffix_array(symbols: np.ndarray) -> np.ndarray:
        """Order of all suffixes by prefix doubling."""
        n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
        step = 1
        while True:
            key = rank * (n + 2)
            key[: n - step if step < n else 0] += rank[step:]
            order = np.argsort(key)
            in_order = key[order]
            new = np.empty(n, dtype=np.int64)
            new[order] = np.concatenate([[1], 1 + np.cumsum(in_order[1:] != in_order[:-1])])
            if step >= n or new[order[-1]] == n:
                return order
            rank, step = new, step * 2

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, before, zeros in self.levels:
            ones = before[at]
            at = np.where((symbols >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first ``at`` rows of the transform."""
        return self._descend(symbols, at) - self.first[symbols]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all windows (rows of symbols, filled up with 0 on the left), by backward search."""
        lo = np.zeros(len(windows), dtype=np.int64)
        hi = np.full(len(windows), len(self.last), dtype=np.int64)
        width = windows.shape[1]
        for k in range(width - 1, -1, -1):
            live = np.flatnonzero((lengths >= width - k) & (lo < hi))
            if not len(live):
                break
            c = windows[live, k] + 1
            lo[live] = self.below[c] + self.rank(c, lo[live])
            hi[live] = self.below[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to a sampled position."""
        out = np.full(len(rows), -1, dtype=np.int64)
        todo, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            c = self.last[rows]
            rows = self.below[c] + self.rank(c, rows)
            steps += 1
        return out


# -- the query set --------------------------------------------------------------------------------------------------

def query_blocks(benchmark: DataFrame, window: int = WINDOW) -> tuple[dict[bytes, int], list[str], list[dict], int]:
    """Word numbers, item ids, blocks of distinct windows with their items, and the length of the shortest window."""
    vocabulary: dict[bytes, int] = {}
    items: dict[str, int] = {}
    windows: dict[tuple[int, ...], set[int]] = {}
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t"))
    for row in rows.toLocalIterator():
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(row.t)]
        if ids:
            item = items.setdefault(row.i, len(items))
            for k in range(max(1, len(ids) - window + 1)):
                windows.setdefault(tuple(ids[k:k + window]), set()).add(item)
    blocks = []
    every = list(windows.items())
    for k in range(0, len(every), BLOCK_WINDOWS):
        part = every[k:k + BLOCK_WINDOWS]
        rows = np.zeros((len(part), window), dtype=np.int64)
        for i, (ids, _) in enumerate(part):
            rows[i, window - len(ids):] = ids
        blocks.append({
            "windows": rows, "lengths": np.array([len(ids) for ids, _ in part]),
            "item_start": np.cumsum([0, *(len(x) for _, x in part)]), "items": np.array([i for _, x in part for i in sorted(x)]),
        })
    return vocabulary, list(items), blocks, min(map(len, windows), default=1)


# -- one shard ------------------------------------------------------------------------------------------------------

def reduced(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least ``shortest`` known words, a separator after each; and the place of every symbol in ``ids``."""
    known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
    change = np.flatnonzero(np.diff(known))
    starts, ends = change[::2], change[1::2]
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    sizes = ends - starts + 1  # with the separator
    total = int(sizes.sum())
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    symbols = np.where(np.arange(total) == np.repeat(np.cumsum(sizes) - 1, sizes), 0, ids[np.minimum(place, len(ids) - 1)])
    return symbols, place


def search_shard(ids: np.ndarray, owner: np.ndarray, blocks: list[dict], top: int, shortest: int,
                 n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words are hit, and distinct ``document * n_items + item`` numbers. ``owner``: document of each word."""
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    found = [np.empty(0, np.int64)]
    symbols, place = reduced(ids, shortest)
    overlap = max((int(b["lengths"].max()) for b in blocks), default=1) - 1
    for start in range(0, len(symbols), INDEX_SYMBOLS):
        part = symbols[start:start + INDEX_SYMBOLS + overlap]
        index = FmIndex(part, top)
        for block in blocks:
            lo, hi = index.search(block["windows"], block["lengths"])
            which = np.flatnonzero(hi > lo)
            for k in range(0, len(which), 4096):
                some = which[k:k + 4096]
                counts = hi[some] - lo[some]
                for window, at in occurrences(index, some, lo[some], counts):
                    word = place[start + at]
                    np.add.at(edges, word, 1)
                    np.add.at(edges, word + block["lengths"][window], -1)
                    pair = np.unique(owner[word] * len(block["lengths"]) + window)
                    doc, window = np.divmod(pair, len(block["lengths"]))
                    many = block["item_start"][window + 1] - block["item_start"][window]
                    first = np.repeat(block["item_start"][window] - np.cumsum(many) + many, many)
                    found.append(np.unique(np.repeat(doc, many) * n_items + block["items"][first + np.arange(len(first))]))
    return np.cumsum(edges[:-1]) > 0, np.unique(np.concatenate(found))


def occurrences(index: FmIndex, windows: np.ndarray, lo: np.ndarray, counts: np.ndarray,
                most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of window number and text position, in pieces of bounded size."""
    ends = np.cumsum(counts)
    for a in range(0, int(ends[-1]), most):
        k = np.arange(a, min(a + most, int(ends[-1])))
        which = np.searchsorted(ends, k, side="right")
        yield windows[which], index.locate(lo[which] + k - (ends - counts)[which])


def removal_spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges from the first to the last word of every run of hit words."""
    places = [m.span() for m in WORD.finditer(raw)]
    change = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(places[a][0], places[b - 1][1]) for a, b in zip(change[::2], change[1::2], strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, *keep: str, cut: bool = False, window: int = WINDOW,
                  prefix: str = "") -> DataFrame:
    """The ``keep`` columns with ``n_words, n_hit, items array<string>, spans array<struct<start,end>>``.

    Spans count code points, end exclusive. With ``cut`` the kept ``text`` is returned without its spans.
    ``prefix`` goes before the names of the four, where the kept columns have such names.
    """
    names_out = [prefix + x for x in ("n_words", "n_hit", "items", "spans")]
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    vocabulary, items, blocks, shortest = query_blocks(benchmark, window)
    context = docs.sparkSession.sparkContext
    sent_words, sent_blocks = context.broadcast((vocabulary, items)), [context.broadcast(b) for b in blocks]

    def results(held: list[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        """Search the documents held; equal ones are indexed once."""
        known: dict[bytes, int] = {}
        rows = [[known.setdefault(x.tobytes(), len(known)) for x in ids] for _, ids in held]
        unique = [np.frombuffer(x, np.int32) for x in known]
        sizes = np.array([len(x) + 1 for x in unique], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), dtype=np.int64)
        for a, x in zip(starts, unique, strict=True):
            ids[a:a + len(x)] = x
        names, n = sent_words.value[1], len(sent_words.value[1])
        owner = np.repeat(np.arange(len(unique)), sizes)
        hit, pairs = search_shard(ids, owner, [b.value for b in sent_blocks], len(sent_words.value[0]), shortest, n)
        counts = np.bincount(owner[hit], minlength=len(unique))
        first = np.searchsorted(pairs, np.arange(len(unique) + 1) * n)
        for (batch, _), row in zip(held, rows, strict=True):
            texts = batch.column("text").to_pylist()
            spans, own = [], []
            for i, d in enumerate(row):
                own.append([names[x] for x in pairs[first[d]:first[d + 1]] % n] if n else [])
                if not counts[d]:
                    spans.append([])
                    continue
                raw = texts[i].encode()
                found = removal_spans(raw.lower(), hit[starts[d]:starts[d] + len(unique[d])])
                if cut:
                    ends = [0, *(x for s in found for x in s), len(raw)]
                    texts[i] = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)).decode()
                at, done, out = 0, 0, []
                for a, b in found:
                    start = done + len(raw[at:a].decode())
                    at, done = b, start + len(raw[a:b].decode())
                    out.append({"start": start, "end": done})
                spans.append(out)
            kept = [pa.array(texts, pa.string()) if k == "text" else batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([
                *kept, pa.array([len(unique[d]) for d in row], pa.int64()), pa.array([int(counts[d]) for d in row], pa.int64()),
                pa.array(own, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], names=[*keep, *names_out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent_words.value[0].get
        held, size = [], 0
        for batch in batches:
            ids = []
            for text in batch.column("text").to_pylist():
                found = words_of(text)
                ids.append(np.array([get(w, 0) for w in found], dtype=np.int32))
                size += len(found)
            held.append((batch, ids))
            if size >= SHARD_WORDS:
                yield from results(held)
                held, size = [], 0
        if held:
            yield from results(held)

    kinds = ("bigint", "bigint", "array<string>", "array<struct<start:bigint,end:bigint>>")
    return map_texts(source, run, with_fields(docs, keep, ", ".join(f"{n} {k}" for n, k in zip(names_out, kinds, strict=True))))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the spans that repeat the benchmark; ``n_chars`` follows the text where there is such a column."""
    clean = contamination(docs, benchmark, *docs.columns, cut=True, window=window, prefix="__bm_")
    if "n_chars" in docs.columns:
        changed = F.when(F.col("__bm_n_hit") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", changed)
    return clean.select(*docs.columns)
