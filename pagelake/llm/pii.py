"""Personal data: fixed base kinds, and identifiers found through the contexts in which those occur.

Every whole text is searched for e-mail addresses, IPv4 addresses, payment cards and phone numbers. These seeds
induce lexical patterns: the word before, the two words before, and the word before with the word after. Patterns
and identifier-like tokens form a graph that Spark scores in rounds: a pattern is worth the summed scores of its
instances over all the places where its words stand in the corpus; an instance is worth the noisy-or of its
patterns; promoted instances strengthen further patterns, with or without seeds of their own, until none changes.
Tokens that confident patterns single out become spans of the kind that most of the pattern's promoted instances
have. Base spans always stay; added spans never overlap them.

Defined results: a null text counts as empty and has no spans; repeated rows get equal results; words of a context
longer than 40 characters are compared by a digest of the whole word; contexts and places come from the same tokens;
without seeds nothing is added; further columns pass through. Tables of the graph hold digests in place of identifiers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored, with_fields

KINDS = ("email", "ip", "card", "phone")
FILTER_BITS = 1 << 26  # of the filter that spares the tasks most words without a supported pattern
FLUSHED_PATTERNS = 400_000  # distinct patterns that a counting task holds
SUPPORT = 3  # distinct instances of a pattern
CONFIDENCE = 0.5
SETTLED = 1e-3  # rounds go on while the score of an instance rises by more
WORD_CHARS = 40  # longer words stand as a digest of the whole word

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SIGN = re.compile(r"[0-9@]")
BLANK = re.compile(r"\s")
TOKEN = re.compile(r"[^\w\s]+|\w\S*")
PUNCTUATION_FIRST = re.compile(r"[^\w\s]+(?=\w)")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each domain back over its local part: the same matches as a scan from the left, in linear time."""
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield "email", start, done


def base_spans(text: str) -> list[Span]:
    """Base spans in the order of their start, then of KINDS."""
    found: list[Span] = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) < 4 and int(p or "0") < 256 for p in parts):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def identifier_tokens(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Tokens of six characters or more with a digit or @, without the punctuation around, apart from ``taken``."""
    at, k = 0, 0
    spans = sorted((a, b) for _, a, b in taken)
    while m := SIGN.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = e.start() if (e := BLANK.search(text, m.start())) else len(text)
        at = end
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if end - start >= 6 and not any(a < end and start < b for a, b in spans[k:k + 8]):
            yield start, end


def all_candidates(text: str) -> list[tuple[str | None, int, int]]:
    """Base spans, then identifier-like tokens without a kind."""
    if not SIGN.search(text):
        return []
    base = base_spans(text)
    return [*base, *((None, *s) for s in identifier_tokens(text, base))]


def digest(text: str) -> bytes:
    """Stands for an identifier wherever it is compared, so that none is written to a table."""
    return blake2b(text.encode(), digest_size=16).digest()


def slots(text: str, spans: list) -> tuple[list[str], list[str | None], dict[int, list]]:
    """Tokens of a text, the token behind each, and the spans by the number of their token.

    A span is one token (overlapping ones together). Between spans, punctuation before a word is a token of its own;
    punctuation after a word belongs to it, but is what stands behind the word when that fills a pattern.
    """
    tokens: list[str] = []
    held: dict[int, list] = {}
    at = k = 0
    spans = sorted(spans, key=lambda s: s[1])
    while k < len(spans):
        first, end = k, spans[k][2]
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        tokens += TOKEN.findall(text[at:spans[first][1]].lower())
        held[len(tokens)] = spans[first:k]
        tokens.append(digest(text[spans[first][1]:end].lower()).hex())
        at = end
    tokens += TOKEN.findall(text[at:].lower())
    words = [t if len(t) <= WORD_CHARS else digest(t).hex() for t in tokens]
    behind: list[str | None] = [*words[1:], None][:len(words)]
    for i in [i for i, t in enumerate(tokens) if not t[-1].isalnum()]:
        if i not in held and (core := PUNCTUATION_FIRST.match(tokens[i][::-1])):
            mark = tokens[i][len(tokens[i]) - core.end():]
            behind[i] = mark if len(mark) <= WORD_CHARS else digest(mark).hex()
    return words, behind, held


def patterns_at(words: list[str], behind: list[str | None], i: int) -> list[str]:
    """Lexical patterns around a token."""
    if not i:
        return []
    out = [f"{words[i - 1]} _"]
    if i > 1:
        out.append(f"{words[i - 2]} {words[i - 1]} _")
    if behind[i] is not None:
        out.append(f"{words[i - 1]} _ {behind[i]}")
    return out


def contexts(text: str) -> Iterator[tuple[str | None, int, int, str]]:
    """``kind, start, end, pattern``: every base span and identifier-like token in its patterns."""
    if spans := all_candidates(text):
        words, behind, held = slots(text, spans)
        for i, here in held.items():
            for p in patterns_at(words, behind, i):
                yield from ((*s, p) for s in here)


def with_row_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row_key", F.xxhash64("doc_id", "text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """``row_key, start, end, instance, kind, pattern``: every base span and identifier-like token (as a digest) in its contexts."""
    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for key, text in zip(b.column("__row_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                text = text or ""
                rows.extend((key, a, z, digest(text[a:z]), kind, p) for kind, a, z, p in contexts(text))
            names = ["row_key", "start", "end", "instance", "kind", "pattern"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    schema = "row_key bigint, start bigint, end bigint, instance binary, kind string, pattern string"
    return map_texts(with_row_key(docs.select("doc_id", "text")).select("__row_key", "text"), run, schema)


def pattern_filter(patterns: DataFrame) -> bytes:
    """A bit for the hash of each pattern, FILTER_BITS at any number of patterns: others may share a bit, none is missed."""
    held = patterns.select((F.crc32("pattern") % FILTER_BITS).alias("at")) \
        .groupBy(F.expr("cast(at div 64 as int)").alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype="<i8")
    out[held.column("place").to_numpy()] = held.column("bits").to_numpy()
    return out.tobytes()


def places(texts: list[str | None]) -> Iterator[tuple[str, int]]:
    """Patterns around every token, and at how many places of the texts they stand; ``contexts`` has no others."""
    cut = [slots(t, all_candidates(t)) for t in texts if t]
    for p, n in Counter(chain.from_iterable(w[:-1] for w, _, _ in cut)).items():
        yield f"{p} _", n
    for (p, q), n in Counter(chain.from_iterable(zip(w, w[1:-1]) for w, _, _ in cut)).items():
        yield f"{p} {q} _", n
    for (p, q), n in Counter(chain.from_iterable(zip(w, b[1:]) for w, b, _ in cut)).items():
        if q is not None:
            yield f"{p} _ {q}", n
    for w, b, held in cut:
        for i, here in held.items():
            if len(here) > 1:  # overlapping spans count one by one
                yield from ((p, len(here) - 1) for p in patterns_at(w, b, i))


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: at how many places of the corpus the words of each pattern stand; others may be among them."""
    sent = docs.sparkSession.sparkContext.broadcast(pattern_filter(patterns))

    def run(batches):
        bits, totals = sent.value, Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())],
                                              names=["pattern", "total"])

        for b in batches:
            for p, n in places(b.column("text").to_pylist()):
                at = crc32(p.encode()) % FILTER_BITS
                if bits[at >> 3] >> (at & 7) & 1:
                    totals[p] += n
            if len(totals) > FLUSHED_PATTERNS:
                yield rows()
                totals = Counter()
        yield rows()

    return map_texts(docs.select("text"), run, "pattern string, total bigint").groupBy("pattern").agg(F.sum("total").alias("total"))


def discovered(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, settled: float = SETTLED) -> DataFrame:
    """``row_key, kind, start, end`` of identifiers that no base pattern covers."""
    seen = stored(occurrences(docs), "occurrences")
    graph = stored(seen.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("kind").alias("kind")), "graph")
    supported = stored(graph.groupBy("pattern").agg(F.count("*").alias("k"), F.sum("n").alias("most")).where(F.col("k") >= support), "supported")
    totals = supported.join(pattern_totals(docs, supported.select("pattern")), "pattern", "left")
    totals = totals.withColumn("total", F.coalesce("total", F.raise_error("a pattern without a total").cast("bigint")))
    totals = stored(totals.where(f"most / (total + 1) >= {confidence}").select("pattern", "total"), "totals")
    graph = stored(graph.join(totals, "pattern"), "weighed")
    scores = graph.groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("score", F.col("kind").isNotNull().cast("double"))
    scores = stored(scores, "scores")
    good = F.col("score") >= confidence
    # the kind of a pattern is the one that most of its promoted instances have, the first by name among equals
    most = F.array_min(F.array(*[F.struct((-F.count_if(good & (F.col("kind") == k))).alias("c"), F.lit(k).alias("kind")) for k in KINDS]))["kind"]
    moved = True
    while moved:
        weighed = graph.select("pattern", "instance", "n", "total").join(scores, "instance").groupBy("pattern").agg(
            F.sum(F.col("n") * F.col("score")).alias("good"), F.max("total").alias("total"), F.count_if(good).alias("k"), most.alias("kind"))
        sure = weighed.where(f"k >= {support}").select("pattern", "kind", F.least(F.lit(0.99), F.col("good") / (F.col("total") + 1)).alias("worth")) \
            .where(F.col("worth") >= confidence)
        sure = stored(sure, "patterns")
        found = graph.select("pattern", "instance").join(sure, "pattern").groupBy("instance").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("worth"))))).alias("found"), F.min("kind").alias("found_kind"))
        now = F.greatest("score", F.coalesce("found", F.lit(0.0)))
        scores = stored(scores.join(found, "instance", "left").select(
            "instance", F.coalesce("kind", "found_kind").alias("kind"), now.alias("score"), (now - F.col("score")).alias("step"), good.alias("was")), "scores")
        # scores only rise, so this ends: with no instance that crosses the bound and none that rises further
        moved = bool(scores.where((F.col("step") > settled) | (good & ~F.col("was"))).limit(1).count())
    promoted = scores.where(good).select("instance")
    hits = seen.where(F.col("kind").isNull()).drop("kind").join(sure, "pattern").join(promoted, "instance")
    return hits.groupBy("row_key", "start", "end").agg(F.min("kind").alias("kind"))


def personal_data(docs: DataFrame, *keep: str, prefix: str = "") -> DataFrame:
    """The ``keep`` columns with ``base`` and ``added``, arrays of ``struct<kind,start,end>`` in code points.

    ``prefix`` goes before the names of these two, where the kept columns have such names.
    """
    extra = discovered(docs)
    extra = extra.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    keyed = with_row_key(docs.select(*keep) if {"doc_id", "text"} <= set(keep) else docs.select(*dict.fromkeys((*keep, "doc_id", "text"))))
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in base_spans(t or "")] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), b.column("__row_key"), pa.array(spans, pa.list_(one))],
                                             names=[*keep, "__row_key", "__base"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    based = map_texts(keyed, run, with_fields(docs, keep, f"__row_key bigint, __base {span}"))
    joined = based.join(extra.toDF("__row_key", "__added"), "__row_key", "left")
    return joined.select(*keep, F.col("__base").alias(f"{prefix}base"), F.coalesce("__added", F.array().cast(span)).alias(f"{prefix}added"))


def all_spans(base: str = "base", added: str = "added") -> Column:
    """Base and added spans together, by start and then by kind as listed."""
    rank = F.array(*map(F.lit, KINDS))
    keyed = F.transform(F.concat(base, added), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(keyed)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with ``[KIND]`` in place of every span (of overlapping spans, the first kind); ``n_chars`` follows."""
    found = personal_data(docs, *docs.columns, prefix="__")
    schema = docs.schema
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, (base, added) in enumerate(zip(b.column("__base").to_pylist(), b.column("__added").to_pylist(), strict=True)):
                if not base and not added:
                    continue
                text, out, at = texts[i], [], 0
                for s in sorted([*base, *added], key=lambda s: (s["start"], KINDS.index(s["kind"]))):
                    if s["start"] >= at:
                        out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
                    at = max(at, s["end"])
                texts[i] = "".join([*out, text[at:]])
            columns = [b.column(k) for k in schema.names]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(x or y) for x, y in zip(
                b.column("__base").to_pylist(), b.column("__added").to_pylist(), strict=True)], pa.bool_())], names=[*schema.names, "__changed"])

    out = map_texts(found, run, with_fields(docs, docs.columns, "__changed boolean"))
    if "n_chars" in schema.names:
        new = F.char_length("text").cast(schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("__changed"), new).otherwise(F.col("n_chars")))
    return out.select(*schema.names)
