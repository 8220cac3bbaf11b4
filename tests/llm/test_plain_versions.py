"""Operators against plain versions of their method, and results that must not depend on the layout of the input."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pagelake.llm import chat, common, fingerprint, language, language_model, neardup, pii


# -- fingerprints ----------------------------------------------------------------------------------------------------

def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chained(values, width):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(width, "little", signed=True), h)
    return signed(h)


def plain_fingerprint(text):
    words = [chained([w.encode()], 8) for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    if not words:
        return ""
    shingles = {chained(words[i:i + 5], 8) for i in range(max(1, len(words) - 4))}
    least = {}
    for h in sorted(shingles):
        least.setdefault((h % 2**64) >> 57, h)
    bins = [least[j] if j in least else min((chained([j, k], 4), v) for k, v in least.items())[1] for j in range(128)]
    return "".join(f"{v & 255:02x}" for v in bins)


def test_fingerprints_equal_a_plain_version(spark, docs_of):
    rng = np.random.default_rng(3)
    texts = ["", "One", "one two  three\tfour", "a b c d e", "Été a b c d e f", *(" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (6, 40, 150, 900))]
    got = {r.text: r.f for r in docs_of(*texts).select("text", fingerprint.fingerprint(F.col("text")).alias("f")).collect()}
    assert got == {t: plain_fingerprint(t) for t in texts}


def test_fingerprints_are_computed_after_the_dealing(spark, docs_of):
    plan = fingerprint.edited_fingerprints(docs_of("a", "b"))._jdf.queryExecution().optimizedPlan().toString()
    # whole sorted shingle sets: of the rows that were dealt, and of the edited texts
    assert plan.count("sort_array(if") + plan.count("sort_array(CASE") == 2


# -- language model --------------------------------------------------------------------------------------------------

def plain_log(w, doc):
    """Natural log-probability of one document, a symbol at a time."""
    w = {k: v.astype(float) for k, v in w.items()}
    n = language_model.HIDDEN
    h, total, last = np.zeros(n), 0.0, 0
    for y in doc:
        x, s = w["input"][last], h @ w["state"]
        z, r = (1 / (1 + np.exp(-(x[i * n:(i + 1) * n] + s[i * n:(i + 1) * n]))) for i in (0, 1))
        h = (1 - z) * h + z * np.tanh(x[2 * n:] + r * s[2 * n:])
        a = h @ w["class"] + w["class_bias"]
        kind, place = divmod(y, language_model.CLASS_SIZE) if y < language_model.SYMBOLS else (y - language_model.SYMBOLS + language_model.CLASSES, None)
        total += a[kind] - math.log(np.exp(a).sum())
        if place is not None:
            b = h @ w["symbol"][kind] + w["symbol_bias"][kind]
            total += b[place] - math.log(np.exp(b).sum())
        last = y
    return total


def test_document_logs_equal_a_plain_forward_pass():
    rng = np.random.default_rng(2)
    vocab = language_model.Vocabulary([b"", *(b"w%d" % i for i in range(1500))], np.arange(1501, 0, -1), 10**6, 3000, np.full(32, 50.0))
    w = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in language_model.first_weights(vocab).items()}
    docs = [rng.integers(0, 1056, n) for n in (1, 130, 3, 64)]
    assert np.allclose(language_model.document_logs(w, docs), [plain_log(w, d.tolist()) for d in docs], rtol=1e-4)


def test_scores_do_not_depend_on_partitions(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(language_model, "TRAINER_UNIT", 1_000)  # several trainers
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    one, six = ({r.doc_id: r.score for r in language_model.document_scores(d).collect()} for d in (docs.coalesce(1), docs.repartition(6)))
    assert one.keys() == six.keys()
    assert all(abs(one[i] - six[i]) <= 1e-4 * abs(one[i]) + 1e-4 for i in one)


def test_symbols_remember_only_so_many(monkeypatch):
    monkeypatch.setattr(language_model, "FLUSHED_TOKENS", 5)
    symbols = language_model.Symbols({b"": 0, b"the": 1})
    words = [b"the", *(b"rare%d" % i for i in range(50)), b"the"]
    want = [1, *(language_model.SYMBOLS + language_model.tail_class(x) for x in words[1:-1]), 1, 0]
    assert symbols.of(words).tolist() == want and len(symbols) <= 8 and symbols[b"the"] == 1


# -- language identification ------------------------------------------------------------------------------------------

def test_predictions_equal_a_plain_nearest_centroid(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").limit(300)
    rows = docs.select("doc_id", "text").collect()
    model = language.fitted(docs.where("lang is not null").where(common.remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))

    def vector(text):
        """TF-IDF of the 1- to 3-grams, counted one by one."""
        line, kept = [32], False
        for c in text.lower():
            if c.isalpha():
                line.append(ord(c))
            elif kept:
                line.append(32)
            kept = c.isalpha()
        line.append(32)
        counts = Counter()
        for i in range(len(line)):
            code = 0
            for n in range(min(3, len(line) - i)):
                code = (code * 0x1F123BB5 + line[i + n] + n + 1) % 2**64
                counts[(code * 0x9E3779B97F4A7C15 % 2**64) >> 51] += 1
        v = np.zeros(language.DIMENSIONS)
        for k, c in counts.items():
            v[k] = math.log1p(c) * model["idf"][k]
        return v / np.linalg.norm(v)

    got = {r.doc_id: r for r in language.languages(docs).collect()}
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        v = vector(r.text)
        cosines = [float(v @ c) for c in model["centers"]]
        best = max(cosines)
        assert abs(got[r.doc_id].score - best) < 1e-4
        assert got[r.doc_id].lang_pred in {model["langs"][model["owner"][k]] for k, c in enumerate(cosines) if c > best - 1e-5}


# -- personal data ---------------------------------------------------------------------------------------------------

def test_long_words_are_compared_whole(spark, docs_of):
    good, bad = "k" * 50 + "a", "k" * 50 + "b"  # alike in their first 50 characters
    texts = [f"{good} user{i}@mail.org" for i in range(30)] + [f"{bad} item{i:06d}" for i in range(300)] + [f"{good} hidden77name"]
    added = {r.doc_id: r.added for r in pii.personal_data(docs_of(*texts), "doc_id").collect()}
    assert [s.kind for s in added[330]] == ["email"]
    assert not any(added[i] for i in range(330))


def test_no_identifier_is_written(spark, docs_of):
    docs = docs_of(*(f"write to user{i}@mail.org, badge{i:04d}x 10.0.0.{i}" for i in range(20)))
    for r in pii.occurrences(docs).collect():
        assert len(r.instance) == 16 and "@" not in r.pattern and "badge" not in r.pattern and "10.0" not in r.pattern


# -- chat ------------------------------------------------------------------------------------------------------------

def test_ties_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    roles = ["user", "assistant", "system", "robot"]
    rows = [(c, i, roles[k], f"t{i}") for c, n in ((1, 400), (2, 37), (3, 5)) for i, k in enumerate(rng.integers(0, 4, n).tolist())]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (1, 8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(str, chat.formatted(df).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


# -- near copies -----------------------------------------------------------------------------------------------------

def test_copies_show_their_bands_once(spark, docs_of, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    docs = docs_of(*[text] * 50, text + " end", "another text of five words").coalesce(1)
    rows = neardup.sketches(docs).collect()
    assert sum(len(r.bands) > 0 for r in rows) == 3
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(docs).collect()}
    assert got == {**{i: (0, 51) for i in range(51)}, 51: (51, 1)}


# -- pipeline --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("empty", [False, True])
def test_whole_pipeline(spark, odd_docs, monkeypatch, tmp_path, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([("a", "quick brown fox jumps over the lazy dog while seven")], "item_id string, text string")
    tables = {"documents": odd_docs.limit(0) if empty else odd_docs, "labels": labels, "benchmark": benchmark}
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: tables[name])
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    got = corpus_pipeline.run(spark, "").collect()
    # only the results of the five stages are left
    assert sorted(p.name.split("-")[1] for p in tmp_path.iterdir()) == sorted(n for n, _ in corpus_pipeline.STAGES)
    kept = spark.read.parquet(str(next(tmp_path.glob("llm-personal_data-*"))))
    assert len(got) == kept.count() and (empty or 0 < len(got) <= odd_docs.count())
    assert kept.columns == odd_docs.columns and kept.where("text like '%quick brown fox jumps over the lazy dog while seven%'").count() == 0


def test_tokens_of_a_batch_equal_those_of_its_texts():
    texts = [None, "", " \t\n\x0b\x0c\r", "A b\x0bÀÉ  ẞ\x1cx\x85y z ", "é", "\x00 a\n", " word" * 3000, "a"]
    for part in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts)), pa.array([], pa.string()), pa.array([None], pa.string())):
        words, sizes = language_model.words_of_all(part)
        want = [language_model.words_of(t) for t in part.to_pylist()]
        assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]
        assert language_model.tail_classes(words).tolist() == [language_model.tail_class(x) for w in want for x in w]
        numbers, symbols = language_model.symbols_of(words, sizes, pa.array([b"", b"a", b"word"], pa.binary()))
        index = {b"a": 1, b"word": 2}
        assert numbers.tolist() == [index.get(x, -1) for w in want for x in w] + [] if not len(sizes) else \
            [d.tolist() for d in language_model.documents(numbers, sizes)] == [[*(index.get(x, -1) for x in w), 0] for w in want]
        plain = language_model.Symbols({b"": 0, **index})
        assert [d.tolist() for d in language_model.documents(symbols, sizes)] == [plain.of(w).tolist() for w in want]
        got = language_model.word_counts(words, sizes).to_pylist()
        assert [{x["word"]: x["n"] for x in row} for row in got] == [{x: w.count(x) for x in w} for w in want]


def test_counts_are_the_same_for_any_number_of_held_tokens(docs_of, monkeypatch):
    docs = docs_of(None, "", "A a b", *["rare%d  the" % i for i in range(50)], "the")
    counts = [{bytes(r.word): r.c for r in language_model.token_counts(docs).collect()}]
    monkeypatch.setattr(language_model, "COUNTED_TOKENS", 3)
    counts.append({bytes(r.word): r.c for r in language_model.token_counts(docs.coalesce(1)).collect()})
    assert counts[0] == counts[1] and counts[0][b"the"] == 51 and counts[0][b"a"] == 2 and counts[0][b""] == 54
