"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import pytest

import corpus_pipeline
from pagelake.llm import bpe, chat, decontaminate, fingerprint, language, language_model, neardup, pii, quality, queries, revisits


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("a", "quick brown fox jumps over the lazy dog while seven wise owls"), (None, "word"), ("e", None), ("f", "")], "item_id string, text string")


def per_document(labels, benchmark):
    path = bpe.vocabulary_path()
    return {
        "quality": lambda d: quality.quality_scores(d, labels), "pii": lambda d: pii.personal_data(d, "doc_id"),
        "neardup": neardup.near_duplicates, "fingerprint": fingerprint.edited_fingerprints,
        "decontaminate": lambda d: decontaminate.contamination(d, benchmark, "doc_id"), "language_model": language_model.document_scores,
        "language": language.languages, "bpe": lambda d: bpe.encode_texts(d, path, "doc_id"),
    }


NAMES = ("quality", "pii", "neardup", "fingerprint", "decontaminate", "language_model", "language", "bpe")


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts_give_one_row_each(name, odd_docs, labels, benchmark):
    got = per_document(labels, benchmark)[name](odd_docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd_docs.collect())
    same = [tuple(r)[1:] for r in got if r.doc_id == 3]
    assert len(same) == 3 and (name == "fingerprint" or len(set(map(str, same))) == 1)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, odd_docs, labels, benchmark):
    assert per_document(labels, benchmark)[name](odd_docs.limit(0)).collect() == []


def test_empty_side_tables(odd_docs, labels, benchmark):
    assert {r.score for r in quality.quality_scores(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert decontaminate.contamination(odd_docs, benchmark.limit(0), "doc_id").where("n_hit > 0").count() == 0


@pytest.fixture
def stage_inputs(monkeypatch, labels, benchmark):
    tables = {"labels": labels, "benchmark": benchmark}
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: tables[name])


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_all_columns(spark, odd_docs, stage_inputs, number):
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, odd_docs, "")
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    assert out.count() <= odd_docs.count()
    assert stage(spark, odd_docs.limit(0), "").count() == 0


def test_last_stage(spark, odd_docs, stage_inputs):
    assert corpus_pipeline.STAGES[4][1](spark, odd_docs, "").count() == odd_docs.count()


def test_chat_odd_turns(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, part string, piece string"
    rows = [(1, 0, None, None), (1, None, "user", "a"), (1, 0, None, None), (None, 5, "robot", ""), (2, 1, "assistant", "x" * 100_000)]
    got = chat.formatted(spark.createDataFrame([(*r, "p", "q") for r in rows], schema)).collect()
    assert {r.conv_id for r in got} == {1, 2, None}
    assert sum(r.action != "insert" for r in got) == len(rows)
    assert chat.formatted(spark.createDataFrame([], schema)).collect() == []


def test_revisits_odd_records(spark):
    schema = "record_id string, url string, at bigint, kind string, etag string, modified bigint, digest string, headers map<string,string>, part int, match string"
    rows = [("r", None, 1, "response", None, None, "d", None), ("v", None, 2, "revisit", None, None, None, None),
            ("w", "http://a.org", None, "revisit", None, None, None, None), ("r2", "http://a.org/", 5, "response", None, None, "e", {"Date": "2"}),
            ("v2", "HTTP://A.org:80/#x", 6, "revisit", None, None, None, {"DATE": "3", "X": "4"}), ("v2", "HTTP://A.org:80/#x", 6, "revisit", None, None, None, None)]
    df = spark.createDataFrame([(*r, 7, "m") for r in rows], schema)
    got = sorted((r.record_id, r.status, r.response_id, str(r.headers)) for r in revisits.resolved(df).collect())
    assert got == [("v", "no_response", None, "None"), ("v2", "unchecked", "r2", "{'date': '2'}"), ("v2", "unchecked", "r2", "{'date': '3'}"), ("w", "no_response", None, "None")]
    assert revisits.resolved(df.limit(0)).collect() == []


def test_registry():
    names = list(queries.queries())
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and len(names) == 13
    assert set(queries.oracle_sql()) <= set(names)
