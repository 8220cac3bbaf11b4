import pytest

# names that operators use inside
CLASHES = ("score", "label", "key", "n", "node", "spans", "items", "n_hit", "ids", "base", "added", "part", "bucket", "kind", "start")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts (or (doc_id, text) pairs), with further columns whose names clash."""
    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(CLASHES)) for i, t in rows], schema)

    return make


PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near a quiet river bank "
ODD = (None, "", "   \n\t", ".", "word", "one two three four", PROSE, PROSE, PROSE * 400, "é" * 5000, "x" * 20000, "\x00\x1c  \U0001f600", "0" * 5000)


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty, blank, short, long and repeated texts, a null id and two rows that are all the same."""
    rows = [(i, t) for i, t in enumerate(ODD)]
    return docs_of(*rows, (None, "null id " + PROSE), (3, "."), (3, "."))
