"""Filter audit, one-bit vector search and Merkle manifest against plain versions, and their odd inputs."""

import hashlib
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import filter_audit, manifest, vector_search

# -- filter audit ----------------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """(part, order, step) -> counts; a row is (doc_id, text, lang)."""
    texts = [(i, t or "") for i, t, _ in rows]
    facts = []
    for i, t, lang in rows:
        t = t or ""
        words = t.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and u == t for j, u in texts)}
        facts.append((lang or "", fails, labels.get(i, (0, 0))))
    out = {}
    for part in {p for p, _, _ in facts}:
        mine = [(f, lab) for p, f, lab in facts if p == part]
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for s, name in enumerate(order):
                here = [x for x in left if x[0][name]]
                gone = [x for x in mine if not any(x is y for y in left)]
                left = [x for x in left if not x[0][name]]
                removed_by[name] += len(here)
                out[part, order, s + 1] = [len(left), len(here), sum(x[0][name] for x in gone), sum(x[0][name] and sum(x[0].values()) == 1 for x in mine),
                                           sum(x[1][0] == 1 for x in here), sum(x[1][1] == 1 for x in here)]
        for (p, order, s), v in out.items():
            if p == part:
                v.append(removed_by[order[s - 1]])
    return out


def test_audit_equals_plain(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long, "A B C", "", None, "a # b", long + " #", "x " * 300, "X " * 300, " \t\x0b\x1c", long + " TITLE" * 20, " ", "a b"]
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts * 2)] + [(None, long, "en"), (3, "again", "en"), (3, "again", "en")]
    labels = {0: (1, 0), 2: (1, 1), 5: (0, 1), 20: (1, 0)}
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, lang string, part string, mask string")
    marks = spark.createDataFrame([(k, *v, "z") for k, v in labels.items()] + [(0, 0, 0, "z"), (None, 1, 1, "z"), (5, None, None, "z")],
                                  "doc_id bigint, quality int, toxic int, good string")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in (*filter_audit.OUTCOMES, "shapley")] for r in filter_audit.filter_audit(docs, marks).collect()}
    assert got == plain_audit(rows, labels)


def test_audit_of_nothing_and_without_labels(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).collect() == []
    one = filter_audit.filter_audit(spark.createDataFrame([(1, "a", "en")], docs.schema), labels).collect()
    assert len(one) == 600 and {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1} and not any(r.good_lost for r in one)


def test_packed_fields_do_not_run_over():
    n = 2 ** 63 - 1
    counts = filter_audit.unpacked(filter_audit.packed(31, 1, 1) * n)
    assert (counts[:, 0, 1] == n).all() and (counts[:, 1:, 1] == 0).all() and (counts[:, 1:, 2] == n).all()
    with pytest.raises(OverflowError):
        filter_audit.unpacked(sum(filter_audit.packed(0, 0, 0) for _ in range(1)) << (600 * 6 * 64))


def test_audit_sums_on_the_map_side(spark):
    docs = spark.range(0, 5000, 1, 8).selectExpr("id AS doc_id", "'same' AS text", "'en' AS lang")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [(r.removed, r.kept) for r in got[:2]] == [(4999, 1), (1, 0)]


# -- vector search ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, score string"


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):  # from first to last; the built-in sum compensates
        gap = float(np.float32(x)) - float(np.float32(y))
        total += gap * gap
    return float(np.sqrt(total))


def plain_nearest(rows, k, every):
    best = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    out = {}
    for q, v in best.items():
        if q % every == 0:
            near = sorted((distance(v, w), i) for i, w in best.items() if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_against_brute_force(spark, clustered):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)) + (8 * rng.standard_normal((12, 24))[rng.integers(0, 12, 3000)] if clustered else 0)
    rows = [(i, [float(np.float32(c)) for c in v], 0, "") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS).repartition(6)
    got = found(vector_search.nearest_neighbours(df, F.col("vec_id") % 50 == 0))
    want = plain_nearest(rows, 10, 50)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.999 * sum(map(len, want.values()))


def test_blocks_of_queries_and_copies(spark):
    rng = np.random.default_rng(4)
    hot = [float(c) for c in rng.standard_normal(8).astype("f4")]
    rows = [(i, hot if i % 3 else [float(c) for c in rng.standard_normal(8).astype("f4")], 0, "") for i in range(900)]
    df = spark.createDataFrame(rows, VECTORS)
    got = found(vector_search.nearest_neighbours(df, F.col("vec_id") % 10 == 0, block_bytes=1000))
    assert got == plain_nearest(rows, 10, 10)
    assert [i for _, i in got[10]] == [1, 2, 4, 5, 7, 8, 11, 13, 14, 16]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [-1.0, 1e-30]),
            (9, [3e38, 1.0]), (100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 4.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (7, [2.0, 0.0]), (200, [5.0]), (10, [-0.0, 1.0])]
    rows = [(i, v, 0, "x") for i, v in rows]
    got = found(vector_search.nearest_neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0))
    want = {q: v for q, v in plain_nearest(rows, 10, 100).items() if v}
    assert got.keys() == want.keys() == {0, 100}
    assert got == want and [i for _, i in got[0]] == [7, 10, 8, 9]
    empty = vector_search.nearest_neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    centre, turn = x.mean(axis=0), vector_search.rotation(64, 2)
    assert np.allclose(turn.T @ turn, np.eye(64))
    rest = x - centre
    length = np.linalg.norm(rest, axis=1)
    turned = rest @ turn.T / length[:, None]
    near = vector_search.Nearest(np.arange(20), q, centre, turn, 10, 4.0)
    lower, upper = near.bounds(slice(0, 20), np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(len(turn)))
    exact = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    assert ((lower <= exact) & (exact <= upper)).mean() > 0.999
    middle = (lower + upper) / 2
    assert abs((middle - exact).mean()) < 0.02 * exact.mean()  # without bias


# -- manifest --------------------------------------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def plain_levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        found.append(nodes)
    return found


def plain_path(found, i):
    out = []
    for nodes in found[:-1]:
        start = i - i % 3
        out.append(("".join(nodes[start:i]), "".join(nodes[i + 1:start + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault("" if r["source"] is None else "+" + r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    names = sorted(trees, key=str.encode)
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        built[name] = plain_levels([x[2] for x in trees[name]])
    top = plain_levels([built[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(trees[name]):
            path = plain_path(built[name], i) + plain_path(top, k)
            text = r["text"]
            if text is not None and zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = plain_leaf(r, text)
            for left, right in path:
                node = digest(left + node + right)
            root = top[-1][0]
            out.append((r["doc_id"], leaf, built[name][-1][0], root, digest("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string, block string, path string, n string, pos string"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], DOCS)


def manifest_rows(df, **more):
    return sorted((tuple(r) for r in manifest.verified(df, **more).select(*COLUMNS).collect()), key=repr)


def as_dicts(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]


def test_manifest_of_odd_rows(spark):
    rows = [(i, ("line\n" * (i % 5)) or None, None if i % 7 == 0 else "en", (None, "", "a", "é", "z\x00", "Z")[i % 6], None if i % 9 == 0 else i) for i in range(70)]
    rows += [(None, "no id\n", "en", "a", 1), (5, "again\n", "en", "Z", 1), (5, "again\n", "en", "Z", 1), (999, "alone\n", "en", "lone", 2), (1000, "\n" * 50_000 + "é" * 50_000, None, "a", 3)]
    assert manifest_rows(docs_of(spark, rows)) == plain_manifest(as_dicts(rows))


@pytest.mark.parametrize("sizes", [(1,), (3,), (4,), (28, 1, 1), (82, 3, 9, 2), (300, 55)])
def test_manifest_of_many_shapes(spark, sizes):
    rows = [(1000 * s + i, "a\nb", "en", f"s{s}", 3) for s, n in enumerate(sizes) for i in range(n)]
    # blocks of three, so that there are many rounds
    assert manifest_rows(docs_of(spark, rows), depth=1) == plain_manifest(as_dicts(rows))


def test_manifest_of_blocks_and_partitions(spark):
    rows = [(i * 7 % 10_007, "a\nb", "en", "hot" if i % 3 else f"s{i % 11}", i) for i in range(4000)]
    want = plain_manifest(as_dicts(rows))
    assert manifest_rows(docs_of(spark, rows).repartition(5)) == want
    assert manifest_rows(docs_of(spark, rows).coalesce(1)) == want


def test_manifest_of_nothing(spark):
    assert manifest.verified(docs_of(spark, [])).collect() == []
