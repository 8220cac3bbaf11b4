"""Operators against brute-force versions of the same definitions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import bpe, chat, common, decontaminate, fingerprint, language, language_model, neardup, pii, quality, queries

TABLES = ("documents", "benchmark", "pages", "labels", "conversations", "embeddings")


def values(df):
    return sorted(map(str, (tuple(None if v != v else v for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert values(queries.queries()[name](spark, sf_dir).toPandas()) == values(con.sql(queries.oracle_sql()[name]).df())


# -- quality ---------------------------------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark, sf_dir):
    got = queries.op1_quality(spark, sf_dir.replace("0.001", "0.01")).toPandas()
    labels = common.table(spark, sf_dir.replace("0.001", "0.01"), "labels").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id)
    assert set(got.predicted) <= {0, 1} and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, len(quality.STATS)))
    y = (x[:, 3] > 0.6).astype(int)
    rules, b = quality.fit_rules(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in quality.COLUMNS))
    got = np.array([r.s for r in df.select(quality.compiled(rules, b).alias("s")).collect()])
    want = 1 / (1 + np.exp(-(b + sum(w * quality.holds(r, x) for r, w in rules))))
    assert np.allclose(np.sort(got), np.sort(want)) and ((want > 0.5) == (y == 1)).mean() > 0.95


def test_many_rules_make_little_code(spark):
    """What Spark generates for a score does not grow with the number of rules: the driver compiles it."""
    def code(n):
        rules = [(((i % 20, True, i / n), ((i + 1) % 20, False, 0.5), ((i + 2) % 20, i % 2 == 0, 0.25)), 0.1) for i in range(n)]
        df = spark.range(1).select(*(F.rand(1).alias(c) for c in quality.COLUMNS))
        plan = df.where(quality.compiled(rules, 0.5) >= 0.5)._jdf.queryExecution()
        return len(spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan.executedPlan()))

    assert code(300) < code(20) + 20_000


# -- personal data ---------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            good = {"email": lambda: True, "ip": lambda m=m: all(int(p) < 256 for p in m[0].split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": lambda: 10 <= len(digits) <= 15}[kind]
            if good():
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_against_plain_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1234567890@@..--+%_ () é4111") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("4" * 50_000 + "a" * 50_000 + "300." * 20_000) == []


def test_contexts_discover_identifiers(spark, docs_of):
    known = [f"some words then member mail: user{i}@site{i}.org was here {'and so on ' * (i % 3)}" for i in range(12)]
    hidden = [f"other text where member mail: user{i}[at]site.org was here" for i in range(2)]
    clean = [f"the order number 12345{i}6 was sent and the part 99887{i} too" for i in range(12)]
    got = {r.doc_id: r.added for r in pii.personal_data(docs_of(*known, *hidden, *clean), "doc_id").collect()}
    assert [len(got[12 + i]) for i in range(2)] == [1, 1] and got[12][0].kind == "email"
    start = hidden[0].index("user0")
    assert (got[12][0].start, got[12][0].end) == (start, start + len("user0[at]site.org"))
    assert not any(got[i] for i in [*range(12), *range(14, 26)])
    clean_text = pii.redacted(docs_of(*known, *hidden, *clean)).where("doc_id = 12").first()
    assert "[EMAIL]" in clean_text.text and "user0" not in clean_text.text and clean_text.n_chars == len(clean_text.text)


def test_rare_contexts_are_weighed_among_many(spark, docs_of):
    many = ["\n".join(f"w{i} u{j}@s{i}.org z{i}" for i in range(k, k + 100) for j in range(5)) for k in range(0, 7000, 100)]
    known = [f"member mail: user{i}@site{i}.org was here" for i in range(3)]
    hidden = (999, "member mail: user0[at]site.org was here")
    got = {r.doc_id: r.added for r in pii.personal_data(docs_of(*many, *known, hidden), "doc_id").collect()}
    assert [(s.kind, s.start, s.end) for s in got[999]] == [("email", 13, 30)]


def test_promoted_identifiers_open_further_contexts(spark, docs_of):
    """Generations of identifiers, each in a context that only those of the one before open."""
    texts = [f"member mail user{i}@site{i}.org was here" for i in range(12)]
    words = ("member mail", "reach by", "sign as", "known under", "see profile", "write to")
    for g in range(5):
        texts += [f"{words[g + k]} g{g}user{i}[at]site was here" for k, n in ((0, 1), (1, 3)) for i in range(4) for _ in range(n)]
    texts += [f"write to last{i}[at]site was here" for i in range(2)]
    got = [r.added for r in pii.personal_data(docs_of(*texts), "doc_id").orderBy("doc_id").collect()]
    assert not any(got[:12]) and [[s.kind for s in x] for x in got[12:]] == [["email"]] * (len(texts) - 12)


def test_places_count_every_context():
    texts = ["see (a1@b.org), <c@d.org> or mailto:e@f.org.", "paid 4111 1111 1111 1111, by +49 30 1234567; then", 'id "ab-12345" (x_12345_) .', "a@b.org"]
    rng = random.Random(7)
    texts += [" ".join(rng.choice(("mail:", "(u1@s.org)", "+49 30 1234567,", "4111 1111 1111 1111.", "word,", "(see", "İx", '"12-34567"', "\u00e9me@s.org", "_", "!?"))
                       for _ in range(30)) for _ in range(200)]
    totals = Counter()
    for p, n in pii.places(texts):
        totals[p] += n
    seen = Counter(p for t in texts for *_, p in pii.contexts(t))
    assert all(n <= totals[p] for p, n in seen.items()) and {"( _", "( _ )", "mailto: _", "paid _ ,", "< _ >", "by _ ;"} <= set(seen)


def test_bracketed_identifiers_are_discovered(spark, docs_of):
    known = [f"member number {'abcdefghijkl'[i]} (user{i}@site{i}.org) was here (see below)" for i in range(12)]
    hidden = [f"another member {'xy'[i]} (user{i}[at]site.org) was here" for i in range(2)]
    got = [r.added for r in pii.personal_data(docs_of(*known, *hidden), "doc_id").orderBy("doc_id").collect()]
    assert not any(got[:12]) and [[(s.kind, s.start, s.end) for s in x] for x in got[12:]] == [[("email", 18, 35)]] * 2


# -- near duplicates -------------------------------------------------------------------------------------------------

def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.integers(1, 4, 400).astype(float), rng.random(400) * 3
    sets = [neardup.units(elements, w) for w in (a, b)]
    sign = neardup.throw_darts(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), np.array([len(s[0]) for s in sets]), k=4096)
    assert abs((sign[0] == sign[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_near_copies_and_chains(spark, docs_of):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(300)]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            text[rng.randrange(len(text))] = rng.choice(words)
        return text

    chain = [base]
    for _ in range(12):
        chain.append(edited(chain[-1], 5))
    group = [edited(base, rng.randint(1, 25)) for _ in range(150)]
    other = [[rng.choice(words) for _ in range(200)] for _ in range(60)]
    shared = [rng.choice(words) for _ in range(60)]
    passages = [shared + [rng.choice(words) for _ in range(140)] for _ in range(60)]
    texts = [" ".join(t) for t in [*chain, *group, *other, *passages, base, base]]
    sets = [Counter(tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i: find(i) for i in range(len(texts))}
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(*texts)).collect()}
    assert got == want
    kept = neardup.without_near_duplicates(docs_of(*texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


# -- decontamination -------------------------------------------------------------------------------------------------

def test_fm_index_against_scanning(monkeypatch):
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 5, 3000)
    symbols[1000:1400] = symbols[100:500]
    index = decontaminate.FmIndex(symbols, 4)
    windows = np.zeros((200, 6), dtype=np.int64)
    lengths = rng.integers(1, 7, 200)
    for w, n in zip(windows, lengths, strict=True):
        w[6 - n:] = rng.integers(1, 5, n)
    lo, hi = index.search(windows, lengths)
    for w, n, a, b in zip(windows, lengths, lo, hi, strict=True):
        want = [i for i in range(len(symbols) - n + 1) if (symbols[i:i + n] == w[6 - n:]).all()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_spans_are_cut(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_SYMBOLS", 50)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([("1", item), ("2", "short item")], "item_id string, text string")
    docs = docs_of(f"Before É, {item.upper()}! After.", "a Short  ITEM.", "alpha beta gamma", None)
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, "doc_id").collect()}
    assert [(got[i].n_words, got[i].n_hit, got[i].items) for i in range(4)] == [(15, 12, ["1"]), (3, 2, ["2"]), (3, 0, []), (0, 0, [])]
    out = {r.doc_id: r for r in decontaminate.without_benchmark(docs, bench).collect()}
    assert [out[i].text for i in range(4)] == ["Before É, ! After.", "a .", "alpha beta gamma", None]
    assert out[0].n_chars == len("Before É, ! After.")


# -- chat ------------------------------------------------------------------------------------------------------------

def least_cost(kinds):
    todo, seen = [(0, 0, chat.START)], set()
    while todo:
        cost, i, s = heapq.heappop(todo)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(kinds) and s in chat.LAST:
            return cost
        change = chat.RELABEL_UNKNOWN if i < len(kinds) and kinds[i] == 3 else chat.RELABEL
        for r in chat.NEXT[s]:
            heapq.heappush(todo, (cost + chat.INSERT, i, r))
            if i < len(kinds):
                heapq.heappush(todo, (cost + (0 if r == kinds[i] else change), i + 1, r))
        if i < len(kinds) and s != chat.START:
            heapq.heappush(todo, (cost + chat.MERGE + (0 if s == kinds[i] else change), i + 1, s))


def cost_of(steps, kinds):
    """Cost of (action, role) steps; insertions take no turn."""
    total, turns = 0, iter(kinds)
    for action, role in steps:
        kind = None if action == "insert" else next(turns)
        change = chat.RELABEL_UNKNOWN if kind == 3 else chat.RELABEL
        total += {"insert": chat.INSERT, "keep": 0, "relabel": change, "merge": chat.MERGE + (0 if role == kind else change)}[action]
    return total


def test_repairs_are_cheapest():
    rng = random.Random(2)
    for _ in range(1000):
        kinds = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        steps, end = chat.repair(kinds)
        assert cost_of([s for own in steps for s in own] + end, kinds) == least_cost(kinds)


def test_conversation_over_many_partitions(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "gpt", "x"]), f"t{t}") for c in range(30) for t in range(2000 if c == 7 else rng.randint(1, 8))]
    got = defaultdict(list)
    for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).orderBy("conv_id", "piece").collect():
        got[r.conv_id].append(r)
    for c in range(30):
        turns = [r[1:] for r in rows if r[0] == c]
        kinds = [chat.kind_of(r) for _, r, _ in turns]
        assert [r.piece for r in got[c]] == list(range(len(got[c])))
        assert [r.turn for r in got[c] if r.action != "insert"] == [t for t, _, _ in turns]
        assert cost_of([(r.action, chat.ROLES.index(r.role)) for r in got[c]], kinds) == least_cost(kinds)
        text = "".join(r.rendered for r in got[c])
        roles = re.findall(r"<\|(user|assistant|system)\|>", text)
        assert text.count("<|end|>") == len(roles) and roles[-1] == "assistant"
        assert all(chat.ROLES.index(b) in chat.NEXT[chat.ROLES.index(a)] for a, b in zip(roles, roles[1:]))


# -- fingerprints ----------------------------------------------------------------------------------------------------

def test_edited_texts_and_likeness(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op5_fingerprint(spark, sf_dir).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    errors = []
    for (i, text), (_, after) in zip(docs, [*docs[1:], docs[0]], strict=True):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        a, b = ({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in (text.lower().split(), edited.lower().split()))
        errors.append(got[i].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_next_rows_with_ties_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 10)
    ids = [None] * 300 + [5] * 900 + list(range(1200)) + [7, 7]
    rows = spark.createDataFrame([(i, (k * 2654435761) % 2**63 - 2**62) for k, i in enumerate(ids)], "doc_id bigint, tie bigint")
    got = fingerprint.with_next(rows, ["doc_id", "tie"]).collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.tie), r) for r in got)
    assert len(got) == len(ids)
    for (_, r), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        assert (r.next_doc_id, r.next_tie) == (after.doc_id, after.tie)


# -- language model --------------------------------------------------------------------------------------------------

def test_gradients():
    rng = np.random.default_rng(0)
    vocab = language_model.Vocabulary([b"", *(b"w%d" % i for i in range(1500))], np.arange(1501, 0, -1), 10**6, 3000, np.full(32, 50.0))
    w = {k: a.astype(float) + rng.normal(0, 0.1, a.shape) for k, a in language_model.first_weights(vocab).items()}
    x, y = rng.integers(0, 1056, (7, 3)), rng.integers(0, 1056, (7, 3))
    new, live = np.zeros((7, 3), bool), np.ones((7, 3), bool)
    new[0], new[3, 1], live[6, 2] = True, True, False
    h = np.zeros((3, language_model.HIDDEN))
    g = language_model.gradients(w, x, y, new, live, h)[0]
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        losses = []
        for step in (1e-3, -2e-3):
            w[k][at] += step
            losses.append(language_model.gradients(w, x, y, new, live, h)[2])
        w[k][at] += 1e-3
        assert abs((losses[0] - losses[1]) / 2e-3 - g[k][at]) < 1e-4


def test_state_is_carried_and_probabilities_sum(monkeypatch):
    vocab = language_model.Vocabulary([b"", *(b"w%d" % i for i in range(1500))], np.arange(1501, 0, -1), 10**6, 3000, np.full(32, 50.0))
    rng = np.random.default_rng(1)
    w = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in language_model.first_weights(vocab).items()}
    docs = [rng.integers(0, 1056, n) for n in (1, 500, 3, 64, 200)]
    whole = language_model.document_logs(w, docs)
    monkeypatch.setattr(language_model, "STEPS", 7)
    monkeypatch.setattr(language_model, "LANES", 2)
    assert np.allclose(whole, language_model.document_logs(w, docs), rtol=1e-4)
    h = rng.normal(0, 1, (1, language_model.HIDDEN)).astype(np.float32)
    every = np.arange(language_model.SYMBOLS + language_model.TAIL_CLASSES)
    assert abs(np.exp(language_model.log_probabilities(w, np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-3


def test_base_scores_and_held_out_gain(spark, sf_dir):
    got = language_model.document_scores(common.table(spark, sf_dir, "documents")).collect()
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in common.table(spark, sf_dir, "documents").collect()}
    counts = Counter()
    for i, words in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    for r in got:
        words = texts[r.doc_id]
        want = sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[x] > 0 for x in words), n)
        assert abs(r.base_score - want) < 1e-6 * abs(want)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_document_trains_at_any_size(spark):
    words = [b"", *(b"w%d" % i for i in range(1, 301))]
    docs = spark.createDataFrame([(i, f"w{i} " * 4) for i in range(1, 301)], "doc_id bigint, text string")
    for n in (1_500, 10**10):
        vocab = language_model.Vocabulary(words, np.full(301, 4), n, 301, np.full(32, 50.0))
        changed = (language_model.trained(docs, vocab)["input"] != language_model.first_weights(vocab)["input"]).any(axis=1)
        assert changed[:301].all()


def test_rare_words_are_joined(spark, sf_dir, monkeypatch):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").limit(60)
    whole = {r.doc_id: r for r in language_model.document_scores(docs).collect()}
    monkeypatch.setattr(language_model, "HEAD_TOKENS", 1500)
    for r in language_model.document_scores(docs).collect():
        assert (r.n_known, r.n_tokens) == (whole[r.doc_id].n_known, whole[r.doc_id].n_tokens)
        assert abs(r.base_score - whole[r.doc_id].base_score) < 1e-6 * abs(r.base_score)


# -- languages -------------------------------------------------------------------------------------------------------

def test_languages_on_held_out_rows(spark, sf_dir):
    got = language.languages(common.table(spark, sf_dir.replace("0.001", "0.01"), "documents")).toPandas()
    docs = common.table(spark, sf_dir.replace("0.001", "0.01"), "documents").select("doc_id", "text", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    held = both[both.held_out & both.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.97
    letters = both.text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert ((both.lang_pred == "und") == ~letters).all() and both.score.between(0, 1).all()


# -- BPE -------------------------------------------------------------------------------------------------------------

def test_bpe_against_the_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.WordBpe(**bpe.load(path))
    rng = random.Random(3)
    letters = "aabcdeest'é ßñ.,0159-–Σİ́\n\t😀中z"
    texts = ["", "It's I'LL we'd 123 ½ x<|endoftext|>y <|startoftext|>", "ΑΣ ΟΔΟΣ", "ǅ ﬁ é Å", "a\x1cb\x1d c\x85d​e f　g", "\x00\x01 ﻿", "a" * 3000, "!?" * 700]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) for _ in range(500)]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_quality_sample_is_the_same_with_and_without_the_bound(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir.replace("0.001", "0.01"), t) for t in ("documents", "labels"))
    few = quality.quality_scores(docs, labels, sample_rows=100)
    # labels of documents that do not exist lower the bound, so that the second way is taken
    more = spark.range(10 ** 9, 10 ** 9 + 5000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    again = quality.quality_scores(docs, labels.unionByName(more.selectExpr("doc_id", "cast(quality AS int) AS quality", "cast(toxic AS int) AS toxic")), sample_rows=100)
    assert sorted((r.doc_id, r.score) for r in few.collect()) == sorted((r.doc_id, r.score) for r in again.collect())
