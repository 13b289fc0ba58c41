import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import lm_scoring
from panelwright.llm.lm_scoring import CLASS_ROWS, CLASSES, SYMBOLS, WORD_ROWS, Model, count_tokens, frequent_words, lm_scores


def plain_tokens(text):
    words, word = [], ""
    for c in "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "") + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    return [*words, None]


def learns(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 != 0


def plain_base(docs):
    counts = Counter(t for d, x in docs if learns(d) for t in plain_tokens(x))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, x in docs:
        t = plain_tokens(x)
        out.append((d, not learns(d), len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)))
    return out


def corpus():
    rng = random.Random(4)
    one, two = [f"a{i}" for i in range(150)], [f"b{i}" for i in range(150)]
    docs = []
    for i in range(900):
        words = rng.choice([one, two])
        text = [rng.choice(words)]
        for _ in range(40):
            text.append(words[(words.index(text[-1]) * 3 + 1) % 150] if rng.random() < 0.5 else rng.choice(words))
        text.append(f"rare{rng.randrange(10**6)}")
        docs.append((i, " ".join(text)))
    return docs


ODD = [(5000, None), (5001, ""), (5002, " \n"), (None, "a1 a2"), (5003, "ÀÉ A1\ta1\x0bb2"), (5003, "a1"), (5004, "a1 b2 " * 40_000), (5005, "unseen words only")]


@pytest.mark.parametrize("head", [100_000, 60])
def test_base_equals_brute_force_whatever_is_broadcast(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    docs = corpus() + ODD
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, score string").repartition(6)
    rows = lm_scores(df, slices=2).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows), key=repr)
    assert got == sorted((x[:5] for x in plain_base(docs)), key=repr)
    want = {(x[0], x[2]): x[5] for x in plain_base(docs)}
    assert all(math.isclose(r.base_score, want[r.doc_id, r.n_tokens], rel_tol=1e-9) for r in rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    if head == 100_000:
        held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
        n = sum(r.n_tokens for r in held)
        assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.1


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame(corpus()[:200], "doc_id long, text string")
    words = frequent_words(count_tokens(df.select("text")))
    rng = np.random.default_rng(0)
    model = Model(words, rng.normal(0, 0.5, (CLASS_ROWS, CLASSES)).astype(np.float32), rng.normal(0, 0.5, (WORD_ROWS, 64)).astype(np.float32))
    total = 0.0
    start = [lm_scoring.START] * 3
    for first in range(0, SYMBOLS, 1024):
        padded = np.array([x for s in range(first, first + 1024) for x in [*start[:1], 5, 17, s]])
        total += (10 ** model.log10_symbols(padded, np.arange(1024) * 4 + 3)).sum()
    assert abs(total - 1) < 1e-3


def test_zero_weights_are_the_unigram_model_and_updates_help(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words = frequent_words(count_tokens(df.select("text")))
    model = Model(words, np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, 64), np.float32))
    texts = [lm_scoring.tokens_of(t) for _, t in docs[:300]]
    padded, places, known, _ = model.encode(texts)
    before = model.log10_symbols(padded, places)
    counts = Counter(w for _, t in docs for w in lm_scoring.tokens_of(t))
    w = texts[0][0]
    assert abs(before[0] - math.log10(counts[w] / sum(counts.values()))) < 0.02
    tables = [model.class_table.copy(), model.word_table.copy()]
    for k, rows, change, _ in model.trained_on(texts):
        tables[k][rows] += change
    assert Model(words, *tables).log10_symbols(padded, places).mean() > before.mean() + 0.05


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scores(empty).collect() == []
    held = next(i for i in range(100) if not learns(i))
    row = lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and math.isclose(row.base_score, 0.0, abs_tol=1e-9)


def test_training_reads_every_document(spark):
    """Each document has words of its own, so its contexts have weights only if the rounds have read it."""
    docs = [(i, " ".join(f"d{i}w{j}" for j in range(5))) for i in range(200)]
    df = spark.createDataFrame(docs, "slice long, text string").repartition(4)
    words = frequent_words(count_tokens(df.select("text")))
    model = lm_scoring.train(df, words)
    unread = []
    for i, text in docs:
        padded, places, _, _ = model.encode([lm_scoring.tokens_of(text)])
        by_class, classed, _ = lm_scoring._rows(padded, places[1:4])
        if not (model.class_table[by_class[3]].any(axis=1).all() and model.word_table[classed[1]].any(axis=1).all()):
            unread.append(i)
    assert unread == []


def test_tokens_of_arrow_texts():
    texts = [None, "", " \n", "ÀÉ A1\ta1\x0bb2 ", "x\x1cy\x85z\u00a0w\u2003V", " a  B\r\n\x0cc", "é", "😀 I"]
    tokens, sizes = lm_scoring.tokens_in(pa.array(["skipped", *texts])[1:])
    assert sizes.tolist() == [len(lm_scoring.tokens_of(t)) for t in texts]
    assert tokens.to_pylist() == [w for t in texts for w in lm_scoring.tokens_of(t)]
    assert lm_scoring.shared_symbols(tokens[3:]).tolist() == [lm_scoring.shared_symbol(w) for w in tokens[3:].to_pylist()]


@pytest.mark.parametrize("most", [1, 8, 9, 3000])
def test_run_sums_equal_brute_force(most):
    rng = np.random.default_rng(most)
    keys = np.concatenate([np.repeat(np.arange(40), rng.integers(1, most + 1, 40)), np.full(most, 7)]).astype(np.uint16)
    rng.shuffle(keys)
    values = rng.normal(size=(len(keys), 5))
    order, changed, n = lm_scoring._runs(keys)
    sums, run = lm_scoring._run_sums(values, order, n)
    assert sorted(changed[run].tolist()) == sorted(set(keys.tolist())) and n[run].tolist() == [(keys == k).sum() for k in changed[run]]
    assert np.allclose(sums, [values[keys == k].sum(axis=0) for k in changed[run]])


def test_weights_beyond_the_range_of_exp(spark):
    words = frequent_words(count_tokens(spark.createDataFrame(corpus()[:50], "doc_id long, text string").select("text")))
    for size in (300.0, -300.0):
        model = Model(words, np.full((CLASS_ROWS, CLASSES), size, np.float32), np.full((WORD_ROWS, 64), size, np.float32))
        zero = Model(words, np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, 64), np.float32))
        padded, places, _, _ = zero.encode([lm_scoring.tokens_of("a1 b2 a3")])
        assert np.allclose(model.log10_symbols(padded, places), zero.log10_symbols(padded, places), atol=1e-3)


def test_symbols_are_those_of_the_tokens(spark):
    """What the rounds and the scores read: each text's symbols, two bytes a token, and its tokens without a broadcast count."""
    docs = corpus()[:100] + ODD[:5]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    words = frequent_words(count_tokens(df.limit(60).select("text")))
    rows = lm_scoring.encoded(df.selectExpr("doc_id", "false held_out", "doc_id slice", "text"), words).collect()
    assert len({r.ref for r in rows}) == len(rows) == len(docs)
    by_id = dict(docs)
    model = Model(words, np.zeros(0), np.zeros(0))
    for r in rows:
        tokens = lm_scoring.tokens_of(by_id[r.doc_id])
        padded, places, known, _ = model.encode([tokens])
        assert np.frombuffer(r.symbols, "<u2").tolist() == padded[places].tolist() and r.n_tokens == len(tokens) and r.n_known == (known >= 0).sum()
        assert [bytes(w) for w in r.rare] == [w for w in tokens if w not in words.index]
