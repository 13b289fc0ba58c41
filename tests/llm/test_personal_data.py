import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm.crf import loopy_marginals
from panelwright.llm.personal_data import base_spans, edges_of, fit, joined, luhn, nodes_of, personal_data


def plain_base(text):
    """The patterns as they are written."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0123459()é\n_%", max_size=60))
def test_patterns_equal_the_plain_ones(text):
    assert base_spans(text) == plain_base(text)


def test_luhn_and_long_runs():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + " " * 100_000, "a.b@" * 50_000, "1 " * 100_000):
        base_spans(text)
        nodes_of(text)


def test_messages_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(0)
    scores, tables = rng.normal(size=(4, 3)), rng.normal(size=(2, 3, 3))
    edges, types = np.array([[0, 1], [1, 2], [1, 3]]), np.array([0, 1, 0])
    joint = np.zeros((3,) * 4)
    for at in np.ndindex(*joint.shape):
        joint[at] = sum(scores[i, at[i]] for i in range(4)) + sum(tables[t][at[a], at[b]] for (a, b), t in zip(edges, types))
    joint = np.exp(joint) / np.exp(joint).sum()
    got = loopy_marginals(scores, edges, types, tables, tolerance=1e-10, rounds=500)
    for i in range(4):
        assert np.allclose(got[i], joint.sum(axis=tuple(k for k in range(4) if k != i)), atol=1e-6)


def test_skip_edges_link_repeats_in_a_row():
    nodes = nodes_of(" x ".join(["12345"] * 500))
    edges, types = edges_of(nodes)
    assert len(edges) == 499 and set(types) == {1}


def corpus():
    rng = random.Random(2)
    words = "the of and call me or write to see on at it was number here".split()
    docs = []
    for i in range(500):
        w = rng.choices(words, k=40)
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        for item in (phone, f"u{i}@ex{i % 9}.org", f"10.{i % 255}.3.4", str(rng.randrange(100, 99999))):
            if rng.random() < 0.6:
                for _ in range(rng.choice([1, 2])):
                    w.insert(rng.randrange(len(w)), item)
        docs.append((i, " ".join(w)))
    return docs


def test_field_keeps_base_and_carries_labels_to_other_mentions(spark):
    docs = corpus() + [
        (900, "call +1 (743) 555-3824 now. it was here. later 743 555-3824 or (743) 555-3824 again"),
        (901, "the number 12345 and 20 of 300 here"),
        (902, "card 4111 1111 1111 1111 and 4111 1111 1111 1112"),
        (903, None), (904, ""), (None, "x@y.zz"), (900, "x@y.zz"), (905, "word " * 100_000 + "a@b.cc"),
    ]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, spans string").repartition(4)
    rows = personal_data(df, fit(spark.createDataFrame(corpus(), "doc_id long, text string"))).collect()
    assert len(rows) == len(docs)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t or "")
    for r in rows:
        bases = [plain_base(t) for t in texts[r.doc_id]]
        base = next(b for b in bases if joined(b) == r.base_spans)
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in base) for i in range(4))
    by_id = {r.doc_id: r for r in rows}
    first = next(r for r in rows if r.doc_id == 900 and r.n_phone)
    text = docs[500][1]
    added = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in first.spans.split(","))}
    assert len(added) >= 2 and any("555-3824" in x and not x.startswith("+") for x in added)
    assert by_id[901].spans == "" and by_id[903].spans == "" and by_id[902].spans == by_id[902].base_spans


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data(df, fit(df)).collect() == []
