import random
import re
from itertools import permutations

import numpy as np

from panelwright.llm.filter_audit import filter_audit, positional_popcount, subset_survivors, survival_word, text_failures

SCHEMA = "doc_id long, text string, lang string"


def fails(text, smaller):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = ""
    out += "A" * (len(words) < 200)
    out += "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
    out += "D" * any(c in "#$%&*|" for c in text)
    return out + "E" * (text in smaller)


def plain(docs, labels):
    """Brute force: every document through every order."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        smaller = {(t or "") for j, t, _ in docs if i is not None and j is not None and j < i}
        rows.append((lang or "", fails(text, smaller), i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        taken = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                taken[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(taken[key[1][key[2] - 1]])
    return out


def corpus():
    rng = random.Random(5)
    docs = []
    for i in range(120):
        n = rng.choice([3, 150, 199, 200, 201, 260])
        words = [rng.choice(["word", "WORD", "é" * 3, f"w{rng.randint(0, 400)}"]) if rng.random() < 0.5 else f"u{j}" for j in range(n)]
        text = rng.choice([" ", "\n", "\t \r", "\x0b\x0c"]).join(words) + rng.choice(["", "", " #", " a|b", " x y", " ä & ö"])
        docs.append((i, text, rng.choice(["en", "de", None, ""])))
    long = " ".join(f"x{j}" for j in range(60_000))
    docs += [(i, docs[i % 7][1], rng.choice(["en", "fr"])) for i in range(200, 320)]  # groups of copies
    docs += [(-5, docs[3][1], "en"), (3, docs[3][1], "en"), (400, None, "en"), (401, "", None), (402, None, "xx"), (403, long, "en"), (404, long, "de")]
    docs += [(None, docs[0][1], "en"), (None, docs[0][1], "en"), (None, "only here", None), (500, "only here", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 330, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_equals_brute_force(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(*d, "k", 7) for d in docs], SCHEMA + ", part string, fails int").repartition(5)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, good string")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit(frame, marks).collect()}
    assert got == plain(docs, labels)
    assert len(got) == 600 * 5


def test_popcount_by_carry_save_equals_plain_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 100, 1001):
        words = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        weights = rng.integers(1, 10**10 if n % 2 else 3, n)
        want = [sum(int(w) for x, w in zip(words, weights) if int(x) >> b & 1) for b in range(32)]
        assert positional_popcount(words, weights).tolist() == want


def test_words_hold_the_surviving_subsets():
    assert survival_word(0) == 2**32 - 1
    assert survival_word(31) == 1
    assert all((survival_word(f) >> s & 1) == (f & s == 0) for f in range(32) for s in range(32))


def test_counts_do_not_depend_on_batches(spark):
    rows = [(f"p{i % 3}", i % 2 == 0, i % 5 == 0, i % 32, 1 + i % 9) for i in range(300)]
    schema = "part string, good boolean, toxic boolean, fails int, n long"
    one = sorted(map(tuple, subset_survivors(spark.createDataFrame(rows, schema).coalesce(1)).collect()))
    many = sorted(map(tuple, subset_survivors(spark.createDataFrame(rows, schema).repartition(9)).collect()))
    assert one == many and len(one) == 96
    assert next(r for r in one if r[:2] == ("p0", 0))[2] == sum(r[4] for r in rows if r[0] == "p0")


def test_empty_tables_and_text_limits(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(none, labels).collect() == []
    at = spark.createDataFrame([(1, "A" * 3 + "x" * 97, "en"), (2, "A" * 4 + "x" * 96, "en")], SCHEMA)
    assert [r.fails & 4 for r in text_failures(at).orderBy("doc_id").collect()] == [0, 4]
    assert {r.step: (r.kept, r.removed) for r in filter_audit(at, labels).where("filter_order = 'CABDE'").collect()} == {1: (1, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
