import random
from collections import Counter

from panelwright.llm.licence_texts import NOTICES
from panelwright.llm.licences import _WORDS, Notices, licences, matches


def grams(text):
    w = _WORDS(text.lower())
    return Counter((w[i], w[i + 1]) for i in range(len(w) - 1))


def dice(a, b):
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


def brute(text, notices, similarity=0.8):
    """Every run of lines against every notice."""
    lines, known = text.split("\n"), [(n, grams(t)) for n, t in notices]
    has = [any(b in c for _, c in known for b in grams(x)) for x in lines]
    found = []
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if has[i] and has[j]:
                own = grams("\n".join(lines[i : j + 1]))
                best = min(((-dice(own, c), n) for n, c in known), default=(0, ""))
                if -best[0] >= similarity - 1e-12:
                    found.append((best[1], -best[0], i, j))
    found.sort(key=lambda m: (-m[1], m[2], m[3], m[0]))
    kept, taken = [], set()
    for m in found:
        rows = set(range(m[2], m[3] + 1))
        if not rows & taken:
            taken |= rows
            kept.append(m)
    return sorted(kept, key=lambda m: m[2])


def corpus():
    rng = random.Random(6)
    words = "the of and to software license work under this is as any copy permission version public".split()
    docs = []
    for i in range(250):
        lines = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 12]))) for _ in range(rng.randrange(0, 5))]
        if rng.random() < 0.8:
            notice = rng.choice(NOTICES)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 3])):
                notice[rng.randrange(len(notice))] = rng.choice(words)
            for _ in range(rng.choice([0, 0, 1, 4])):
                notice.insert(rng.randrange(len(notice)), "\n")
            lines.insert(rng.randrange(len(lines) + 1), " ".join(notice))
        docs.append((i, "\n".join(lines)))
    return docs


def test_blocks_equal_brute_force():
    known, n = Notices.of(NOTICES), 0
    for _, text in corpus():
        got = matches(text, known)
        assert [(a, round(b, 12), c, d) for a, b, c, d in got] == [(a, round(b, 12), c, d) for a, b, c, d in brute(text, NOTICES)]
        n += len(got)
    assert n > 100


def test_every_notice_finds_itself_and_neighbours_differ():
    known = Notices.of(NOTICES)
    for name, text in NOTICES:
        assert [m[:2] for m in matches("own words first\n" + text + "\nlast words", known)] == [(name, 1.0)]


def test_odd_rows(spark):
    rows = [(1, "x\nReleased under the MIT License.", "k"), (2, None, "l"), (3, "", "m"), (None, "Licensed under CC BY-NC 4.0.", None), (1, "LICENSED under   the apache license: version 2.0!", "n"), (4, "word " * 200_000, "o"), (5, "the license\n" * 20_000, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licence string")
    got = sorted(((r.doc_id or -1, r.licence, r.first_line, r.last_line) for r in licences(df).collect()))
    assert got == [(-1, "CC-BY-NC-4.0", 0, 0), (1, "Apache-2.0", 0, 0), (1, "MIT", 1, 1)]
    assert licences(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert licences(df, notices=[]).collect() == []
