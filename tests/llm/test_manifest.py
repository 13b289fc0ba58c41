import random
from hashlib import sha256
from zlib import crc32

import pytest

from panelwright.llm import manifest as m

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def fold_up(hashes):
    """All levels, and for each leaf what stands before and after it on each."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([digest(*now[i : i + 16]) for i in range(0, len(now), 16)])
    paths = []
    for i in range(len(hashes)):
        path = []
        for level in levels[:-1]:
            run = i // 16 * 16
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    leaf = lambda r: digest(*map(value, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = fold_up([x[2] for x in groups[name]])
    root, tops = fold_up([trees[n][0] for n in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        subroot, paths = trees[name]
        for (_, _, h, r), path in zip(groups[name], paths, strict=True):
            low = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            start = leaf((*r[:4], low)) if r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0 else h
            for before, after in [*path, *top]:
                start = digest(before, start, after)
            out.append((r[0], h, subroot, root, digest(*[x for p in [*path, *top] for x in p]), start, start == root))
    return sorted(out, key=repr)


def corpus(n):
    rng = random.Random(n)
    sources = ["hot"] * 8 + [None, "", "b", "Ä", "z\U0001f600", "a b", "~"] + [f"s{i}" for i in range(n // 12)]
    rows = [(rng.randrange(-50, 5 * n), rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([None, 0, 17]), rng.choice([None, "", "lower", "Mixed Case", "ÄÖ É", "X" * 50_000])) for _ in range(n)]
    rows += [rows[0], rows[0], (None, "hot", None, None, None), (None, "hot", None, None, "B"), (None, None, "en", 1, "C"), (7, "alone", "en", 2, "Alone")]
    return rows


def run(spark, rows, parts=5):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", tree string, at int").repartition(parts)
    return sorted((tuple(r) for r in m.manifest(docs).collect()), key=repr)


@pytest.mark.parametrize(("n", "range_rows"), [(500, 40), (500, 10_000), (12, 4), (17, 4)])
def test_equals_brute_force(spark, monkeypatch, n, range_rows):
    monkeypatch.setattr(m, "RANGE_ROWS", range_rows)
    rows = corpus(n)
    got = run(spark, rows)
    assert got == plain(rows)
    if n > 100:
        assert {r[6] for r in got} == {True, False}


def test_one_leaf_one_run_and_full_runs(spark):
    assert run(spark, [(5, "s", None, None, "T")]) == plain([(5, "s", None, None, "T")])
    for n in (16, 17, 256, 257):
        rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
        got = run(spark, rows, 3)
        assert got == plain(rows) and len({r[3] for r in got}) == 1


def test_empty_table_and_no_python(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert m.manifest(docs).collect() == []
    plan = m.manifest(spark.createDataFrame(corpus(30), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
