import random

from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from panelwright.llm import line_dedup
from panelwright.llm.line_dedup import edit_distance, normal_lines, repeated_lines, similar, simhashes, without_repeated_lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 14))
def test_edit_distance(a, b, most):
    assert edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


def test_long_lines_take_moderate_time():
    a = "word " * 12_000
    b = a[:30_000] + "x" + a[30_001:50_000] + "yy" + a[50_000:]
    assert similar(a, b) and not similar(a, a[: len(a) // 2])


def bits(line):
    words = line.split(" ")
    long = [w for w in words if len(w) > 3]
    words = long if len(long) >= 5 else words
    hashes = [xxh64_intdigest(w.encode()) for w in words]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(words))


def brute(docs):  # noqa: C901
    occurrences = []
    for d, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if n := normal_lines(line)[0]:
                occurrences.append((d, k, n))
    different = sorted({n for _, _, n in occurrences})
    prints = {n: bits(n) for n in different}
    root = {n: n for n in different}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(different):
        for b in different[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8 - 1e-12:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {}
    for d, k, n in occurrences:
        kept[find(n)] = min(kept.get(find(n), (d, k)), (d, k))
    gone = {}
    for d, k, n in occurrences:
        if kept[find(n)] != (d, k):
            gone.setdefault(d, set()).add(k)
    return {d: sorted(x) for d, x in gone.items()}


def test_simhash():
    lines = ["a", "one two three", "a a b", "ü x 000", " ".join(f"word{i}" for i in range(700)), "many more words than five are here again", "repeated repeated words words words again again"]
    assert [int(x) % 2**64 for x in simhashes(lines)] == [bits(x) for x in lines]


def corpus(seed=3, docs=60):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30, 60]))) for _ in range(40)]
    out = []
    for d in range(docs):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            line = rng.choice(base).split()
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = rng.choice(words)
            if rng.random() < 0.2:
                line.insert(rng.randrange(len(line) + 1), str(rng.randrange(100)))
            text = " ".join(line)
            lines.append(text.upper() + "!" if rng.random() < 0.2 else text)
        out.append((d, "\n".join(lines)))
    return out


def test_equals_brute_force(spark):
    for seed in (3, 4):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        want = brute(docs)
        for near in (8, 1):  # the second makes nearly all buckets large ones
            assert {r.doc_id: r.lines for r in repeated_lines(df, near=near).collect()} == want
        assert len(want) > 10


def test_chained_variants_are_one_group(spark):
    """A chain whose ends are far apart, and a hot line with many variants."""
    rng = random.Random(8)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    line = rng.choices(words, k=60)
    docs = []
    for i in range(120):
        line[rng.randrange(60)] = rng.choice(words)
        docs.append((i, " ".join(line)))
    hot = rng.choices(words, k=80)
    for i in range(120):
        one = list(hot)
        one[rng.randrange(80)] = rng.choice(words)
        docs.append((1000 + i, " ".join(one if i % 2 else hot)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.lines for r in repeated_lines(df).collect()} == brute(docs)


def test_groups_of_the_first_step_are_nodes_of_the_second(spark, monkeypatch):
    """The second step joins whole groups: it must not walk through all links once more."""
    seen = []

    def traced(edges, f=line_dedup.components):
        seen.append([{r.u, r.v} for r in edges.collect()])
        return f(edges)

    monkeypatch.setattr(line_dedup, "components", traced)
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.lines for r in repeated_lines(df, near=1).collect()} == brute(docs)
    first, second = seen
    assert second and len(second) < len(first)
    groups = []  # of the first step's links
    for link in first:
        groups = [g for g in groups if not g & link] + [set().union(link, *(g for g in groups if g & link))]
    least = {n: min(g) for g in groups for n in g}
    assert all(least.get(n, n) == n for link in second for n in link)


def test_odd_rows_columns_and_texts(spark):
    rows = [(1, "same line here\n---\n\nown text one", "k"), (2, "Same LINE here!\n---\n\nother words two", "l"), (3, None, "m"), (4, "", None), (5, "same line here", "n"), (5, "same line here", "o"), (None, "same line here\nlast", "p"), (6, "line 12 of 99\nline 34 of 56", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines string")
    out = without_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "lines", "_n_removed"]
    got = {r.lines: (r.text, r._n_removed) for r in out.collect()}
    assert got["k"] == (rows[0][1], 0)
    assert got["l"] == ("---\n\nother words two", 1)
    assert got["m"] == (None, 0) and got[None] == ("", 0)
    assert got["n"] == got["o"] == ("", 1)
    assert got["p"] == ("last", 1)
    assert got["q"] == ("line 12 of 99", 1)
    assert without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_features_of_many_lines_equal_those_of_each():
    lines = ["a", "the of in", "alpha beta gamma delta epsilon of in", "alpha beta gamma delta of", "ünïc ödes äöüß ßßßß éééé ab", "漢字漢字 b", "0000 000 00", "w" * 300]
    words, counts = line_dedup._features(lines)
    each = [line_dedup.line_features(line) for line in lines]
    assert words.to_pylist() == [w for x in each for w in x] and counts.tolist() == [len(x) for x in each]


def plain(text):
    text = "".join("0" if c in "0123456789" else c if c.isalnum() or c == "\n" else " " for c in text.lower())
    return [" ".join(line.split()) for line in text.split("\n")]


def test_lines_of_many_texts_are_those_of_each():
    """Texts are normalised together: no space, line feed or final sigma of one reaches the next."""
    rng = random.Random(2)
    alphabet = ["a", "B", "7", "٣", "²", "Σ", "İ", "漢", "😀", " ", " ", "\n", "\t", "\r", "\x00", "\x1c", "\x85", "\xa0", "\u2028", "_", "-", "’"]
    texts = ["", "\n", " \n ", "a\n", "\na", "ΑΣ", "Σ ς", "  a  b \n c"] + ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(2000)]
    want = [plain(t) for t in texts]
    assert [normal_lines(t) for t in texts] == want
    assert line_dedup._normal_lines(texts).to_pylist() == [line for x in want for line in x]


def test_lines_keep_their_places_in_small_slices(spark, monkeypatch):
    docs = [(i, t) for i, (_, t) in enumerate(corpus(5, 30))] + [(99, ""), (98, "--\n\n x \n.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    want = {(d, k, n) for d, t in docs for k, n in enumerate(plain(t)) if n}
    for size in (1, 200):
        monkeypatch.setattr(line_dedup, "SLICE_BYTES", size)
        assert {(r.doc_id, r.line_no, r.line) for r in line_dedup.lines_of(df, "doc_id", "text").collect()} == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", "abc", "d", ""]), min_size=1, max_size=8), st.lists(st.sampled_from(["a", "bc", "abd", "d", ""]), min_size=1, max_size=8), st.integers(0, 30))
def test_edits_by_words_are_never_too_few(a, b, most):
    a, b = " ".join(a), " ".join(b)
    distance, edits = levenshtein(a, b), line_dedup.edits_by_words(a, b, most)
    assert edits >= distance or edits > most
    for share in (0.2, 0.5, 0.8):
        assert similar(a, b, share) == (distance <= int((1 - share) * max(len(a), len(b)) + 1e-9))


def test_lines_that_differ_in_words_need_no_letter_by_letter_distance(monkeypatch):
    monkeypatch.setattr(line_dedup, "edit_distance", None)
    words = [f"word{i}" for i in range(80)]
    for other in (words[:9] + ["other"] + words[10:], words[:30] + words[31:70] + ["new"] + words[70:], words[:-2], ["first", *words]):
        assert similar(" ".join(words), " ".join(other))
