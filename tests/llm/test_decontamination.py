import itertools
import random
import re

from panelwright.llm import decontamination
from panelwright.llm.decontamination import drop_contaminated, overlaps


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    """The rule itself, at every alignment: no seeds."""
    out = {}
    for d, text in docs:
        doc = words(text)
        for i, other in items:
            item = words(other)
            n = len(item)
            if n < 5:
                continue
            shifts = {p - q for p, w in enumerate(doc) for q, v in enumerate(item) if v == w}  # all that agree anywhere
            length = min(13, n)
            for s in shifts:
                same = [int(0 <= k + s < len(doc) and doc[k + s] == w) for k, w in enumerate(item)]
                for f in range(n - length + 1):
                    got = sum(same[f : f + length])
                    if got >= 0.8 * length - 1e-9:
                        a, b, m, c = out.get((d, i), (10**9, -1, 0, 0))
                        out[d, i] = (min(a, f + s), max(b, f + s + length - 1), max(m, got), c + 1)
    return out


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 5, 6, 7, 8, 12, 13, 20, 50])))) for i in range(40)] + [(90, None), (91, ""), (92, "W1 w2, w3!")]
    docs = []
    for d in range(200):
        text = rng.choices(vocabulary, k=rng.randrange(0, 60))
        if rng.random() < 0.7:
            passage = words(rng.choice(items)[1])
            for _ in range(int(len(passage) * rng.choice([0, 0.1, 0.2, 0.3]))):
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
            at, cut = rng.randrange(len(text) + 1), rng.choice([0, 0, 3])
            text[at:at] = passage[cut:]
        docs.append((d, ", ".join(text).upper() if d % 5 == 0 else " ".join(text)))
    return docs, items


def found(df):
    return {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.matched, r.windows) for r in df.collect()}


def test_equals_brute_force_by_broadcast_and_by_shuffle(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 40
    for size in (decontamination.BROADCAST_BYTES, -1):
        assert found(overlaps(d, b, broadcast_bytes=size)) == want


def test_equals_brute_force_in_pieces_and_by_a_filter_of_seeds(spark, monkeypatch):
    """A text of several pieces; seeds that are too many to broadcast while their filter is not."""
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    monkeypatch.setattr(decontamination, "PIECE", 1)
    for size in (decontamination.BROADCAST_BYTES, 4096, -1):
        assert found(overlaps(d, b, broadcast_bytes=size)) == want


def test_long_texts_full_of_a_passage(spark):
    """20,000 words, each the beginning of a hit: kept with the whole text for each hit, they would take gigabytes a text."""
    passage = [f"p{i}" for i in range(20)]
    docs = spark.range(16, numPartitions=4).withColumnsRenamed({"id": "doc_id"}).selectExpr("doc_id", f"repeat('{' '.join(passage)} ', 1000) AS text")
    bench = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    # Each repeat adds as many windows as the one before it.
    one = brute([(0, " ".join(passage * 3))], [(7, " ".join(passage))])[0, 7]
    each = brute([(0, " ".join(passage * 4))], [(7, " ".join(passage))])[0, 7][3] - one[3]
    want = (0, 19_999, 13, one[3] + 997 * each)
    for size in (decontamination.BROADCAST_BYTES, 4096, -1):
        assert found(overlaps(docs, bench, broadcast_bytes=size)) == {(d, 7): want for d in range(16)}


def test_substitutions_are_tolerated(spark):
    rng = random.Random(1)
    item = [f"q{i}" for i in range(40)]
    docs = []
    for d in range(200):
        t = list(item)
        for i in rng.sample(range(40), 6):
            t[i] = "other"
        docs.append((d, " ".join(["own"] * 10 + t)))
    got = overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"))
    assert got.count() >= 198


def test_odd_rows_and_filter(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, f"x {passage} y", "c", 3), (3, "clean", "d", 4), (None, passage, "e", 5), (4, "word " * 100_000, "f", 6), (5, "clean too", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, shift int")
    bench = spark.createDataFrame([(7, passage, "z"), (8, None, "z"), (7, passage, "z")], "item_id long, text string, seed string")
    assert set(found(overlaps(docs, bench))) == {(3, 7), (None, 7)}
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["shift"] for r in kept.collect()) == [1, 2, 6, 7]
    none = spark.createDataFrame([], "item_id long, text string")
    assert overlaps(docs, none).collect() == [] and drop_contaminated(docs, none).count() == 7
    assert overlaps(docs.limit(0), bench).collect() == []


def test_main_path_has_no_python(spark):
    docs, items = corpus()
    plan = overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_every_allowed_substitution_of_a_short_item_is_found(spark):
    """By the rule itself, without seeds: items of 5 to 14 words, all patterns, within a document and as a whole one that may be cut at an end."""
    items, docs, want = [], [], set()
    for n in range(5, 15):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        length = min(13, n)
        for f in range(n - length + 1):
            for m in range(length - -(-length * 8 // 10) + 1):
                for gone in itertools.combinations(range(f, f + length), m):
                    text = [w if k not in gone and f <= k < f + length else "other" for k, w in enumerate(item)]
                    first, last = (min(k for k in range(n) if text[k] != "other"), max(k for k in range(n) if text[k] != "other"))
                    for x in (["own", *text, "own"], text[first : last + 1]):
                        want.add((len(docs), n))
                        docs.append((len(docs), " ".join(x)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert set(found(overlaps(d, b))) == want
