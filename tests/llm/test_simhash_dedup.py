import random

import xxhash

from panelwright.llm import components as module
from panelwright.llm.components import components
from panelwright.llm.simhash_dedup import drop_near_copies, linked_fingerprints, near_groups


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def fingerprint(text):
    words, word = [], ""
    for c in lower(text or "") + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(docs):
    prints = [fingerprint(t) for _, t in docs]
    root = closed(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for (d, _), r in zip(docs, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, p, least.get(r)) for (d, _), p, r in zip(docs, prints, root, strict=True)), key=repr)


def signed(x):
    return x - (x >> 63 << 64)


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Ünit", "İx", "KELVINK"]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 40, 400]))) for _ in range(120)]
    docs = list(enumerate(base))
    for i in range(150):
        t = rng.choice(base).split()
        t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((200 + i, "\t".join(t).upper() if i % 3 == 0 else " ".join(t)))
    docs += [(500, None), (501, ""), (502, " \n "), (503, "hot"), *[(600 + i, "hot") for i in range(60)], (None, "alone null id"), (None, "hot"), (601, "hot"), (700, "long word " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in near_groups(df).collect()), key=repr)
    assert got == brute(docs)


def test_links_connect_all_pairs_within_two_bits(spark):
    rng = random.Random(3)
    values = {0, 1 << 63, (1 << 63) | 1, 2**64 - 1}
    while len(values) < 500:
        v = rng.choice(list(values)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3])):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    edges = linked_fingerprints(df)
    assert all((r.u % 2**64 ^ r.v % 2**64).bit_count() <= 2 for r in edges.collect())
    at = {signed(v): i for i, v in enumerate(values)}
    got = closed(len(values), [(at[r.u], at[r.v]) for r in edges.collect()])
    assert got == closed(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)] + [(900, 900), (500, 501), (501, 500), (501, 500)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = closed(1300, links)
    assert got == {i: root[i] for link in links for i in link if link[0] != link[1]}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x"), (1, "A b c d", "y"), (2, None, "z"), (4, "", None), (9, "else", "w")], "doc_id long, text string, fingerprint string")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_end_as_soon_as_all_are_stars(spark, monkeypatch):
    """A round that changes nothing is not run to see that nothing changes."""
    written = []
    monkeypatch.setattr(module, "stage", lambda df, f=module.stage: written.append(1) or f(df))
    stars = [(n, n % 3) for n in range(3, 40)] + [(5, 2), (1, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {n: n % 3 for n in range(40)}
    assert len(written) == 2  # one round: the large and the small star
