import random

import corpus_pipeline
from panelwright.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(3)
    words = {k: [f"{stem}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] for k, stem in (("aa", "the"), ("bb", "größe"))}
    docs = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        docs.append((i, "\n".join(" ".join(rng.choices(words[lang], k=30)) for _ in range(4)), lang))
    passage = " ".join(f"bench{chr(97 + i)}" for i in range(24))
    first = docs[0][1]
    docs += [
        (200, None, "aa"),
        (201, "12 34 !!", "aa"),
        (202, first, docs[0][2]),  # its lines go, then it is an empty copy
        (203, docs[1][1].split("\n")[0] + "\n" + docs[5][1].replace("\n", " "), docs[5][2]),
        (204, docs[7][1] + " " + passage, docs[7][2]),
        (205, first, docs[0][2]),
    ]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in docs], [(1, passage), (2, None)]


def test_stages_take_effect(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        now = step(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        if name != "packing":
            assert now.columns == COLUMNS
        seen[name] = now.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    everything = {d[0] for d in docs}
    assert ids["language_id"] == everything - {200, 201}
    assert ids["line_dedup"] == ids["language_id"]
    texts = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert texts[202] == texts[205] == "" and texts[0] == docs[0][1]
    assert texts[203] == docs[5][1].replace("\n", " ")
    assert ids["near_dedup"] >= set(range(120)) - {5} and 205 not in ids["near_dedup"] and 202 in ids["near_dedup"]
    assert ids["decontamination"] == ids["near_dedup"] - {204}
    assert ids["packing"] == ids["decontamination"]
    whole = QUERIES["pipeline"](spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sum(r.length for r in whole) == sum(r.length for r in seen["packing"])
    assert {r.doc_id: r.doc_tokens for r in whole} == {r.doc_id: r.doc_tokens for r in seen["packing"]}
    assert all(key(r) for r in whole)


def test_decontamination_of_long_texts_full_of_passages(spark, tmp_path):
    """Texts of 20,000 words of which most begin a hit, in as many tasks as run at once."""
    passages = [" ".join(f"bench{chr(97 + k)}{chr(97 + i)}" for i in range(24)) for k in range(4)]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = " ".join(passages) + " "
    docs = spark.range(32, numPartitions=4).selectExpr("id AS doc_id", f"CASE WHEN id % 8 = 7 THEN repeat('clean words ', 10000) ELSE repeat('{full}', 210) END AS text")
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()} == {7, 15, 23, 31}
