import random
import zlib

import pytest

from panelwright.llm import language_id
from panelwright.llm.language_id import drop_unidentified, identified, learned

WORDS = {"aa": ["the", "of", "and", "thing", "with", "water"], "bb": ["der", "und", "nicht", "wasser", "größe", "mit"], "cc": ["água", "não", "com", "que", "coração", "uma"]}


def sentences(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang], k=rng.choice([3, 8, 30]))).title(), lang))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sentences(400), "doc_id long, text string, lang string").repartition(5)


def test_held_out_accuracy_and_flag(spark, docs):
    got = identified(docs, learned(docs)).collect()
    truth = {i: lang for i, _, lang in sentences(400)}
    assert len(got) == 400
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_backoff_goes_to_shorter_grams(docs):
    model = learned(docs)
    assert model.word("wasserm")[1] > model.word("wasserm")[0]
    assert model.predict("nichtxx wasserq")[0] == "bb"
    assert model.predict("ç")[0] == "cc"
    assert "waters" not in model.tables[0]


def test_counts_follow_all_training_rows(docs):
    model = learned(docs)
    train = [(t, lang) for i, t, lang in sentences(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    words = {w for t, _ in train for w in t.lower().split()}
    assert set(model.tables[0]) == words


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "12 34 !"), (None, "the water"), (4, "the " * 100_000), (4, "und nicht"), (5, "漢字")]
    odd = spark.createDataFrame([(*r, "k", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = {(r.doc_id, r.lang_pred): r.score for r in identified(odd, learned(docs)).collect()}
    assert got[(1, "und")] == got[(2, "und")] == got[(3, "und")] == 0
    assert (None, "aa") in got and (4, "aa") in got and (4, "bb") in got and len(got) == 7
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identified(empty, learned(empty)).collect() == []
    assert [r.lang_pred for r in identified(odd.limit(1), learned(empty)).collect()] == ["und"]


def test_filter_keeps_clean_documents_and_columns(spark, docs):
    extra = spark.createDataFrame([(900, None, "aa"), (901, "  ", "aa"), (902, "漢字", "bb")], "doc_id long, text string, lang string")
    kept = drop_unidentified(docs.unionByName(extra))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(400))


def test_tables_are_bounded(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    counts = docs.select(F.explode(F.split("text", " ")).alias("key"), "lang").groupBy("lang", "key").agg(F.count("*").alias("n"))
    taken = language_id._frequent(counts, 7).collect()
    every = language_id._frequent(counts, 10_000).collect()
    assert len(taken) <= 7 and len(every) == 18
    assert min(r.total for r in taken) >= max(r.total for r in every if r.key not in {t.key for t in taken}) if taken else True


HELD, HELD_TOO = [i for i in range(900, 1000) if zlib.crc32(str(i).encode()) % 4 == 2][:2]


def test_filter_keeps_words_that_many_languages_share(spark):
    """Six languages know the word equally well, so its best share is 1/6; words without any evidence still go."""
    rows = [(i, f"shared {lang * 3}", lang * 2) for i, lang in enumerate("abcdef" * 10)]
    rows += [(HELD, "shared", "aa"), (HELD_TOO, "漢字", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert 0 < learned(docs).predict("shared")[1] < 0.3
    assert {r.doc_id for r in drop_unidentified(docs).collect()} == set(range(60)) | {HELD}
