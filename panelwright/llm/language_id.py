"""Language identification with word-first backoff.

A known word votes with its log frequency in each language. For a word that the table does not know, the longest
character n-grams that any table knows decide, then shorter ones. Counts are taken over all labelled documents; the
tables that are broadcast hold the most frequent entries up to a fixed number.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from panelwright.llm.held import held
from panelwright.llm.ship import map_arrow, slices
from panelwright.session import stage

#: Entries of the tables: they bound what is broadcast and what a worker holds.
MODEL_WORDS = 150_000
MODEL_GRAMS = 40_000
#: Lengths of the n-grams, longest first. Unless single, they see a space on either side of the word.
GRAMS = (4, 3, 2, 1)
#: Score that a document needs, beyond 0, to stay. An absolute share would depend on the number of languages.
LEAST_SCORE = 0.0
#: Added to each count.
SMOOTHING = 0.5
#: Words whose evidence counts in full; longer texts are weighed as if they had so many.
EVIDENCE = 20.0
#: Unknown words that a worker keeps, some 15 MB; it starts anew beyond that.
MEMO_WORDS = 50_000
#: Bytes of texts that are Python strings at a time; a longer text goes alone.
SLICE_BYTES = 1 << 20

# Runs of letters; numbers that are not digits count as letters in both engines' classes.
_SPLIT = r"[^\p{L}\p{Nl}\p{No}]+"
_FIND = re.compile(r"[^\W\d_]+").findall


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text (null: empty text), modulo."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % divisor


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows (key, total, langs) of the most frequent keys: at most `most`, cut at a step of the total.

    The cut is read from a histogram with eight steps to each doubling, so no task ranks keys.
    """
    totals = stage(counts.groupBy("key").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("langs")))
    step = F.floor(F.log2("total") * 8)
    left, least = most, None
    for r in sorted(totals.groupBy(step.alias("step")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["step"]
    return totals.where(step >= F.lit(least)) if least is not None else totals.where("false")


class Model:
    """Log frequencies per language of words and n-grams; built from bounded tables."""

    def __init__(self, languages: list[str], tables: dict[int, list[tuple[str, dict]]], sizes: dict[int, dict[str, int]]):
        self.languages = languages
        at = {x: i for i, x in enumerate(languages)}
        self.tables = {}
        for n, rows in tables.items():
            floor = [math.log(SMOOTHING / (sizes[n].get(x, 0) + SMOOTHING * (len(rows) + 1))) for x in languages]
            table = self.tables[n] = {}
            for key, langs in rows:
                vector = list(floor)
                for lang, count in langs.items():
                    vector[at[lang]] += math.log((count + SMOOTHING) / SMOOTHING)
                table[key] = tuple(vector)
        self.memo: dict[str, tuple] = {}
        self.nothing = (0.0,) * len(languages)

    def word(self, word: str) -> tuple:
        if (v := self.tables[0].get(word) or self.memo.get(word)) is not None:
            return v
        v = self.nothing
        for n in GRAMS:
            table, padded = self.tables[n], f" {word} " if n > 1 else word
            known = [x for i in range(len(padded) - n + 1) if (x := table.get(padded[i : i + n]))]
            if known:
                v = tuple(sum(x) / len(known) for x in zip(*known, strict=True))
                break
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        if len(word) <= 64:
            self.memo[word] = v
        return v

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _FIND(text.lower()) if text else []
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        votes, known = Counter(words), self.tables[0]
        sums = [0.0] * len(self.languages)
        for w, n in votes.items():
            for i, x in enumerate(known.get(w) or self.word(w)):
                sums[i] += n * x
        if not any(sums):
            return self.languages[0], 0.0
        scale = min(1.0, EVIDENCE / len(words))
        best = max(range(len(sums)), key=sums.__getitem__)
        return self.languages[best], 1 / sum(math.exp(max(-700.0, (x - sums[best]) * scale)) for x in sums)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", model_words: int = MODEL_WORDS, model_grams: int = MODEL_GRAMS) -> Model:
    """A model from all rows with text and language."""
    text = F.explode(F.split(F.lower(F.col(text_col)), _SPLIT)).alias("key")
    words = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text).where("key <> ''")
    words = stage(words.groupBy("lang", "key").agg(F.count("*").alias("n")))
    tables, sizes = {}, {}

    def take(n: int, counts: DataFrame, most: int) -> None:
        tables[n] = [(r["key"], r["langs"]) for r in _frequent(counts, most).select("key", "langs").collect()]
        sizes[n] = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}

    take(0, words, model_words)
    padded = words.select("lang", "n", F.concat(F.lit(" "), "key", F.lit(" ")).alias("key"))
    for n in GRAMS:
        grams = F.expr(f"explode(transform(sequence(1, greatest(length(key) - {n - 1}, 1)), i -> substring(key, i, {n})))")
        counts = stage((padded if n > 1 else words).where(F.length("key") >= n).select("lang", "n", grams.alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n")))
        take(n, counts, model_grams)
    return Model(sorted(sizes[0]), tables, sizes)


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held-out flag (crc32 remainder 2 of 4), lang_pred, score (the prediction's share of the votes).

    `und` with score 0: null texts, texts without a letter, and all texts if nothing was learned. Only the text is used
    for a prediction. Where no table knows any part of the text the score is 0. Ties go to the language that sorts first. Rows that repeat an id and null ids are kept.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), (remainder(F.col(id_col), 4) == 2).alias("held_out"), F.col(text_col).alias("text"))
    kind = StructType([source.schema["doc_id"], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language_id", dict)  # the model and its memo come and go with the broadcast; what others left goes now
        predict = shared.value.predict
        for batch in batches:
            for b, texts in slices(batch, 2, SLICE_BYTES):
                found = [predict(t) for t in texts]
                columns = [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(source, run, kind).withColumnRenamed("doc_id", id_col)


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the documents that are not held out."""
    return fit(docs.where(remainder(F.col(id_col), 4) != 2), text_col, lang_col)


def drop_unidentified(docs: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents with a language, a score above 0 (some evidence) and of at least `least`, with all their columns as they were."""
    model = learned(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language_id", dict)  # the model and its memo come and go with the broadcast; what others left goes now
        predict = shared.value.predict
        for batch in batches:
            for b, texts in slices(batch, at, SLICE_BYTES):
                found = [predict(t) for t in texts]
                yield b.filter(pa.array([lang != "und" and score > 0 and score >= least for lang, score in found], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
