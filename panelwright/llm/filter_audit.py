"""Filter interaction audit: what every order of the filters removes, redoes and loses.

A document fails some of five filters. It survives a subset of them if it fails none of the subset, so it becomes a
32-bit word with one bit for each subset it survives. Carry-save adders turn the words of a part and label into
positional counts: how many documents survive each subset. All figures of all orders follow from those 32 numbers.

* A: under 200 words. B: 100 * distinct words < 50 * words. C: 100 * letters A-Z > 3 * code points. D: holds one of
  `#$%&*|`. Words lie between ASCII white space.
* E: the text is identical to that of any smaller id, whether or not another filter removes that one.

Equal texts share A to D, so documents are counted by text digest, part and label before the least id of a digest is
looked for; a text that a third of all rows hold is one counted row for each part and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from panelwright.llm.ship import map_arrow

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS = 200
DISTINCT_SHARE = 50
CAPITAL_SHARE = 3
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))
#: A missing id never has a label; such rows are spread over this many keys.
SALTS = 1024


def failures_of(text: bytes) -> int:
    """Bit 0 for A to bit 3 for D."""
    words = text.split()  # bytes: ASCII white space only
    n = len(words)
    few = n < MIN_WORDS
    dull = 100 * len(set(words)) < DISTINCT_SHARE * n
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_SHARE * len(text.translate(None, CONTINUED))
    odd = len(text.translate(None, SIGNS)) < len(text)
    return few | dull << 1 | loud << 2 | odd << 3


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, digest, fails) for each row: filters A to D. Null text and null part count as empty."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = StructType([source.schema["doc_id"], StructField("part", StringType()), StructField("digest", BinaryType()), StructField("fails", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            digests = pa.array([sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), digests, pa.array(map(failures_of, texts), pa.int32())], names=kind.names)

    return map_arrow(source, run, kind)


def counted_failures(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, good, toxic, fails, n) with filter E: documents that agree in part, labels and failures, by text.

    A document is good or toxic if any row of `labels` says so. Rows that repeat the least id of a text are no copies
    of each other; rows without an id have no label, are no copies and make none.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("_key")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    marks = marks.where("good or toxic").withColumn("_salt", F.lit(0))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    rows = failed.select("*", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"), spread.alias("_salt"))
    labelled = rows.join(marks, ["_key", "_salt"], "left").fillna(False, ["good", "toxic"])
    once = labelled.groupBy("_key", "_salt", "doc_id", "digest", "part", "good", "toxic", "fails").agg(F.count("*").alias("n"))
    texts = once.groupBy("digest", "part", "good", "toxic", "fails").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    firsts = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = texts.withColumn("first", first).select("part", "good", "toxic", "fails", firsts.alias("kept"), (F.col("n") - firsts).alias("copies"))
    both = F.array(F.struct("fails", F.col("kept").alias("n")), F.struct(F.col("fails").bitwiseOR(COPY).alias("fails"), F.col("copies").alias("n")))
    return split.select("part", "good", "toxic", F.inline(both)).where("n > 0")


def survival_word(fails: int) -> int:
    """Bit s is set if a document with these failures survives the filters of subset s."""
    return sum(1 << s for s in range(1 << len(FILTERS)) if not s & fails)


def positional_popcount(words, weights):
    """How often each of the 32 bits is set, by carry-save adders. A word of weight w counts w times.

    Level k holds words that stand for 2**k each: three of them become one sum on the level and one carry on the next.
    """
    import numpy as np

    counts, carried, level = np.zeros(32, np.int64), np.zeros(0, np.uint32), 0
    top = int(weights.max()).bit_length() if len(weights) else 0
    while level < top or len(carried):
        here = np.concatenate([carried, words[weights >> level & 1 == 1]])
        carries = []
        while len(here) > 1:
            if len(here) == 2:
                here = np.append(here, np.uint32(0))
            whole = len(here) // 3 * 3
            x, y, z = here[0:whole:3], here[1:whole:3], here[2:whole:3]
            carries.append(x & y | z & (x ^ y))
            here = np.concatenate([x ^ y ^ z, here[whole:]])
        if len(here):
            counts += (here[0] >> np.arange(32, dtype=np.uint32) & 1).astype(np.int64) << level
        carried = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
        carried, level = carried[carried != 0], level + 1
    return counts


def subset_survivors(counted: DataFrame) -> DataFrame:
    """(part, subset, survivors, good, toxic): documents that survive each of the 32 subsets, of all and by label.

    counted: (part, good, toxic, fails, n). What leaves a task is 32 rows for each part of a batch, summed in the JVM.
    """
    kind = StructType([StructField("part", StringType()), StructField("subset", IntegerType())] + [StructField(c, LongType()) for c in ("survivors", "good", "toxic")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = np.array([survival_word(f) for f in range(1 << len(FILTERS))], np.uint32)
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(0).dictionary_encode()
            part, n = codes.indices.to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            words = table[b.column(3).to_numpy(zero_copy_only=False)]
            label = [np.ones(len(words), bool), *[b.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (1, 2)]]
            order = np.argsort(part, kind="stable")
            names, starts = codes.dictionary.to_pylist(), np.searchsorted(part[order], np.arange(len(codes.dictionary) + 1))
            for i, name in enumerate(names):
                mine = order[starts[i] : starts[i + 1]]
                found = [positional_popcount(words[m], n[m]) for m in (mine[x[mine]] for x in label)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * 32, pa.string()), pa.array(range(32), pa.int32()), *map(pa.array, found)], names=kind.names)

    source = counted.select("part", "good", "toxic", "fails", F.col("n").cast("long").alias("n"))
    return map_arrow(source, run, kind).groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("survivors", "good", "toxic")])


def order_report(survivors: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included; counts of documents within the part.

    kept, removed, good_lost and toxic_lost belong to the step; redundant failed its filter but went before;
    unique_fails fail its filter only; shapley is what the filter removes, summed over all 120 orders.
    """
    entry = F.array_sort(F.collect_list(F.struct("subset", "survivors", "good", "toxic")))
    parts = survivors.groupBy("part").agg(entry.alias("_all"))  # 32 entries
    parts = parts.select("part", *[F.col(f"_all.{c}").alias(f"_{c}") for c in ("survivors", "good", "toxic")])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = "shiftleft(1, ascii(substr(filter_order, {}, 1)) - ascii('A'))"
    masked = steps.withColumn("_own", F.expr(bit.format("step"))).withColumn(
        "_before", F.expr(f"aggregate(slice(sequence(1, {len(FILTERS)}), 1, step - 1), 0, (m, i) -> m | {bit.format('i')})")
    )
    at = lambda c, s: F.element_at(f"_{c}", s + 1)
    full, own, before = F.lit((1 << len(FILTERS)) - 1), F.col("_own"), F.col("_before")
    after = before.bitwiseOR(own)
    lost = lambda c: at(c, before) - at(c, after)
    removed = lost("survivors")
    # |S|! (4 - |S|)! orders put exactly the subset S before a filter
    shapley = F.expr("aggregate(sequence(0, 31), 0L, (t, s) -> t + if(s & _own = 0, element_at(array(24L, 6L, 4L, 6L, 24L), bit_count(s) + 1) * (element_at(_survivors, s + 1) - element_at(_survivors, (s | _own) + 1)), 0L))")
    return masked.select(
        "part", "filter_order", "step",
        at("survivors", after).alias("kept"),
        removed.alias("removed"),
        (at("survivors", F.lit(0)) - at("survivors", own) - removed).alias("redundant"),
        (at("survivors", full.bitwiseXOR(own)) - at("survivors", full)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The report of all orders over whole texts. labels: (id, quality, toxic).

    Null text and null part count as empty; long texts are read whole; repeated rows and ids count as often as they
    stand there; an empty table gives no rows; columns of other names are not read.
    """
    return order_report(subset_survivors(counted_failures(text_failures(docs, id_col, text_col, part_col), labels, id_col)))
