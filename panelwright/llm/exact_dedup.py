"""Exact duplicates with a split for heavy hitters.

A frequent-items sketch of the Misra-Gries family (`approx_top_k`) names the digests that may be frequent. Their true
counts are taken in one pass; those that reach the threshold are broadcast, so that their rows are decided where they
lie. All other digests are grouped by an ordinary shuffle, in which no group is larger than the threshold.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.decided import without_ids
from panelwright.session import stage

#: A digest with at least one in HEAVY_SHARE of the rows is heavy: at most HEAVY_SHARE digests can be.
HEAVY_SHARE = 1_000
#: Counters of the sketch. Its error is 3.5 / 16,384 of the rows, below half of one in HEAVY_SHARE, and fewer than
#: CANDIDATES digests can show more than the difference: no heavy digest is missed.
COUNTERS = 10_000
CANDIDATES = 1_500


def normal_text(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. Other columns are not read.

    Of equal texts the smallest id stays. Rows that repeat an id are one document and stay or go together. Null ids
    sort last; a group that has no other id keeps its null rows. Null texts equal empty ones. An empty table gives an
    empty result.
    """
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), F.sha2(normal_text(F.col(text_col)), 256).alias("text_sha256")))
    spark = rows.sparkSession
    sketch = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(text_sha256, {CANDIDATES}, {COUNTERS})").alias("top"))
    # A frequent digest shows with its count less the error at least; others cannot be heavy.
    candidates = sketch.select("n", F.explode("top").alias("t")).where(F.col("t.count") * 2 * heavy_share >= F.col("n"))
    found = [(r["text_sha256"], r["least"]) for r in candidates.select(F.col("t.item").alias("text_sha256"), F.ceil(F.col("n") / heavy_share).alias("least")).collect()]
    names = spark.createDataFrame(found, "text_sha256 string, least long")
    # At most CANDIDATES rows of 64 letters: a broadcast of a fixed size.
    heavy = (
        rows.join(F.broadcast(names), "text_sha256")
        .groupBy("text_sha256", "least")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size >= least and group_size > 1")
        .drop("least")
    )
    winners = stage(heavy)
    decided = rows.join(F.broadcast(winners), "text_sha256")
    others = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    by_digest = "partition by text_sha256"
    shuffled = others.select("*", F.expr(f"min(doc_id) over ({by_digest})").alias("keep_id"), F.expr(f"count(*) over ({by_digest})").alias("group_size"))
    both = decided.unionByName(shuffled)
    return both.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Ids are expected to be unique; rows with a null id that stay are returned too."""
    found = exact_groups(docs, id_col, text_col)
    return without_ids(docs, id_col, found.select(F.col(id_col).alias("_id"), F.col("kept").alias("_stays")))
