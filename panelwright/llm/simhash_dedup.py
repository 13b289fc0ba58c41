"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint of 64 bits is cut into segments. For each segment the small Hamming ball is enumerated: the segment as
it is and with each of its bits turned. An address is a ball member together with the segments left as they are. Two
fingerprints with at most two differing bits always share an address (their midpoint, or one of them), so what a
table lookup by address brings together is a complete candidate set, and each candidate's whole distance is verified.

Because the address carries all segments, it holds at most 65 different fingerprints however many near copies there
are: the work grows with the number of different fingerprints and never with the square of a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelwright.llm.components import components
from panelwright.llm.decided import without_ids
from panelwright.llm.ship import map_arrow
from panelwright.session import stage

SHINGLE = 3
SEED = 42
SEGMENTS = 4
BITS = 64
#: Radius of the balls; fingerprints link at twice the radius or less.
RADIUS = 1
#: Shingles whose bits are counted at a time.
BLOCK = 100_000


def _fingerprint(text: str, shingle: int) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        value = xxh64_intdigest(b" ".join(words), SEED)
        return value - (value >> 63 << 64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    counts, n = np.zeros(BITS, np.int64), len(first)
    for at in range(0, n, BLOCK):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint long) for each row: A-Z lower-cased, words between ASCII white space, word shingles with repeats."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = StructType([source.schema["doc_id"], StructField("fingerprint", LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([_fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), prints], names=["doc_id", "fingerprint"])

    return map_arrow(source, run, kind)


def linked_fingerprints(different: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Edges (u, v) between different fingerprints that connect all pairs with at most two differing bits.

    Each address links its members to its least one; a member's distance to it is verified.
    """
    width = BITS // segments
    balls = [0] + [1 << (s * width + bit) for s in range(segments) for bit in range(width)]
    turned = F.array(*[F.lit(m - (m >> 63 << 64)).cast("long") for m in balls])
    table = different.select("fingerprint", F.explode(turned).alias("turn")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("turn")).alias("address"))
    found = table.select("fingerprint", F.expr("min(fingerprint) over (partition by address)").alias("least"))
    near = (F.col("fingerprint") != F.col("least")) & (F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("least"))) <= 2 * RADIUS)
    return found.where(near).select(F.col("fingerprint").alias("u"), F.col("least").alias("v"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint long, component_id (the least id that links reach, its own included).

    Null and empty texts have fingerprint 0 and link like any other. Null ids sort last: their component is null only
    where no other id is reached. Rows that repeat an id are kept. An empty table gives an empty result.
    """
    prints = stage(fingerprints(docs, id_col, text_col))
    least = stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    roots = components(stage(linked_fingerprints(least.select("fingerprint")).distinct()))
    member = least.join(roots, least["fingerprint"] == roots["node"], "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    member = stage(member)
    class_ids = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # Written, so that the join below shuffles both sides and Spark can split a frequent fingerprint.
    groups = stage(member.join(class_ids, "root").select("fingerprint", "component_id"))
    return prints.join(groups, "fingerprint").select(F.col("doc_id").alias(id_col), "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the least id of each group, with all their columns; rows with a null id alone in their group stay."""
    found = near_groups(docs, id_col, text_col)
    return without_ids(docs, id_col, found.select(F.col(id_col).alias("_id"), F.col(id_col).eqNullSafe(F.col("component_id")).alias("_stays")))
