"""Fuzzy line deduplication.

Lines are normalised (lower case, letters and digits only, each digit as 0). Equal normalised lines are counted
together first. Of the different ones the SimHash over words is cut into blocks; lines that agree in a choice of
blocks meet in a bucket, by the pigeonhole principle all pairs within DISTANCE bits do. Pairs within that distance
whose edit similarity reaches SIMILARITY are links. Of each connected group of lines one occurrence stays, the first by
document id and line number.

In a bucket each line is compared with the NEAR lines before it and with the least one; that is all pairs of a bucket
of up to NEAR lines. A larger bucket is never paired off with itself: what these links do not already connect is looked
up in a second step, in which only members outside the bucket's largest group seek partners in other groups. The links
found so connect the same groups as all links do.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from panelwright.llm.components import components
from panelwright.llm.held import held
from panelwright.llm.ship import map_arrow, slices, strings
from panelwright.session import stage

DISTANCE = 3
BLOCKS = 5
SIMILARITY = 0.8
#: Lines before it that a bucket's line is compared with.
NEAR = 8
#: Short words are in most lines and would draw all fingerprints together. They count only where fewer than
#: LEAST_FEATURES others are there.
SHORT = 3
LEAST_FEATURES = 5
#: Bytes of line numbers or line ids that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes of texts that are cut into lines at a time; a longer text goes alone.
SLICE_BYTES = 1 << 20


@cache
def _normal_codes() -> np.ndarray:
    """For each code point what it becomes: ASCII digits 0, other letters and digits themselves, marks and white space a space."""
    kept = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    codes = np.where(kept, np.arange(0x110000, dtype="<u4"), np.uint32(32))
    codes[48:58], codes[10] = 48, 10
    return codes


def _normal_lines(texts: list[str]) -> pa.Array:
    """The normalised lines of all texts, one after the other, empty ones too; a text has one more than line feeds."""
    codes = _normal_codes()[np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = np.concatenate(([True], codes <= 32))  # spaces and line feeds; before the first character, too
    codes = codes[~(gap[:-1] & (codes == 32))]  # of each run of spaces the first, none at a line's beginning
    end = np.append(codes[1:] == 10, True)
    raw = codes[~(end & (codes == 32))].tobytes().decode("utf-32-le", "surrogatepass").encode()
    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    raw = raw.replace(b"\n", b"")
    offsets = np.concatenate(([0], feeds - np.arange(len(feeds)), [len(raw)])).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw))


def normal_lines(text: str) -> list[str]:
    return _normal_lines([text]).to_pylist()


def line_features(line: str) -> list[str]:
    words = line.split(" ")
    long = [w for w in words if len(w) > SHORT]
    return long if len(long) >= LEAST_FEATURES else words


#: For each byte its bits, one in each byte of a word of eight: eight additions count a word's 64 bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0].copy()


def _features(lines: pa.Array | list[str]) -> tuple[pa.Array, np.ndarray]:
    """line_features of all lines, one after the other, and how many each line has."""
    parts = pc.split_pattern(lines if isinstance(lines, pa.Array) else pa.array(lines, pa.string()), " ")
    words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    long = pc.greater(pc.utf8_length(words), SHORT).to_numpy(zero_copy_only=False)
    keep = long | (np.bincount(owner[long], minlength=len(lines)) < LEAST_FEATURES)[owner]
    return words.filter(pa.array(keep)), np.bincount(owner[keep], minlength=len(lines))


def simhashes(lines: pa.Array | list[str]) -> np.ndarray:
    """Signed 64-bit SimHash over the features of normalised, non-empty lines. Each different word is hashed once."""
    if not len(lines):
        return np.zeros(0, np.int64)
    from xxhash import xxh64_digest

    words, counts = _features(lines)
    coded = words.cast(pa.binary()).dictionary_encode()
    hashes = np.frombuffer(b"".join(map(xxh64_digest, strings(coded.dictionary))), ">u8").astype("<u8")
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)].take(coded.indices.to_numpy(), axis=0)
    # A byte counts to 255, so longer lines are counted in several parts.
    parts = -(-counts // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(counts) - counts - 255 * first, parts) + 255 * np.arange(parts.sum())
    ones = np.add.reduceat(spread, starts, axis=0).view(np.uint8).reshape(-1, 64)
    if len(starts) > len(lines):
        ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
    return np.packbits(ones > (counts // 2)[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line_id, simhash, line) of every line that has a letter or digit; lines end at line feeds."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    kind = StructType([source.schema["doc_id"], StructField("line_no", IntegerType()), StructField("line_id", LongType()), StructField("simhash", LongType()), StructField("line", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_digest

        held("line_dedup", dict)  # other operators' tables are done with
        for batch in batches:
            for b, texts in slices(batch, 1, SLICE_BYTES):
                counts = np.array([t.count("\n") + 1 for t in texts])
                lines = _normal_lines(texts)
                at = np.flatnonzero(pc.binary_length(lines).to_numpy())
                owner, lines = np.repeat(np.arange(len(texts)), counts)[at], lines.take(pa.array(at))
                numbers = at - (np.cumsum(counts) - counts)[owner]
                ids = np.frombuffer(b"".join(map(xxh3_64_digest, strings(lines.cast(pa.binary())))), ">i8").astype(np.int64)
                columns = [b.column(0).take(pa.array(owner)), pa.array(numbers.astype(np.int32)), pa.array(ids), pa.array(simhashes(lines)), lines]
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return map_arrow(source, run, kind)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 where it is larger: common ends are cut off, the rest goes through bit vectors."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    low, high = 0, min(len(a), len(b))
    while low < high:  # longest common beginning by halving
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return min(most + 1, max(len(a), len(b)))
    full, top, masks = (1 << len(a)) - 1, 1 << (len(a) - 1), {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    plus, minus, distance = full, 0, len(a)
    for i, c in enumerate(b):
        eq = masks.get(c, 0)
        x = eq | minus
        eq |= ((eq & plus) + plus) ^ plus
        up, down = minus | ~(eq | plus) & full, plus & eq
        distance += bool(up & top) - bool(down & top)
        if distance - (len(b) - 1 - i) > most:
            return most + 1
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(x | up)) & full, up & x
    return distance


def edits_by_words(a: str, b: str, most: int) -> int:
    """Edits that turn a into b word by word, so never fewer than edit_distance; above `most` counting stops.

    A word is replaced, left out or put in, whichever makes the next words agree.
    """
    x, y = [*a.split(" "), None], [*b.split(" "), None]
    i = j = edits = 0
    while (p := x[i]) is not None and (q := y[j]) is not None:
        if p != q:
            # A word that is left out or put in counts with its space.
            if x[i + 1] == y[j + 1]:
                edits += max(len(p), len(q))
            elif x[i + 1] == q:
                edits += len(p) + 1
                j -= 1
            elif p == y[j + 1]:
                edits += len(q) + 1
                i -= 1
            else:
                edits += max(len(p), len(q))
            if edits > most:
                return edits
        i += 1
        j += 1
    return edits + sum(len(w) + 1 for w in (*x[i:-1], *y[j:-1]))


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    most = int((1 - similarity) * longest + 1e-9)
    return edits_by_words(a, b, most) <= most or edit_distance(a, b, most) <= most


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _choices(blocks: int, distance: int) -> list[int]:
    """Bit masks (as signed longs) of all choices of blocks that stay intact within the distance."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in c) for c in itertools.combinations(range(blocks), blocks - distance)]
    return [m - (m >> 63 << 64) for m in masks]


def _key(k: int, mask: int, simhash: Column) -> Column:
    return F.xxhash64(F.lit(k), simhash.bitwiseAND(F.lit(mask).cast("long")))


def _bucket_keys(simhash: Column, blocks: int, distance: int) -> Column:
    """One key for each choice of blocks that may all be intact: its number mixed with the blocks' bits."""
    return F.array(*[_key(k, m, simhash) for k, m in enumerate(_choices(blocks, distance))])


def _first_key(s: Column, t: Column, blocks: int, distance: int) -> Column:
    """The first key that two lines share: a pair is taken in that bucket only."""
    apart = s.bitwiseXOR(t)
    return F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, _key(k, m, s)) for k, m in enumerate(_choices(blocks, distance))])


def _small(df: DataFrame, row_bytes: int) -> bool:
    return df.count() * row_bytes <= BROADCAST_BYTES


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v, further longs) whose lines are similar. Texts of lines without a candidate are left where they are if the ids are few."""
    ids = pairs.select(F.col("u").alias("line_id")).union(pairs.select("v"))
    wanted = lines.select("line_id", "line").join(F.broadcast(ids) if _small(pairs, 32) else ids.distinct(), "line_id", "left_semi")
    # One text of each line: a copy of a frequent line is as good as another.
    texts = wanted.groupBy("line_id").agg(F.max("line").alias("line"))
    both = pairs.join(texts.select(F.col("line_id").alias("u"), F.col("line").alias("a")), "u").join(texts.select(F.col("line_id").alias("v"), F.col("line").alias("b")), "v").select(*pairs.columns, "a", "b")
    kind = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("line_dedup", dict)
        for b in batches:
            keep = [similar(x, y, similarity) for x, y in zip(strings(b.column("a")), strings(b.column("b")), strict=True)]
            yield b.select(kind.names).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, kind)


def _order(id_col: str = "doc_id") -> Column:
    """Occurrences in order: ids first to last, none at the end, then line numbers."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("doc_id"), F.col("line_no"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS, similarity: float = SIMILARITY, near: int = NEAR) -> DataFrame:
    """(id, lines array<int>): the line numbers of each document, from 0, that repeat a line kept elsewhere or before."""
    lines = stage(lines_of(docs, id_col, text_col))
    every = stage(lines.groupBy("line_id", "simhash").agg(F.min(_order()).alias("first"), F.count("*").alias("n")))

    keyed = every.select("line_id", "simhash", F.explode(_bucket_keys(F.col("simhash"), blocks, distance)).alias("key"))
    met = keyed.select("*", F.expr("min(struct(line_id, simhash)) over (partition by key)").alias("least"), F.expr("count(*) over (partition by key)").alias("size")).where("size > 1")
    before = F.expr(f"collect_list(struct(line_id, simhash)) over (partition by key order by line_id rows between {near} preceding and 1 preceding)")
    close = F.filter(F.array_union("before", F.array("least")), lambda x: (x["line_id"] != F.col("line_id")) & _near(F.col("simhash"), x["simhash"], distance))
    # Written in one go: the candidate pairs (u, v), and the rows of large buckets (key, u, s).
    pair = F.transform(close, lambda x: F.struct(F.lit(None).cast("long").alias("key"), F.col("line_id").alias("u"), x["line_id"].alias("v"), F.col("simhash").alias("s")))
    large = F.when(F.col("size") > near, F.array(F.struct(F.col("key"), F.col("line_id").alias("u"), F.lit(None).cast("long").alias("v"), F.col("simhash").alias("s"))))
    both = met.withColumn("before", before).select(F.explode(F.concat(pair, F.coalesce(large, F.array()))).alias("x")).select("x.*")
    both = stage(both)
    first_pairs = stage(both.where("v is not null").select("u", "v").distinct())
    buckets = both.where("key is not null").select("key", F.col("u").alias("line_id"), F.col("s").alias("simhash"))
    links = stage(_verified(first_pairs, lines, similarity))
    found = stage(components(links))

    # Large buckets that hold several groups: members outside the largest one look for partners in the others.
    grouped = buckets.join(found, buckets["line_id"] == found["node"], "left").select("key", "line_id", "simhash", F.coalesce("root", "line_id").alias("group"))
    sizes = grouped.groupBy("key", "group").agg(F.count("*").alias("members"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("members", "group")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    mixed = stage(grouped.join(largest, "key").select("key", "line_id", "simhash", "group", F.col("most.group").alias("largest")))
    seekers = mixed.where("group <> largest").select("key", F.col("line_id").alias("u"), F.col("simhash").alias("s"), F.col("group").alias("g"), "largest")
    partners = mixed.select("key", F.col("line_id").alias("v"), F.col("simhash").alias("t"), F.col("group").alias("h"))
    once = (F.col("h") == F.col("largest")) | (F.col("u") < F.col("v"))
    once = once & (F.col("key") == _first_key(F.col("s"), F.col("t"), blocks, distance))
    across = seekers.join(partners, "key").where((F.col("g") != F.col("h")) & _near(F.col("s"), F.col("t"), distance) & once)
    second_pairs = stage(across.select("u", "v", "g", "h").distinct())

    marked = every.join(found, every["line_id"] == found["node"], "left").select("line_id", "simhash", "first", "n", "root")
    if not second_pairs.isEmpty():
        # These links join whole groups, so only groups are nodes now; a line without a group is one of its own.
        second_links = stage(_verified(second_pairs, lines, similarity).select(F.col("g").alias("u"), F.col("h").alias("v")))
        merged = stage(components(second_links)).withColumnsRenamed({"node": "part", "root": "whole"})
        side = F.broadcast(merged) if _small(merged, 32) else merged
        marked = marked.join(side, F.coalesce("root", "line_id") == F.col("part"), "left").withColumn("root", F.coalesce("whole", "root"))
    marked = stage(marked.where("n > 1 or root is not null").select("line_id", "simhash", "first", F.coalesce("root", "line_id").alias("group")))
    kept = marked.groupBy("group").agg(F.min("first").alias("kept"))
    copies = stage(marked.join(kept, "group").select("line_id", "simhash", "kept"))
    side = F.broadcast(copies) if _small(copies, 64) else copies
    occurrences = lines.select("doc_id", "line_no", "line_id", "simhash").join(side, ["line_id", "simhash"])
    removed = occurrences.where(_order() != F.col("kept"))
    return removed.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("lines")).withColumnRenamed("doc_id", id_col)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """All rows and columns of `docs`, texts without their repeated lines, and `_n_removed` (lines cut from the row).

    Lines without a letter or digit stay as they are. A text may become empty; a null text stays null. Rows that share
    an id (or have none) count as one document: their lines of the same number are one occurrence.
    """
    gone = stage(repeated_lines(docs, id_col, text_col, **settings).withColumnsRenamed({id_col: "_gone_id", "lines": "_gone"}))
    size = gone.agg(F.coalesce(F.sum(F.size("_gone") + 8), F.lit(0)) * 8).first()[0]
    joined = docs.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, F.col(id_col).eqNullSafe(F.col("_gone_id")), "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    removed = F.coalesce(F.size("_gone"), F.lit(0))
    return joined.withColumn("_n_removed", F.when(F.col(text_col).isNull() | F.col("_gone").isNull(), 0).otherwise(removed).cast("long")).withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(left)).drop("_gone_id", "_gone")
