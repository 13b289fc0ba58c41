"""Benchmark decontamination by spaced seeds.

A mask names the token positions of a window that count; the others are ignored, so a substituted word there does not
break the match. Hashes of the masked tokens of every benchmark window meet those of every document window in a join.
A hit fixes the alignment of a document with an item, and the words around it are compared: an overlap is a run of
WINDOW item words (all words of a shorter item) of which at least SIMILARITY agree in place.

Only DataFrame and SQL functions are used. Where the seeds can be broadcast no document leaves its partition, only the
words beside an item. Beyond that the positions of seeds are shuffled, less those that a Bloom filter of the items' seeds
excludes, and the documents that were hit are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.decided import without_ids
from panelwright.session import stage

#: Masks as offsets of the words that count: five words each, among eight.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 3, 5, 7), (0, 1, 4, 5, 7))
SPAN = 8
#: The three masks leave some substitutions unseen where an item has few windows (8 and 10 words); seven words in a row see them.
RUN = tuple(range(7))
WINDOW = 13
SIMILARITY = 0.8
#: Items with fewer words are no passage.
LEAST_WORDS = 5
#: Bytes of seed rows, or of items, that may be broadcast; beyond that Spark joins by shuffling.
BROADCAST_BYTES = 64 << 20
#: Bytes that a seed, and a block of the filter of seeds, take when broadcast; seeds that share a block, on average.
SEED_BYTES, BLOCK_BYTES, SEEDS_IN_BLOCK = 96, 600, 256
#: Window positions of a text that are looked at together.
PIECE = 1024


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null gives an empty array."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(tokens: DataFrame, column: str, span: int, masks: tuple) -> DataFrame:
    """The rows with `seed`, one for each mask and each position `pos` at which a window of `span` words begins.

    Positions are unfolded before they are hashed, so that hashing, and the join above it, run in compiled code and the
    words are copied for hits only. The outer form keeps Spark from splitting the text once more to test for emptiness.
    """
    array = F.col(column)
    placed = tokens.select("*", F.posexplode_outer(array).alias("pos", "_word")).where(F.col("pos") <= F.size(array) - span)
    hashes = [F.xxhash64(F.lit(k), *[F.get(array, F.col("pos") + o) for o in mask]) for k, mask in enumerate(masks)]
    return placed.select("*", F.explode(F.array(*hashes)).alias("seed")).drop("_word")


def _pieces(texts: DataFrame, span: int, longest: int, piece: int) -> DataFrame:
    """The rows of (key, doc_id, doc) in pieces of `piece` window positions: key, doc_id, lead, own, words.

    `words` begins at word `lead` of the text; the piece's own positions begin at `own` in it. Before and after them stand
    as many words as the longest item has, so that all that an item may lie beside is at hand. What a task holds for one row
    is bounded by the piece, not by the text: compiled code keeps all that comes of a row until the row is done.
    """
    start = F.sequence(F.lit(0), F.greatest(F.size("doc") - span, F.lit(0)), F.lit(piece))
    lead = lambda s: F.greatest(s - longest, F.lit(0))
    cut = F.transform(start, lambda s: F.struct(lead(s).alias("lead"), (s - lead(s)).alias("own"), F.slice("doc", lead(s) + 1, s - lead(s) + piece + span + longest).alias("words")))
    return texts.select("key", "doc_id", F.explode(cut).alias("_piece")).select("key", "doc_id", "_piece.*")


def _doc_seeds(texts: DataFrame, span: int, masks: tuple, longest: int, piece: int) -> DataFrame:
    """_seeds of the pieces, each position in the one piece that owns it."""
    seeds = _seeds(_pieces(texts, span, longest, piece), "words", span, masks)
    return seeds.where((F.col("pos") >= F.col("own")) & (F.col("pos") < F.col("own") + piece))


def _beside(words: str | Column, shift: Column, lead: Column, length: Column) -> Column:
    """The words beside an item's that lies at `shift`, without those before the text."""
    return F.slice(words, F.greatest(shift, F.lit(0)) - lead + 1, length)


def _bits() -> list[Column]:
    """Places 0 to 4095 of a seed's bits in its block, from bits of the seed that do not choose the block alone."""
    return [F.shiftrightunsigned("seed", k).bitwiseAND(F.lit(4095)).cast("int") for k in (28, 40, 52)]


def _blocks(seeds: DataFrame, blocks: int) -> DataFrame:
    """A Bloom filter of the seeds as rows (block, bits): 64 words of 64 bits."""
    set_bits = seeds.select(F.pmod("seed", F.lit(blocks)).alias("block"), F.explode(F.array(*_bits())).alias("bit"))
    by_word = set_bits.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))
    found = by_word.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    return found.select("block", F.expr("transform(sequence(0, 63), w -> coalesce(found[w], 0L))").alias("bits"))


def _maybe(found: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """The rows whose seed may be one of those that `blocks` was made of; all that are stay."""
    hit = F.pmod(found["seed"], F.lit(n)) == blocks["block"]
    for k in (28, 40, 52):
        bit = f"int(shiftrightunsigned(seed, {k}) & 4095)"
        hit = hit & F.expr(f"shiftright(get(bits, shiftright({bit}, 6)), {bit} & 63) & 1L = 1L")
    return found.join(F.broadcast(blocks), hit, "left_semi")


def _masks(words: int) -> tuple:
    """The masks for items of so many words (WINDOW: or more), each from the first word that counts.

    With them every overlap by WINDOW and SIMILARITY shares a seed, also where the document begins or ends within the
    item. Items of 5 to 7 words take all ways to leave one word out.
    """
    if words >= SPAN:
        return MASKS if words >= WINDOW else (*MASKS, RUN)
    kept = [[o for o in range(words) if o != left] for left in range(words)]
    return tuple(sorted({tuple(o - k[0] for o in k) for k in kept}))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per (id, item_id) that overlap: first_word and last_word of the document, matched (most agreeing words in a window), windows.

    Word positions count from 0. `windows` is the number of different overlapping windows. Null and empty texts
    overlap nothing; rows that repeat an id (or have none) count as one document. Empty tables give an empty result.
    """
    items = stage(
        benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("item"))
        .select("item_id", F.transform("item", lambda w: F.xxhash64(w)).alias("item"), F.size("item").alias("item_words"))
        .where(F.col("item_words") >= LEAST_WORDS)
        .distinct()
        .withColumn("item_key", F.monotonically_increasing_id())
    )
    # Items that take the same masks go together: each number of words under SPAN, from SPAN to WINDOW, the others.
    kind = F.when(F.col("item_words") < SPAN, F.col("item_words")).when(F.col("item_words") < WINDOW, SPAN).otherwise(WINDOW)
    by_kind = items.groupBy(kind.alias("kind")).agg(F.max("item_words"), F.sum(F.col("item_words") * 8 + 64)).collect()
    if not by_kind:
        return docs.where("false").select(F.col(id_col), *[F.lit(None).cast(t).alias(c) for c, t in [("item_id", benchmark.schema[item_col].dataType), *((n, "long") for n in ("first_word", "last_word", "matched", "windows"))]])
    longest = max(r[1] for r in by_kind)
    piece = max(PIECE, longest)
    all_items = F.broadcast(items) if sum(r[2] for r in by_kind) <= broadcast_bytes else items
    # The key stands for a text with its id. Should two have the same, each is compared at the other's places as well.
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("doc")
    texts = plain.select("key", "doc_id", hashed)
    met, far = [], []
    spans: dict[tuple, list] = {}
    for k in (r[0] for r in by_kind):
        for mask in _masks(k):
            spans.setdefault((mask[-1] + 1, mask), []).append(k)
    groups: dict[tuple, list] = {}
    for (span, mask), of in spans.items():
        groups.setdefault((span, tuple(sorted(of))), []).append(mask)
    shift = F.col("lead") + F.col("pos") - F.col("item_pos")
    for (span, of), masks in sorted(groups.items()):
        seeds = stage(_seeds(items.where(kind.isin(*of)), "item", span, tuple(masks)).select("seed", "item_key", F.col("pos").alias("item_pos"), "item_words"))
        found = _doc_seeds(texts, span, tuple(masks), longest, piece)
        n = seeds.count()
        if n * SEED_BYTES <= broadcast_bytes:
            # An overlap is hit by most of its windows: one row of them is compared.
            hits = found.join(F.broadcast(seeds), "seed")
            met.append(hits.select("doc_id", "item_key", shift.alias("shift"), _beside("words", shift, F.col("lead"), F.col("item_words")).alias("beside")).distinct())
            continue
        narrow = found.select("key", (F.col("lead") + F.col("pos")).alias("pos"), "seed")
        blocks = n // SEEDS_IN_BLOCK + 1
        if blocks * BLOCK_BYTES <= broadcast_bytes:
            narrow = _maybe(narrow, stage(_blocks(seeds, blocks)), blocks)
        far.append(narrow.join(seeds, "seed").select("key", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_words"))
    if far:
        # The words are read again, for the texts with a hit.
        places = reduce(DataFrame.unionByName, far).distinct().groupBy("key").agg(F.collect_list(F.struct("item_key", "shift", "item_words")).alias("places"))
        again = plain.join(places, "key").select("doc_id", "places", hashed)
        beside = F.transform("places", lambda h: F.struct(h["item_key"].alias("item_key"), h["shift"].alias("shift"), _beside("doc", h["shift"], F.lit(0), h["item_words"]).alias("beside")))
        met.append(again.select("doc_id", F.explode(beside).alias("_place")).select("doc_id", "_place.*"))
    aligned = reduce(DataFrame.unionByName, met).join(all_items, "item_key")
    # 1 where the item's words agree with those beside them.
    same = F.expr("transform(item, (w, i) -> if(i + least(shift, 0) >= 0 and get(beside, i + least(shift, 0)) = w, 1, 0))")
    length = F.least(F.lit(window), F.col("item_words"))
    need = F.ceil(length * F.lit(similarity) - 1e-9)
    ones = F.aggregate("same", F.lit(0), lambda s, x: s + x)
    counted = aligned.select("doc_id", "item_id", "shift", same.alias("same"), length.alias("length"), need.alias("need"))
    # Random hits end at the first test. It is no filter of its own: as one it would be drawn into the join and stop its compilation.
    counts = F.expr("transform(sequence(1, size(same) - length + 1), s -> struct(s - 1 as first, aggregate(slice(same, s, length), 0, (n, x) -> n + x) as matched))")
    overlapping = F.when(ones >= F.col("need"), F.filter(counts, lambda c: c["matched"] >= F.col("need")))
    good = counted.select("doc_id", "item_id", "shift", "length", F.explode(overlapping).alias("w")).distinct()
    return good.groupBy(F.col("doc_id").alias(id_col), "item_id").agg(
        F.min(F.col("w.first") + F.col("shift")).cast("long").alias("first_word"),
        F.max(F.col("w.first") + F.col("shift") + F.col("length") - 1).cast("long").alias("last_word"),
        F.max("w.matched").cast("long").alias("matched"),
        F.count("*").alias("windows"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any overlap, with all their columns."""
    hit = overlaps(docs, benchmark, id_col, text_col)
    return without_ids(docs, id_col, hit.select(F.col(id_col).alias("_id"), F.lit(False).alias("_stays")))
