"""Licence scans: text blocks compared with licence notices by the Dice coefficient over word bigrams.

Blocks are runs of consecutive lines of a text, the whole text included. A notice is a candidate for a block only if
their numbers of bigrams allow a coefficient of SIMILARITY; blocks are grown only while that can still be so. Of
overlapping matches the best stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from panelwright.llm.licence_texts import NOTICES
from panelwright.llm.ship import map_arrow

SIMILARITY = 0.8

_WORDS = re.compile(r"[^\W_]+(?:\.[0-9]+)*").findall


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


@dataclass
class Notices:
    """Notices in order of their sizes (numbers of bigrams, repeats included)."""

    names: list[str]
    counts: list[Counter]
    sizes: list[int]
    known: frozenset
    similarity: float

    @classmethod
    def of(cls, notices: list[tuple[str, str]], similarity: float = SIMILARITY) -> Notices:
        rows = sorted(((sum(c.values()), name, i, c) for i, (name, text) in enumerate(notices) if (c := Counter(bigrams(_WORDS(text.lower()))))), key=lambda r: r[:3])
        return cls([r[1] for r in rows], [r[3] for r in rows], [r[0] for r in rows], frozenset(b for r in rows for b in r[3]), similarity)

    def best(self, block: Counter, size: int) -> tuple[float, str] | None:
        """The notice with the highest coefficient, ties by name. 2 min / (a + b) bounds it by sizes alone."""
        ratio = self.similarity / (2 - self.similarity)
        low, high = bisect_left(self.sizes, ratio * size - 1e-9), bisect_right(self.sizes, size / ratio + 1e-9)
        found = None
        for i in range(low, high):
            count = self.counts[i]
            shared = sum(min(n, block[b]) for b, n in count.items() if b in block)
            dice = 2 * shared / (size + self.sizes[i])
            if dice >= self.similarity - 1e-12 and (found is None or (-dice, self.names[i]) < (-found[0], found[1])):
                found = dice, self.names[i]
        return found


def matches(text: str, notices: Notices) -> list[tuple[str, float, int, int]]:
    """(licence, dice, first_line, last_line) of the blocks that match, lines counted from 0; no two share a line."""
    if not notices.sizes:
        return []
    known, largest = notices.known, notices.sizes[-1]
    lines = [_WORDS(line) for line in text.lower().split("\n")]
    # Bigrams of a line, its first one reaching back to the last word before it.
    last, hits, own = None, [], []
    for words in lines:
        pairs = bigrams(words)
        lead = (last, words[0]) if last and words else None
        own.append((lead, pairs))
        hits.append(sum(p in known for p in pairs))
        last = words[-1] if words else last
    # Of a matching block at least this share of bigrams is in notices, and it has at most this many.
    share = notices.similarity / (2 - notices.similarity) if notices.similarity < 1 else 1.0
    most = largest / share
    found = []
    for i, first in enumerate(hits):
        if not first:
            continue
        block: Counter = Counter()
        size = inside = 0
        for j in range(i, len(lines)):
            lead, pairs = own[j]
            if j > i and lead:
                block[lead] += 1
                size += 1
                inside += lead in known
            block.update(pairs)
            size += len(pairs)
            inside += hits[j]
            if size - inside > most * (1 - share) + 1e-9 or size > most + 1e-9:
                break
            if hits[j] and inside >= share * size * notices.similarity - 1e-9 and (best := notices.best(block, size)):
                found.append((best[1], best[0], i, j))
    found.sort(key=lambda m: (-m[1], m[2], m[3], m[0]))
    kept: list[tuple[str, float, int, int]] = []
    taken: set[int] = set()
    for m in found:
        rows = range(m[2], m[3] + 1)
        if taken.isdisjoint(rows):
            taken.update(rows)
            kept.append(m)
    return sorted(kept, key=lambda m: m[2])


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str]] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """One row per match: id, licence, dice, first_line, last_line.

    Null and empty texts match nothing. Rows that repeat an id are scanned one by one, null ids are kept, other columns
    are not read. Ties go to the name that sorts first. An empty table gives an empty result.
    """
    known = Notices.of(NOTICES if notices is None else notices, similarity)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    kind = StructType([source.schema["doc_id"], StructField("licence", StringType()), StructField("dice", DoubleType()), StructField("first_line", IntegerType()), StructField("last_line", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for m in matches(text, known):
                    owners.append(i)
                    rows.append(m)
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owners, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=kind.names)

    return map_arrow(source, run, kind).withColumnRenamed("doc_id", id_col)
