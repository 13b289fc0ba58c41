"""Bounded-space online packing of documents into sequences of a fixed length.

Each partition keeps a fixed number of open windows. The rest of a document beyond its full sequences goes whole into
the window that it fits best. If it fits in none, the fullest window is completed with the head of the piece (or, with
almost no room left, padded), emitted and replaced by an empty one. What is open at a partition's end is packed again,
best fit and longest piece first, together with that of neighbouring partitions.

A task holds one batch of texts and OPEN windows of piece records, whatever the size of the input. The records are
written once to the shared folder, so that both parts of the result come from the same run of every task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.held import held
from panelwright.llm.ship import map_arrow, slices
from panelwright.session import stage

LENGTH = 1024
OPEN = 32
#: A window with less room is padded and not completed by a cut.
CUT_FROM = 16
#: Neighbouring partitions whose open windows meet in one group: at most MERGED * OPEN * LENGTH records of some 50 bytes.
MERGED = 32
#: Bytes of texts that are Python strings and encoded at a time; a longer text goes alone.
SLICE_BYTES = 1 << 20

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """Open windows by the room that is left. A window is a list of (piece, length)."""

    def __init__(self, length: int):
        self.length = length
        self.rooms: list[tuple[int, int]] = []
        self.content: dict[int, list] = {}
        self.made = 0

    def open(self) -> int:
        self.content[self.made] = []
        self.made += 1
        insort(self.rooms, (self.length, self.made - 1))
        return self.made - 1

    def best(self, need: int) -> int | None:
        """Position of the window with the least room that is enough."""
        at = bisect_left(self.rooms, (need, -1))
        return at if at < len(self.rooms) else None

    def put(self, at: int, piece, length: int) -> list | None:
        """The window's content if it is full now."""
        room, window = self.rooms.pop(at)
        self.content[window].append((piece, length))
        if room == length:
            return self.content.pop(window)
        insort(self.rooms, (room - length, window))
        return None

    def fullest(self) -> tuple[int, list]:
        room, window = self.rooms[0]
        return room, self.content[window]

    def close_fullest(self) -> list:
        return self.content.pop(self.rooms.pop(0)[1])


def _pieces(table_schema: pa.Schema, path: str | None, length: int, windows: int, cut_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from panelwright.llm.tokens import encoder

        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        space, sequences, rows = Windows(length), 0, []
        for _ in range(windows):
            space.open()

        def emit(content: list) -> None:
            nonlocal sequences
            offset = 0
            for piece, n in content:
                rows.append((*piece, (part << 32) + sequences, offset, False, part))
                offset += n
            sequences += 1

        def taken() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in table_schema]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, table_schema, strict=True)], schema=table_schema)

        def place(doc, ids: bytes) -> None:
            total = len(ids) // 4
            piece = lambda a, b: (doc, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), total)
            at = total - total % length
            for a in range(0, at, length):
                emit([(piece(a, a + length), length)])
            while at < total:
                if (i := space.best(total - at)) is None:
                    room, content = space.fullest()
                    if room >= cut_from:
                        content.append((piece(at, at + room), room))
                        at += room
                    emit(space.close_fullest())
                    space.open()
                    continue
                full = space.put(i, piece(at, total), total - at)
                if full is not None:
                    emit(full)
                    space.open()
                at = total

        for batch in batches:
            for b, texts in slices(batch, 1, SLICE_BYTES):
                for doc, ids in zip(b.column(0).to_pylist(), encode(texts), strict=True):
                    place(doc, ids + b"\0\0\0\0")
            if rows:
                yield taken()
        for content in space.content.values():
            rows += [(*piece, None, None, True, part) for piece, _ in content]
        yield taken()

    return run


def _merge(schema: pa.Schema, length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held("packing, merging", dict)  # the encoder is done with
        space, done = Windows(length), []
        pieces = [tuple(r[c] for c in table.column_names[:5]) for r in table.select(table.column_names[:5]).to_pylist()]
        pieces.sort(key=lambda p: (-p[2], p[0] is None, p[0] if p[0] is not None else 0, p[1], p[3]))
        for p in pieces:
            at = space.best(p[2])
            if at is None:
                space.open()
                at = space.best(p[2])
            full = space.put(at, p, p[2])
            if full is not None:
                done.append(full)
        rows = []
        for k, content in enumerate([*done, *space.content.values()]):
            offset = 0
            for piece, n in content:
                rows.append((*piece, (1 << 62) + (key[0].as_py() << 32) + k, offset))
                offset += n
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    length: int = LENGTH,
    windows: int = OPEN,
    cut_from: int = CUT_FROM,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and one id 0; a null or empty text is that one id. Rows that repeat an id are packed one
    by one. Null ids are kept. Other columns are not read. An empty table gives an empty result. `tokenizer` is the path
    of a tokenizer file that every executor can open; None is the public 50k byte-level one. Padding is what a sequence
    lacks to `length`; sequences are never longer.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = StructType([source.schema["doc_id"], *StructType.fromDDL(PIECE), *StructType.fromDDL("open boolean, part long")])
    pieces = stage(map_arrow(source, _pieces(to_arrow_schema(out), tokenizer, length, windows, cut_from), out))
    names = ["doc_id", *StructType.fromDDL(PIECE).names]
    merged_type = StructType([out[n] for n in names])
    rest = pieces.where("open").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.floor(F.col("part") / MERGED).alias("near"))
    merged = rest.groupBy("near").applyInArrow(_merge(to_arrow_schema(merged_type), length), merged_type)
    return pieces.where("not open").select(names).unionByName(merged).withColumnRenamed("doc_id", id_col)
