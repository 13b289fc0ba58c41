"""Language-model scores of whole texts.

The model is a hashed maximum-entropy model. Frequent words are symbols of their own, all others share a few symbols by
their beginnings, within which they are told apart by smoothed counts. Symbols are factored into classes: one softmax
over classes, one over the symbols of the class. The features of a position are the word before it, the words two and
three before it (skips) and the pair before it, hashed into rows of two weight tables; zero weights are the unigram
model. Training goes in rounds: each task updates a copy of the weights on its documents of the round, Spark averages
the changed rows, and the next round starts from there. Together the rounds read every training document.

Counts are taken over all training documents. Only the most frequent words are broadcast, up to a fixed number; the
counts of the others meet their occurrences in a join. Each text is turned into symbols once, two bytes a token; these
are written to the shared folder, and all rounds and the scoring read them from there.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from panelwright.llm.ship import map_arrow
from panelwright.session import stage

CLASS = 64
CLASSES = 64
#: Symbols for words by their beginnings; the last class.
SHARED = CLASS
SYMBOLS = CLASS * CLASSES
OWN = SYMBOLS - SHARED
#: Stands before the first word.
START = SYMBOLS
#: Words whose counts are broadcast.
HEAD = 100_000
#: Rows of the weight tables, powers of two.
CLASS_ROWS = 1 << 14
WORD_ROWS = 1 << 16
#: Each round trains on the training documents of one of SLICES hash slices. There are as many rounds as slices at least,
#: so that every training document is read.
ROUNDS = 3
SLICES = 3
RATE = 0.3
#: Tokens of an update, tokens that are padded at once, bytes of text that are cut into tokens at once, and tokens that a
#: worker holds before it counts them.
BATCH = 8_192
ENCODED = 32 * BATCH
BYTES = 2_000_000
HELD = 2_000_000
#: Groups in which changed rows are averaged.
GROUPS = 64
#: Tokens and rows that are computed with at a time, so that they stay in a core's cache, and rows that are added up in
#: one step.
CACHED = 1_024
FAN = 8
SMOOTHING = 0.1
END = b" "


def remainder(id_col: Column, divisor: int = 10) -> Column:
    """crc32 of the id as text (null: empty text), modulo."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % divisor


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


def shared_symbol(word: bytes) -> int:
    return OWN + zlib.crc32(word[:2]) % SHARED


@cache
def _shared_symbols() -> np.ndarray:
    """Shared symbols of the words that begin with a byte and end there (256), and of those that begin with two bytes."""
    one = [bytes([a]) for a in range(256)]
    return np.array([shared_symbol(w) for w in [*one, *(a + b for a in one for b in one)]], np.int64)


def shared_symbols(words: pa.Array) -> np.ndarray:
    """shared_symbol of each word (binary, none empty)."""
    if not len(words):
        return np.zeros(0, np.int64)
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    long = np.diff(starts) > 1
    key = data[starts[:-1]].astype(np.int64)
    key[long] = 256 + 256 * key[long] + data[starts[:-1][long] + 1]
    return _shared_symbols()[key]


def tokens_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """tokens_of for all texts: the tokens one after the other, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(words), 0)
    words = words.filter(real).cast(pa.binary())
    sizes = np.bincount(owner.filter(real).to_numpy(), minlength=len(texts)).astype(np.int64) + 1
    at, word = np.full(sizes.sum(), len(words)), np.ones(sizes.sum(), bool)
    word[np.cumsum(sizes) - 1] = False
    at[word] = np.arange(len(words))
    return pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(at)), sizes


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of little more than BYTES bytes of text."""
    ends, first = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)), 0
    while first < batch.num_rows:
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BYTES)), first) + 1
        yield batch.slice(first, last - first)
        first = last


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token binary, c) over all rows of (text)."""
    kind = StructType.fromDDL("token binary, c long")

    def rows(held: list[pa.Array]) -> pa.RecordBatch:
        counts = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=kind.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        for b in batches:
            for part in _slices(b, 0):
                held.append(tokens_in(part.column(0))[0])
                if sum(map(len, held)) > HELD:
                    yield rows(held)
                    held = []
        yield rows(held)

    return map_arrow(docs.select("text"), run, kind).groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """Frequent words: position by word, their log10 counts and symbols; log10 of the unigram parts."""

    index: dict[bytes, int]
    log_counts: np.ndarray
    symbols: np.ndarray
    #: log10 of what a word's smoothed count is divided by within its shared symbol.
    shared_totals: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    n: int
    v: int

    def look_up(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Positions of the tokens among the frequent words (-1: none), their symbols, and the tokens that are none of them."""
        known = pc.index_in(tokens, value_set=pa.array(self.index, pa.binary())).fill_null(-1).to_numpy().astype(np.int64)
        symbols, rest = self.symbols[known], np.flatnonzero(known < 0)
        rare = tokens.take(pa.array(rest))
        symbols[rest] = shared_symbols(rare)
        return known, symbols, rare


def frequent_words(counts: DataFrame) -> Words:
    """The most frequent words, up to HEAD, cut at a step of a histogram of the counts, with totals over all words."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("c") * 8)
    left, least = HEAD, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["step"]
    rows = counts.where((step >= (least if least is not None else 10**6)) | (F.col("token") == F.lit(END))).collect()
    rows = sorted(((-r["c"], bytes(r["token"])) for r in rows), key=lambda r: (r[1] != END, r))  # the end is a symbol of its own
    own = rows[:OWN]
    totals = {r["k"]: (r["c"], r["v"]) for r in counts.groupBy((F.crc32(F.substring("token", 1, 2)) % SHARED).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    shared = np.array([totals.get(k, (0, 0)) for k in range(SHARED)], np.float64).reshape(-1, 2)
    for c, w in own:
        shared[shared_symbol(w) - OWN] -= (-c, 1)
    # The last entry is for position -1, a word that is not there.
    symbols = np.array([*[i if i < OWN else shared_symbol(w) for i, (_, w) in enumerate(rows)], 0], np.int64)
    mass = np.full(SYMBOLS, 0.5)
    mass[: len(own)] += [-c for c, _ in own]
    mass[OWN:] += shared[:, 0]
    mass = mass.reshape(CLASSES, CLASS)
    by_class = mass.sum(axis=1)
    return Words(
        {w: i for i, (_, w) in enumerate(rows)},
        np.log10(np.array([*[-c for c, _ in rows], 0], np.float64) + SMOOTHING),
        symbols,
        np.log10(shared[:, 0] + SMOOTHING * (shared[:, 1] + 1)),
        np.log(by_class / by_class.sum()).astype(np.float32),
        np.log(mass / by_class[:, None]).astype(np.float32),
        n,
        v,
    )


def _rows(symbols: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each position: rows of the class table, rows of the word table, and the symbol. symbols: padded by three STARTs before each text."""
    here = symbols[places]
    one, two, three = (symbols[places - k] for k in (1, 2, 3))
    keys = np.stack([one, two + 10_007, three + 20_011, one * 5_003 + two * 7 + 30_029])
    mixed = (keys.astype(np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    by_class = (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & np.uint64(CLASS_ROWS - 1)
    classed = (mixed[:2] + (here // CLASS).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x94D049BB133111EB)
    return by_class.astype(np.int64), (classed >> np.uint64(40)).astype(np.int64) & (WORD_ROWS - 1), here


def _exponentials(table: np.ndarray, rows: np.ndarray, bias: np.ndarray, gold: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of each position's logits, their sums, and the logit of its gold column, less what was taken off before exp.

    bias: one row for all positions, or the rows `of` names.
    """
    x = table.take(rows[0], axis=0)
    more = np.empty_like(x)
    for r in rows[1:]:
        x += table.take(r, axis=0, out=more, mode="clip")
    x += bias if of is None else bias.take(of, axis=0, out=more, mode="clip")
    right, ones = x[np.arange(len(gold)), gold], np.ones(x.shape[1], x.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(x, out=more)
        sums = e @ ones
    if not (sums.min() > 1e-30 and sums.max() < 1e30):  # out of the numbers' range as they are
        top = x.max(axis=1)
        e, right = np.exp(x - top[:, None]), right - top
        sums = e @ ones
    return e, sums, right


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order of keys, the different keys and how often each occurs."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return order, ordered[first], np.diff(first, append=len(keys))


def _run_sums(values: np.ndarray, picks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over consecutive runs of values[picks], and the number of the run that each belongs to.

    Runs are cut into parts of FAN rows; the first rows of all parts are added to the second ones and so on, then the
    parts' sums in the same way.
    """
    while True:
        starts, parts = np.cumsum(sizes) - sizes, -(-sizes // FAN)
        whole = len(parts) == 0 or parts.max() == 1
        if not whole:
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            lengths = np.minimum(np.repeat(sizes, parts) - FAN * inner, FAN)
            starts = np.repeat(starts, parts) + FAN * inner
        else:
            lengths = sizes
        order = np.argsort((FAN - lengths).astype(np.uint8), kind="stable")
        starts, longer = starts[order], len(order) - np.cumsum(np.bincount(lengths, minlength=FAN + 1))
        out = values.take(picks[starts], axis=0)
        buffer = np.empty((CACHED, *values.shape[1:]), values.dtype)
        for j in range(1, FAN):
            for a in range(0, m := int(longer[j]), CACHED):
                b = min(a + CACHED, m)
                out[a:b] += values.take(picks[starts[a:b] + j], axis=0, out=buffer[: b - a], mode="clip")
        if whole:
            return out, order
        values, sizes, picks = out, parts, np.empty(len(order), np.int64)
        picks[order] = np.arange(len(order))


def _held(texts: Iterable) -> Iterator[list]:
    """The texts in lists of ENCODED tokens or little more: a task's documents are not held together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= ENCODED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _padded(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts of these sizes with three STARTs before each text, and the places of the symbols."""
    places = np.arange(len(flat)) + 3 * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    padded = np.full(len(flat) + 3 * len(sizes), START, np.int64)
    padded[places] = flat
    return padded, places


@dataclass
class Model:
    words: Words
    class_table: np.ndarray
    word_table: np.ndarray

    def encode(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Padded symbols, places of the tokens, positions among the frequent words (-1: none), all tokens."""
        flat = list(itertools.chain.from_iterable(texts))
        known, symbols, _ = self.words.look_up(pa.array(flat, pa.binary()))
        return *_padded(symbols, np.fromiter(map(len, texts), np.int64, len(texts))), known, flat

    def log10_symbols(self, padded: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol at each place."""
        out = np.empty(len(places))
        for a in range(0, len(places), step := 2 * CACHED):
            by_class, classed, here = _rows(padded, places[a : a + step])
            _, class_sums, class_right = _exponentials(self.class_table, by_class, self.words.class_bias, here // CLASS)
            _, word_sums, word_right = _exponentials(self.word_table, classed, self.words.word_bias, here % CLASS, here // CLASS)
            out[a : a + step] = class_right - np.log(class_sums) + word_right - np.log(word_sums)
        return out / np.log(10)

    def trained_on(self, texts: Iterable[list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, rows, changes, uses) of AdaGrad updates on these texts; the model itself stays."""
        return self.trained_on_symbols(self.encode(held)[:2] for held in _held(texts))

    def trained_on_symbols(self, parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The same on (padded symbols, places)."""
        tables = [self.class_table.copy(), self.word_table.copy()]
        squares, uses = [np.ones_like(t) for t in tables], [np.zeros(len(t)) for t in tables]
        for padded, places in parts:
            for a in range(0, len(places), BATCH):
                by_class, classed, here = _rows(padded, places[a : a + BATCH])
                for k, (rows, gold, bias, of) in enumerate(((by_class, here // CLASS, self.words.class_bias, None), (classed, here % CLASS, self.words.word_bias, here // CLASS))):
                    p = np.empty((len(gold), tables[k].shape[1]), np.float32)
                    for c in range(0, len(gold), 2 * CACHED):
                        at = slice(c, c + 2 * CACHED)
                        e, sums, _ = _exponentials(tables[k], rows[:, at], bias, gold[at], of if of is None else of[at])
                        np.multiply(e, (1 / sums)[:, None], out=p[at])
                    p[np.arange(len(gold)), gold] -= 1
                    order, changed, n = _runs(rows.ravel().astype(np.min_scalar_type(len(tables[k]) - 1)))
                    grad, run = _run_sums(p, order % len(gold), n)
                    changed = changed[run].astype(np.int64)
                    uses[k][changed] += n[run]
                    for c in range(0, len(changed), CACHED):
                        at, g = changed[c : c + CACHED], grad[c : c + CACHED]
                        square = squares[k].take(at, axis=0)
                        square += g * g
                        squares[k][at] = square
                        g *= RATE
                        g /= np.sqrt(square, out=square)
                        tables[k][at] = np.subtract(tables[k].take(at, axis=0, out=square, mode="clip"), g, out=g)
        for k, base in enumerate((self.class_table, self.word_table)):
            rows = np.flatnonzero(uses[k])
            yield k, rows, (tables[k][rows] - base[rows]).astype(np.float16), uses[k][rows]


def _average(key: tuple, table: pa.Table) -> pa.Table:
    """Changes of each row over all tasks, weighed by their uses."""
    rows, uses = table["row"].to_numpy(), table["uses"].to_numpy()
    change = np.frombuffer(b"".join(table["change"].to_pylist()), np.float16).reshape(len(rows), -1).astype(np.float64)
    order, changed, n = _runs(rows)
    sums, run = _run_sums(np.column_stack([change * uses[:, None], uses]), order, n)
    changed, total, mean = changed[run], sums[:, -1], sums[:, :-1] / sums[:, -1:]
    return pa.table({"row": pa.array(changed, pa.int64()), "uses": pa.array(total, pa.float64()), "change": pa.array([x.tobytes() for x in mean.astype(np.float32)], pa.binary())})


def encoded(source: DataFrame, words: Words) -> DataFrame:
    """One row for each of (doc_id, held_out, slice, text), texts as symbols of two bytes.

    ref is the row's own number, n_known and counts_log are of frequent words, within is what they add to the score within
    their shared symbols, and rare holds the tokens whose counts are not among the words.
    """
    shared = source.sparkSession.sparkContext.broadcast(words)
    kind = StructType([StructField("ref", LongType()), *[source.schema[c] for c in ("doc_id", "held_out", "slice")], *StructType.fromDDL("n_tokens long, n_known long, counts_log double, within double, symbols binary, rare array<binary>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, done = shared.value, TaskContext.get().partitionId(), 0
        for b in (b for batch in batches for b in _slices(batch, 3)):
            tokens, sizes = tokens_in(b.column(3))
            known, symbols, rare = words.look_up(tokens)
            n, frequent, owner = len(sizes), known >= 0, np.repeat(np.arange(len(sizes)), sizes)
            log_counts = np.where(frequent, words.log_counts[known], 0.0)
            within = np.where(symbols >= OWN, log_counts - words.shared_totals[np.maximum(symbols - OWN, 0)], 0.0)
            ends = lambda sizes: np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            known_here = np.bincount(owner[frequent], minlength=n)
            columns = [pa.array(np.arange(n) + (part << 40) + done), *b.columns[:3], pa.array(sizes), pa.array(known_here), pa.array(np.bincount(owner, log_counts, n)), pa.array(np.bincount(owner, within, n))]
            columns.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends(2 * sizes)), pa.py_buffer(symbols.astype("<u2"))]))
            columns.append(pa.ListArray.from_arrays(pa.array(ends(sizes - known_here)), rare))
            yield pa.RecordBatch.from_arrays(columns, names=kind.names)
            done += n

    return map_arrow(source, run, kind)


def _parts(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Padded symbols, places and sizes of some texts at a time."""
    for held in _held(np.frombuffer(x, "<u2") for x in texts):
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        yield *_padded(np.concatenate(held), sizes), sizes


def train(docs: DataFrame, words: Words, rounds: int = ROUNDS, slices: int = SLICES) -> Model:
    """docs: the training documents as (slice hash, text). Rounds go on until each slice has been read once at least."""
    source = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "slice", "text")
    return replace(train_encoded(stage(encoded(source, words)), words, rounds, slices), words=words)


def train_encoded(docs: DataFrame, words: Words, rounds: int = ROUNDS, slices: int = SLICES) -> Model:
    """The same on rows of (slice, symbols); the model's words are without their index."""
    words = replace(words, index={})
    model = Model(words, np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, CLASS), np.float32))
    kind = StructType.fromDDL("row long, uses double, change binary")
    context = docs.sparkSession.sparkContext
    for k in range(max(rounds, slices)):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            parts = (part[:2] for part in _parts(x for b in batches for x in b.column(0).to_pylist()))
            for table, rows, change, uses in shared.value.trained_on_symbols(parts):
                yield pa.RecordBatch.from_arrays([pa.array(rows + table * CLASS_ROWS, pa.int64()), pa.array(uses, pa.float64()), pa.array([x.tobytes() for x in change], pa.binary())], names=kind.names)

        changes = map_arrow(docs.where(F.col("slice") % slices == k % slices).select("symbols"), run, kind)
        mean = changes.groupBy((F.col("row") % GROUPS).alias("group")).applyInArrow(_average, kind).collect()
        class_table, word_table = model.class_table.copy(), model.word_table.copy()
        for r in mean:
            change, row = np.frombuffer(r["change"], np.float32), r["row"]
            if row < CLASS_ROWS:
                class_table[row] += change
            else:
                word_table[row - CLASS_ROWS] += change
        model = Model(words, class_table, word_table)
        shared.unpersist()
    return model


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, slices: int = SLICES) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the smoothed unigram log10 probability by the training tokens' counts, score that of the model.
    Documents whose id has remainder 0 are held out of all learning. Null texts are empty: their one token is the end.
    Rows that repeat an id and null ids are kept. Without training documents the counts are zero and both scores are
    those of the smoothing alone. An empty table gives an empty result.
    """
    # The slice is taken from other digits of the hash than the hold-out.
    source = docs.select(F.col(id_col).alias("doc_id"), (remainder(F.col(id_col)) == 0).alias("held_out"), F.floor(remainder(F.col(id_col), 1 << 31) / 10).alias("slice"), F.col(text_col).alias("text"))
    counts = stage(count_tokens(source.where("not held_out")))
    words = frequent_words(counts)
    texts = stage(encoded(source, words))
    shared = docs.sparkSession.sparkContext.broadcast(train_encoded(texts.where("not held_out").select("slice", "symbols"), words, rounds, slices))
    both = texts.select("ref", "doc_id", "held_out", "n_tokens", "n_known", "counts_log", "within", "symbols")
    kind = StructType([*both.schema.fields[:-2], StructField("model_log", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = [np.zeros(0)]
            for padded, places, sizes in _parts(b.column(7).to_pylist()):
                logs.append(np.bincount(np.repeat(np.arange(len(sizes)), sizes), shared.value.log10_symbols(padded, places), len(sizes)))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(np.concatenate(logs) + b.column(6).to_numpy())], names=kind.names)

    rare = texts.select("ref", F.explode("rare").alias("token")).join(counts, "token", "left")
    count = F.coalesce("c", F.lit(0))
    tail = rare.groupBy("ref").agg(F.sum(F.log10(count + SMOOTHING)).alias("rare_log"), F.sum((count > 0).cast("long")).alias("rare_known"))
    rows = map_arrow(both, run, kind).join(tail, "ref", "left")
    log = F.coalesce("rare_log", F.lit(0.0))
    divisor = float(np.log10(words.n + SMOOTHING * (words.v + 1)))
    return rows.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("counts_log") + log - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("model_log") + log).alias("score"),
    )
