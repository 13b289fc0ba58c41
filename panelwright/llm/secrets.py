"""Secrets: patterns, and a linear-chain conditional random field for what the patterns miss.

A text is tokenised into runs of key characters and single marks. Chains are the stretches of tokens around runs that
could be a secret (long enough, with a digit); everything else is outside by definition. Tokens are tagged begin,
inside or outside from their shape, the neighbouring words and features of the whole file, and decoded by Viterbi.

Training is distant: the patterns label a bounded sample; every chain is seen twice, once without its keyword, so that
other keywords and bare keys can be told by the rest.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from panelwright.llm.crf import Chain, bucket, fit_chain, pad, viterbi
from panelwright.llm.ship import map_arrow

KINDS = ("assign", "access", "hex")
OUTSIDE, BEGIN, INSIDE = range(3)
#: Expected documents of the training sample and its most chains.
SAMPLE_DOCS = 6_000
SAMPLE_CHAINS = 20_000
#: A run can be a secret from this length on, with a digit; tokens on either side that its chain holds.
LEAST_LENGTH = 8
AROUND = 4
#: Bits per character that an added secret needs, and its least length.
LEAST_BITS = 2.5
#: Tokens of a chain; a longer stretch is cut into several.
LONGEST = 64

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % LEAST_LENGTH)
_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind."""
    out = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The parts of the patterns' matches that are the secret itself."""
    out = [m.span(1) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    return out + [(a, b) for k, a, b in base_spans(text) if k]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def bits(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) if n else 0.0


def chains_of(text: str) -> list[list[tuple[int, int]]]:
    """Token spans of each stretch around runs that could be a secret."""
    runs = [m.span() for m in _LONG.finditer(text) if _DIGIT.search(text, m.start(), m.end())]
    out: list[list[tuple[int, int]]] = []
    for a, b in runs:
        left = _tokens_before(text, a)
        right = []
        for m in _TOKEN.finditer(text, b):
            if len(right) == AROUND or m.start() - b > 200:
                break
            right.append(m.span())
        tokens = [*left, (a, b), *right]
        if out and out[-1][-1][1] > tokens[0][0] and len(out[-1]) < LONGEST:
            known = out[-1][-1][1]
            out[-1] += [t for t in tokens if t[0] >= known]
        else:
            known = out[-1][-1][1] if out else 0
            new = [t for t in tokens if t[0] >= known]
            if new:
                out.append(new)
    return out


def _tokens_before(text: str, end: int) -> list[tuple[int, int]]:
    start = max(0, end - 200)
    return [m.span() for m in _TOKEN.finditer(text, start, end)][-AROUND:]


def _shape(token: str) -> str:
    kinds = (any("a" <= c <= "z" for c in token), any("A" <= c <= "Z" for c in token), any("0" <= c <= "9" for c in token), any(c in "+/=" for c in token), any(c in "_-" for c in token))
    return "".join("aA9+-"[i] for i, k in enumerate(kinds) if k)


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    marks = sum(map(text.count, "{}=;:\"'<>"))
    return [f"F marks {min(5, marks * 40 // n)}", f"F lines {min(3, text.count(chr(10)) * 100 // n)}", f"F size {len(str(n))}"]


def features(text: str, chain: list[tuple[int, int]], whole: list[str], keywords: bool = True) -> list[list[int]]:
    words = [text[a:b][:64].lower() for a, b in chain]
    out = []
    for i, (a, b) in enumerate(chain):
        token = text[a:b][:256]
        shape, size = _shape(token), min(8, (b - a) // 4)
        own = ["bias", f"s {shape}", f"l {size}", f"sl {shape} {size}", f"e {shape} {int(2 * bits(token))}", f"x {all(c in '0123456789abcdef' for c in token)} {size}", f"p {token[:4] if shape in ('A9', 'aA9') else ''}"]
        own += [f"{w} {shape}" for w in whole]
        if b - a == 1:
            own.append(f"m {token}")
        for step in (-2, -1, 1):
            j = i + step
            near = words[j] if 0 <= j < len(words) else "^"
            if len(near) == 1 or keywords:
                own.append(f"n{step} {near}")
            own.append(f"ns{step} {_shape(near)} {min(8, len(near) // 4)}")
        out.append([bucket(f) for f in own])
    return out


def chain_labels(chain: list[tuple[int, int]], parts: list[tuple[int, int]]) -> list[int]:
    out, opened = [], set()
    for a, b in chain:
        hit = next((p for p in parts if p[0] < b and p[1] > a), None)
        out.append(OUTSIDE if hit is None else INSIDE if hit in opened else BEGIN)
        opened.add(hit)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Chain:
    """A model from about `sample_docs` documents by the hash of id and text."""
    known = docs.where(F.col(text_col).isNotNull())
    share = int(min(1.0, sample_docs / max(1, known.count())) * 1_000_000)
    source = known.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1_000_000)) < share).select(F.col(text_col).alias("text"))
    kind = StructType.fromDDL("nodes array<array<long>>, bare array<array<long>>, labels array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = pa.list_(pa.list_(pa.int64()))
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                parts, whole = secret_parts(text), file_features(text)
                rows += [(features(text, c, whole), features(text, c, whole, False), chain_labels(c, parts)) for c in chains_of(text)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (nodes, nodes, pa.list_(pa.int32())), strict=True)], names=kind.names)

    rows = map_arrow(source, run, kind).limit(SAMPLE_CHAINS).collect()
    nodes = [list(n) for r in rows for n in r.nodes] + [list(n) for r in rows for n in r.bare]
    labels = [x for r in rows for x in r.labels] * 2
    barred = np.zeros((3, 3), bool)
    barred[OUTSIDE, INSIDE] = True
    model = fit_chain(nodes, labels, [len(r.labels) for r in rows] * 2, 3, barred=barred)
    model.starts[INSIDE] = -1e4
    return model


def added_spans(model: Chain, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds, for a batch of texts. A kind is given by form: hex digits only, access key, else assign."""
    owners, chains, nodes = [], [], []
    for i, text in enumerate(texts):
        if own := chains_of(text):
            whole = file_features(text)
            for c in own:
                owners.append(i)
                chains.append(c)
                nodes += features(text, c, whole)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    scores, at = model.scores(nodes), 0
    for first in range(0, len(chains), 1024):
        part = chains[first : first + 1024]
        lengths = [len(c) for c in part]
        own = pad(scores[at : at + sum(lengths)], lengths)
        at += sum(lengths)
        for i, chain, labels in zip(owners[first : first + 1024], part, viterbi(model, own, lengths), strict=True):
            text, runs = texts[i], []
            for (a, b), label in zip(chain, labels, strict=True):
                if label == INSIDE and runs and runs[-1][1] == a:
                    runs[-1][1] = b
                elif label != OUTSIDE:
                    runs.append([a, b])
            for a, b in runs:
                token = text[a:b]
                if len(token) < LEAST_LENGTH or not _DIGIT.search(token) or not any(c.isalpha() for c in token) or bits(token) < LEAST_BITS or any(x < b and y > a for _, x, y in bases[i]):
                    continue
                kind = 2 if all(c in "0123456789abcdef" for c in token) else 1 if token.startswith("AKIA") else 0
                out[i].append((kind, a, b))
    return out


def secrets(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex (patterns), base_sha256, spans, base_spans (kind:start:end, comma-joined).

    Positions count code points, ends are exclusive; spans are ordered by start, then kind. Null texts are empty. Null
    and repeated ids are kept, other columns are not read, an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = StructType([source.schema["doc_id"], *[StructField(f"n_{k}", LongType()) for k in KINDS], *[StructField(c, StringType()) for c in ("base_sha256", "spans", "base_spans")]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            bases = [base_spans(t) for t in texts]
            added = added_spans(shared.value, texts, bases)
            base = [joined(x) for x in bases]
            columns = [pa.array([sum(s[0] == k for s in x) for x in bases], pa.int64()) for k in range(len(KINDS))]
            columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()))
            columns.append(pa.array([joined(sorted(x + y, key=lambda s: (s[1], s[0]))) if y else s for x, y, s in zip(bases, added, base, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(base, pa.string())], names=kind.names)

    return map_arrow(source, run, kind).withColumnRenamed("doc_id", id_col)
