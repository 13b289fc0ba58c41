"""Personal data: patterns, and a skip-chain conditional random field for what the patterns miss.

Nodes are the tokens between white space that hold a digit or an at sign; all other tokens are outside by definition.
Neighbouring nodes share chain potentials. Nodes of one document whose texts are the same, or similar (same digits,
same address without its marks), share skip potentials, so that a number written in full once lends its label to later
mentions in another form. Loopy message passing gives the marginals, one batch of documents at a time.

Training is piecewise and distant: the patterns label a bounded sample; node weights are learned with the telling
features of every second copy left out, chain and skip potentials from the labels of linked nodes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from panelwright.llm.crf import Chain, bucket, fit_nodes, loopy_marginals, pair_scores
from panelwright.llm.ship import map_arrow

KINDS = ("email", "ip", "card", "phone")
#: Labels: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
#: Expected documents of the training sample and its most node rows.
SAMPLE_DOCS = 4_000
SAMPLE_NODES = 60_000
#: Chain score of an inside label after anything but its own kind: rare, but linked mentions may lack their beginning.
INSIDE_ALONE = -4.0
#: A span is added where all its nodes are entity nodes with at least this marginal.
LEAST = 0.6

# Possessive and anchored forms of the patterns: the same matches without repeated scans of long runs.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+")
_EDGE = "()[]{}<>,;:!?\"'|.*_~`"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                last = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


@dataclass
class Nodes:
    """Nodes of one document: spans, features (telling ones apart), whether each follows the one before, and keys for skips."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    telling: list[list[int]]
    follows: list[bool]
    keys: list[list[str]]


def _shape(token: str) -> str:
    out = ""
    for c in token:
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if out[-3:] != k * 3:
            out += k
    return out[:24]


def _before(text: str, end: int) -> tuple[str, int]:
    """The word that ends before `end`, lower-cased, and where it begins; at most 40 letters of it are seen."""
    while end > 0 and text[end - 1].isspace():
        end -= 1
    start = end
    while start > 0 and end - start < 40 and not text[start - 1].isspace():
        start -= 1
    return text[start:end].lower().strip(_EDGE), start


def _after(text: str, start: int) -> str:
    n = len(text)
    while start < n and text[start].isspace():
        start += 1
    end = start
    while end < n and end - start < 40 and not text[end].isspace():
        end += 1
    return text[start:end].lower().strip(_EDGE)


def nodes_of(text: str) -> Nodes:
    out, done = Nodes([], [], [], [], []), 0
    n = len(text)
    for m in _MARK.finditer(text):
        a, b = m.span()
        if a < done:
            continue
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < n and not text[b].isspace():
            b += 1
        raw = text[a:b]
        start = a + len(raw) - len(raw.lstrip(_EDGE.replace("+", "")))
        end = max(start, b - (len(raw) - len(raw.rstrip(_EDGE))))
        token = text[start:end]
        previous = out.spans[-1] if out.spans else None
        follows = previous is not None and text[done:a].isspace() and a - done <= 3
        digits = _digits(token)
        word, at = _before(text, a)
        two, _ = _before(text, at)
        letters = any(c.isalpha() for c in token)
        out.spans.append((start, end))
        out.follows.append(follows)
        out.features.append([bucket(f) for f in ("bias", f"w1 {_shape(word)}", f"W1 {word}", f"W2 {two}", f"N1 {_after(text, b)}", f"d {min(len(digits), 20)}", f"a {letters}", f"f {follows}", f"p {raw[0] if raw[0] in '(+[' else ''}")])
        out.telling.append([bucket(f) for f in (f"s {_shape(token)}", f"@ {'@' in token}", f"+ {token[:1] == '+'}", f". {token.count('.')}", f"- {token.count('-')}", f"l {len(token) // 4}")])
        keys = [f"t{token.lower()}"] if len(token) >= 4 else []
        if len(digits) >= 4 and not letters:
            keys.append(f"d{digits}")
        if "@" in token or "at" in token.lower() and letters:
            keys.append("e" + "".join(c for c in token.lower() if c.isalnum()))
        out.keys.append(keys)
        done = b
    return out


def edges_of(nodes: Nodes, first: int = 0) -> tuple[list[tuple[int, int]], list[int]]:
    """Chain edges (type 0) and skip edges (type 1: same token, 2: similar) between positions counted from `first`.

    Repeats are linked one to the next, so that a token that occurs n times has n - 1 skip edges.
    """
    edges, types, last, seen = [], [], {}, set()
    for i, (follows, keys) in enumerate(zip(nodes.follows, nodes.keys, strict=True)):
        if follows:
            edges.append((first + i - 1, first + i))
            types.append(0)
            seen.add((i - 1, i))
        for k in keys:
            j = last.get(k)
            if j is not None and (j, i) not in seen:
                seen.add((j, i))
                edges.append((first + j, first + i))
                types.append(1 if k[0] == "t" else 2)
            last[k] = i
    return edges, types


def node_labels(nodes: Nodes, spans: list[tuple[int, int, int]]) -> list[int]:
    """Labels by the patterns' spans: a node belongs to the first span that it meets."""
    out, opened = [], set()
    by_start = sorted(spans, key=lambda s: s[1])
    at = 0
    for a, b in nodes.spans:
        while at < len(by_start) and by_start[at][2] <= a:
            at += 1
        hit = next((s for s in by_start[at : at + len(KINDS)] if s[1] < b and s[2] > a), None)
        if hit is None:
            out.append(0)
        else:
            out.append(1 + 2 * hit[0] + (hit in opened))
            opened.add(hit)
    return out


@dataclass
class SkipChain:
    weights: np.ndarray
    tables: np.ndarray


def _fits(kind: int, token: str, digits: str) -> bool:
    """What an added span must at least be."""
    if kind == 0:
        return "@" in token[1:-1]
    if kind == 1:
        parts = re.findall(r"[0-9]+", token)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if any(c.isalpha() for c in token):
        return False
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def added_spans(model: SkipChain, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to the patterns' ones, for a batch of texts at once."""
    all_nodes = [nodes_of(t) for t in texts]
    edges, types, first, features = [], [], 0, []
    for nodes in all_nodes:
        e, k = edges_of(nodes, first)
        edges += e
        types += k
        features += [a + b for a, b in zip(nodes.features, nodes.telling, strict=True)]
        first += len(nodes.spans)
    scores = Chain(model.weights, model.tables[0], np.zeros(LABELS)).scores(features)
    marginals = loopy_marginals(scores, np.array(edges, np.int64).reshape(-1, 2), np.array(types, np.int64), model.tables)
    out, first = [], 0
    for text, base, nodes in zip(texts, bases, all_nodes, strict=True):
        own = marginals[first : first + len(nodes.spans)]
        first += len(nodes.spans)
        found, runs = [], []
        for i, p in enumerate(own):
            label, inside = int(p.argmax()), 1 - p[0]
            if label == 0 or inside < LEAST:
                continue
            kind, begins = (label - 1) // 2, label % 2 == 1
            if runs and not begins and runs[-1][0] == kind and runs[-1][2] == i - 1 and nodes.follows[i]:
                runs[-1][2] = i
            else:
                runs.append([kind, i, i])
        for kind, i, j in runs:
            a, b = nodes.spans[i][0], nodes.spans[j][1]
            token = text[a:b]
            if _fits(kind, token, _digits(token)) and not any(x < b and y > a for _, x, y in base):
                found.append((kind, a, b))
        out.append(found)
    return out


def _sampled(docs: DataFrame, id_col: str, text_col: str, count: int) -> DataFrame:
    """About `count` rows by the hash of id and text, whatever the number of rows."""
    total = docs.count()
    share = int(min(1.0, count / max(1, total)) * 1_000_000)
    return docs.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1_000_000)) < share)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> SkipChain:
    source = _sampled(docs.where(F.col(text_col).isNotNull()), id_col, text_col, sample_docs).select(F.col(text_col).alias("text"))
    kind = StructType.fromDDL("doc long, features array<long>, telling array<long>, label int, chain boolean, keys array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                nodes = nodes_of(text)
                doc = int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:7], "little")
                rows += zip([doc] * len(nodes.spans), nodes.features, nodes.telling, node_labels(nodes, base_spans(text)), nodes.follows, nodes.keys, strict=True)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=kind.names)

    rows = map_arrow(source, run, kind).limit(SAMPLE_NODES).collect()
    by_doc: dict[int, Nodes] = {}
    labels: dict[int, list[int]] = {}
    for r in rows:
        own = by_doc.setdefault(r.doc, Nodes([], [], [], [], []))
        own.spans.append((0, 0))
        own.features.append(list(r.features))
        own.telling.append(list(r.telling))
        own.follows.append(r.chain and len(own.spans) > 1)
        own.keys.append(list(r["keys"]))
        labels.setdefault(r.doc, []).append(r.label)
    flat = [x for d in by_doc for x in labels[d]]
    full = [f + t for d in by_doc for f, t in zip(by_doc[d].features, by_doc[d].telling, strict=True)]
    bare = [f for d in by_doc for f in by_doc[d].features]
    edges, types, first = [], [], 0
    for nodes in by_doc.values():
        e, k = edges_of(nodes, first)
        edges += e
        types += k
        first += len(nodes.spans)
    pairs, kinds, gold = np.array(edges, np.int64).reshape(-1, 2), np.array(types, np.int64), np.array(flat, np.int64)
    # A mention without a label next to a labelled one of the same text is unknown and teaches nothing.
    known = np.ones(len(flat), bool)
    skips = pairs[kinds > 0]
    for one, other in ((0, 1), (1, 0)):
        known[skips[(gold[skips[:, one]] == 0) & (gold[skips[:, other]] > 0), one]] = False
    taught = np.flatnonzero(known)
    weights = fit_nodes([x[i] for x in (full, bare) for i in taught], [flat[i] for i in taught] * 2, LABELS)
    on = known[pairs].all(axis=1)
    pairs, kinds = pairs[on], kinds[on]
    tables = np.stack([pair_scores(pairs[kinds == k], gold, LABELS) if (kinds == k).any() else np.zeros((LABELS, LABELS)) for k in range(3)])
    if not (kinds == 2).any():  # similar tokens that the sample doesn't show count half as much as equal ones
        tables[2] = tables[1] / 2
    for k in range(len(KINDS)):  # inside follows begin or inside of its own kind
        others = [x for x in range(LABELS) if x not in (1 + 2 * k, 2 + 2 * k)]
        tables[0][others, 2 + 2 * k] = INSIDE_ALONE
    return SkipChain(weights, tables)


def personal_data(docs: DataFrame, model: SkipChain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (patterns), base_spans and spans (kind:start:end, comma-joined), base_sha256.

    Positions count code points, ends are exclusive; spans are ordered by kind, then start. Null texts are empty. Null
    and repeated ids are kept, other columns are not read, an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = [f"n_{k}" for k in KINDS]
    kind = StructType([source.schema["doc_id"], *[StructField(c, LongType()) for c in counts], *[StructField(c, StringType()) for c in ("base_sha256", "spans", "base_spans")]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            bases = [base_spans(t) for t in texts]
            added = added_spans(shared.value, texts, bases)
            base = [joined(x) for x in bases]
            columns = [pa.array([sum(s[0] == k for s in x) for x in bases], pa.int64()) for k in range(len(KINDS))]
            columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()))
            columns.append(pa.array([joined(sorted(x + y)) if y else s for x, y, s in zip(bases, added, base, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(base, pa.string())], names=kind.names)

    return map_arrow(source, run, kind).withColumnRenamed("doc_id", id_col)
