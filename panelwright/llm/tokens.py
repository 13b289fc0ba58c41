"""Token ids of a public byte-level BPE, with a memo of the pieces between spaces."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from panelwright.llm.held import held

#: Pieces kept in a worker's memo; it starts anew beyond that. Longer pieces are encoded each time. Some 20 MB: frequent
#: pieces are back after a few documents, and most others never come again.
MEMO_PIECES = 100_000
MEMO_LENGTH = 64


# A word of letters whose class is the same in every Unicode version is one piece before merges, and so are the marks
# after it (no apostrophe: the tokenizer splits contractions). A line feed between two such words stands alone.
_WORD = r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)"
_PIECE = re.compile(rf"{_WORD}(?:\n{_WORD})?").fullmatch
#: New words that a library encodes in one call.
WORDS = 2_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    """The same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _rank_encoder(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    opens = {lead: np.zeros(max(ranks.values()) + 1, bool) for lead in (" ", "\n")}
    opens[" "][[r for piece, r in ranks.items() if piece[:1] == b" "]] = opens["\n"][ranks[b"\n"]] = True
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), opens


class ByteEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes.

    The tokenizer never merges across a single space between visible characters, and the space goes with what follows.
    So a text is the sequence of its pieces, each encoded once with its space in front. Texts in which a space touches
    other white space are encoded whole.

    New pieces that are a word of Latin letters, with a mark after it or not, go through the same vocabulary's rank
    file where there is one, many in one call: that library needs a quarter of the time and gives the same ids.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        ranks = ranks or (default_ranks() if path is None else None)
        self.fast, self.opens = _rank_encoder(ranks) if ranks else (None, {})
        self.marks: dict[str, bytes] = {"": b""}
        self.memo: dict[str, bytes] = {}

    def words(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of Latin words, each with `lead` (a space or a line feed) in front."""
        out = []
        for at in range(0, len(words), WORDS):
            ids = np.array(self.fast.encode_ordinary(lead + lead.join(words[at : at + WORDS])), "<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(self.opens[lead][ids])).tolist()
            out += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        return out

    def new_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """(piece, ids) of those that neither begin nor end with white space."""
        plain, heads, tails, found, marks = [], [], [], [], self.marks
        for p in pieces:
            if self.fast and (m := _PIECE(p)):
                head, mark, tail, last = m.groups()
                heads.append(head)
                found.append((p, mark, last))
                if tail:
                    tails.append(tail)
            elif p and not p[0].isspace() and not p[-1].isspace():
                plain.append(p)
        if new := list({m for _, *two in found for m in two if m and m not in marks}):
            marks.update(zip(new, self.direct(new), strict=True))
        second = iter(self.words(tails, "\n"))
        for (p, mark, last), ids in zip(found, self.words(heads, " "), strict=True):
            yield p, ids + marks[mark] if last is None else ids + marks[mark] + next(second) + marks[last]
        yield from zip(plain, self.direct([" " + p for p in plain]), strict=True)

    def direct(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. The library's results hold far more than ids, so a few texts go at a time."""
        return [array("I", e.ids).tobytes() for at in range(0, len(texts), WORDS) for e in self.tokenizer.encode_batch(texts[at : at + WORDS], add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.marks = {}, {"": b""}
        memo, split = self.memo, [t.split(" ") for t in texts]
        seen = set()
        for parts in split:
            seen.update(parts[1:])
        extra = {}
        new, plain = [], []
        for p in seen.difference(memo):
            (plain if self.fast and p.isascii() and p.isalpha() and len(p) <= MEMO_LENGTH else new).append(p)
        memo.update(zip(plain, self.words(plain, " "), strict=True))
        for p, ids in self.new_pieces(new):
            (memo if len(p) <= MEMO_LENGTH else extra)[p] = ids
        find = memo.__getitem__ if not extra else lambda p: memo[p] if p in memo else extra[p]
        out, whole = self.direct([parts[0] for parts in split]), []
        for i, parts in enumerate(split):
            try:
                del parts[0]
                out[i] += b"".join(map(find, parts))
            except KeyError:  # a space touches other white space here
                whole.append(i)
        for i, ids in zip(whole, self.direct([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def encoder(path: str | None = None) -> ByteEncoder:
    """One encoder for each worker process and path."""
    return held(f"tokens {path}", lambda: ByteEncoder(path))
