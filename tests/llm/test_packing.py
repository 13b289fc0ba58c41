import zlib
from collections import defaultdict

import pytest

from panelwright.llm.packing import packed
from panelwright.llm.tokens import ByteEncoder, default_path

TEXTS = [
    "", None, " ", "  ", "a", " a", "a ", "\n", "a\nb", "a\n b", "a \nb", "a\n\n b  c", "it's  we'll don't", "x y", "x  y", " z", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>c",
    "é ü 漢字 の text", "1 23 456,7", "w" * 5000, "tab\tsep arated", "end.\nNext line.\n", "mixed \t spaces", "\x1c x", "emoji 😀 ok",
]


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_memo_equals_direct_encoding():
    texts = [t or "" for t in TEXTS]
    enc = ByteEncoder()
    for _ in range(2):
        got = enc.encode(texts)
        assert [list(memoryview(g).cast("I")) for g in got] == direct(texts)


def check(rows, docs, length):
    want = defaultdict(list)
    for (doc, _), ids in zip(docs, direct([t for _, t in docs]), strict=True):
        want[doc].append(ids + [0])
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(parts) == set(want)
    for doc, pieces in parts.items():
        if len(want[doc]) > 1:
            continue
        ids, at = want[doc][0], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            cut = b"".join(i.to_bytes(4, "little") for i in ids[at : at + p.length])
            assert zlib.crc32(cut) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return len(sequences), sum(r.length for r in rows)


@pytest.mark.parametrize("parts", [1, 40])
def test_every_id_lies_in_one_piece(spark, parts):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "some words here " * (1 + i * 37 % 400)) for i in range(300)] + [(None, "no id"), (7, "again")]
    docs = [d for d in docs if d[0] != 7] + [(7, "one"), (7, "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    rows = packed(df, length=256, windows=8).collect()
    n, tokens = check(rows, docs, 256)
    assert n * 256 <= tokens * 1.05 + 256 * 4


def test_empty_table_names_and_string_ids(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([("x", "a b", 1, True)], "name string, text string, start int, open boolean")
    rows = packed(df, id_col="name").collect()
    assert [(r.name, r.start, r.length, r.offset) for r in rows] == [("x", 0, 3, 0)]


def test_plain_words_are_encoded_together(monkeypatch):
    """Words of ASCII letters need no pattern; all others, and words too long for the memo, are looked at one by one."""
    texts = ["first Plain words plain, don't naïve end.\nNext a " + "w" * 65 + " " + "v" * 64 + " x1 İ I the", " Plain\n\nwords  a"] + [t or "" for t in TEXTS]
    enc, looked = ByteEncoder(), []
    one_by_one = enc.new_pieces
    monkeypatch.setattr(enc, "new_pieces", lambda pieces: looked.extend(pieces) or one_by_one(pieces))
    assert [list(memoryview(g).cast("I")) for g in enc.encode(texts)] == direct(texts)
    assert not {"Plain", "words", "v" * 64, "the"} & set(looked) and {"plain,", "naïve", "w" * 65, "x1"} <= set(looked)


def test_texts_of_a_batch_are_encoded_in_bounded_parts(monkeypatch):
    """Python holds the strings of one part only, the library's results are those of a few pieces, the memo is small."""
    import pyarrow as pa

    from panelwright.llm import tokens
    from panelwright.llm.ship import slices

    texts = ["", "ab", "é" * 9, "abc", "", "x" * 4, "y", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"]).slice(1)
    parts = [(b.column(0).to_pylist(), t) for b, t in slices(batch, 1, 5)]
    assert parts == [([1], ["ab"]), ([2], ["é" * 9]), ([3, 4], ["abc", ""]), ([5, 6, 7], ["x" * 4, "y", ""])]
    assert list(slices(batch.slice(0, 0), 1, 5)) == []
    none = pa.RecordBatch.from_arrays([pa.array([None, "abc", None, "d"], pa.string())], names=["text"])
    assert [t for _, t in slices(none, 0, 3)] == [[None, "abc", None], ["d"]]

    enc, sizes = ByteEncoder(), []
    real = enc.tokenizer

    class Spy:
        def encode_batch(self, texts, **options):
            sizes.append(len(texts))
            return real.encode_batch(texts, **options)

    enc.tokenizer = Spy()
    many = [f"7a{i}" for i in range(5_000)]
    assert [list(memoryview(x).cast("I")) for x in enc.direct(many)] == direct(many) and max(sizes) <= tokens.WORDS
    assert tokens.MEMO_PIECES <= 100_000
