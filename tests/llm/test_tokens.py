"""BPE, token files and token counts against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import zstandard  # noqa: F401

P = pytest.importorskip("public_tokenizers")

from tests.llm.conftest import ODD, prose  # noqa: E402
from weft.llm import bpe, token_counts, token_files  # noqa: E402

WORD, BYTE, PIECE = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def noise(rng, n):
    parts = ["the ", "  ", "\n", " \n ", "don't", "<|endoftext|>", "<|startoftext|>", "aaaaaaa", "hahaha", "日本", "é", "é", "Σ", "²", "_", ".,!", "\x1c", "\x85", "　", "1234", "🙂", "AbC"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(n)))


def test_pair_index_equals_library():
    lib, own, rng = library(WORD), bpe.WordBpe(WORD), random.Random(1)
    texts = [noise(rng, 30) for _ in range(600)] + [prose(rng) for _ in range(30)] + [t or "" for _, t in ODD]
    for text, (ids, n, decoded) in zip(texts, own.encode(texts)):
        e = lib.encode(text, add_special_tokens=False)
        assert ids == " ".join(map(str, e.ids)) and n == len(e.ids) and decoded == lib.decode(e.ids, skip_special_tokens=False)
    assert own.decode(own.ids("hello world")) == lib.decode(lib.encode("hello world", add_special_tokens=False).ids, skip_special_tokens=False)


def test_small_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 5)
    own, lib, rng = bpe.WordBpe(WORD), library(WORD), random.Random(2)
    for _ in range(50):
        text = prose(rng, 20) + " <|endoftext|> x"
        assert own.ids(text) == lib.encode(text, add_special_tokens=False).ids


def test_tables_start_anew_between_texts_that_share_words(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 5)
    own, lib = bpe.WordBpe(WORD), library(WORD)
    first, second = (" ".join(f"shared word{k}x{i}, \u00c9t\u00e9" for i in range(200)) for k in range(2))
    for texts in ([first], [second], [first, second], ["shared shared"], [""]):
        assert [x[0] for x in own.encode(texts)] == [" ".join(map(str, lib.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_marks_and_letters_beside_words():
    own, lib, rng = bpe.WordBpe(WORD), library(WORD), random.Random(8)
    marks = [chr(c) for c in (*range(33, 0x250), 0x300, 0x301, 0x3A3, 0x1E9E, 0x2126)]
    for text in ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 7))) for _ in range(3000)] + [f"ab{a}{b}" for a in marks[:100] for b in marks[:32]]:
        assert own.ids(text) == lib.encode(text, add_special_tokens=False).ids, text


def test_bpe_rows(docs, empty):
    lib = library(WORD)
    got = sorted(map(tuple, bpe.encoded(docs, WORD).collect()), key=repr)
    want = []
    for i, t in ((r["doc_id"], r["text"] or "") for r in docs.collect()):
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encoded(empty, WORD).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(16384, 128), (64, 8), (40, 2)])
def test_counts_equal_library(chunk, overlap):
    own, rng = token_counts.PieceCounter(PIECE, chunk, overlap), random.Random(4)
    texts = [noise(rng, 60) for _ in range(300)] + ["a" * 500, "日本語" * 100, " " * 300, ("ab" * 70 + " ") * 5] + [prose(rng, 200)]
    for t in texts:
        assert own.count(t) == len(own.model.encode(t)), t
    if chunk < 100:
        assert own.widened  # some overlaps had no stable boundary


def test_count_rows(docs, empty):
    own = token_counts.PieceCounter(PIECE)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(own.model.encode(r["text"] or "")), n > 4096) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, token_counts.token_counts(docs, PIECE).collect()), key=repr) == want
    assert token_counts.token_counts(empty, PIECE).count() == 0


def test_words_of_byte_bpe_equal_library():
    lib, own, rng = library(BYTE), token_files.ByteBpe(BYTE), random.Random(6)
    texts = [noise(rng, 40) for _ in range(500)] + [prose(rng) for _ in range(20)] + ["a, b. c!! d's \"e\" f) (g", " lead", "trail ", "", "x's, 'tis ok?!"]
    for text, raw in zip(texts, own.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids + [0]


def test_file_round_trip(spark, docs, empty):
    lib = library(BYTE)
    path = token_files.token_files(docs, BYTE, shard_bytes=20_000)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [0], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.read_token_files(spark, token_files.token_files(empty, BYTE)).count() == 0


def test_shard_gives_one_document():
    docs = [np.arange(n, dtype="<u4").tobytes() for n in (0, 5, 1000)]
    s = token_files.Shard(token_files.write_shard([3, 4, 9], docs, b"", np.dtype("<u2"), 3), b"")
    assert s[1].tolist() == [0, 1, 2, 3, 4] and len(s[0]) == 0 and s[2].tobytes() == docs[2]
    with pytest.raises(ValueError):
        token_files.Shard(token_files.write_shard([], [], b"", np.dtype("<u2"), 3), b"another dictionary")
