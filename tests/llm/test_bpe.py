import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from scanfold.llm import bpe, token_files
from scanfold.sources.workspace import new_path
from tests.conftest import SF
from tests.llm.conftest import by_id


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(bpe.default_vocabulary())
    found.no_truncation()
    found.no_padding()
    return found


def odd_texts(n=600, seed=5):
    draw = random.Random(seed)
    signs = [chr(c) for c in [*range(0x21), 0x85, 0xA0, 0xBD, 0x200B, 0x2028, 0x2160, 0x3000, 0x1D7CE, 0x1F600]] + list("ab'1 s\n.")
    wide = [*range(32, 0xD800), *range(0xE000, 0x11000)]
    return (["".join(draw.choices(signs, k=draw.randrange(50))) for _ in range(n)]
            + ["".join(map(chr, draw.choices(wide, k=40))) for _ in range(n // 3)]
            + ["", "a<|endoftext|> b  <|endoftext|>", "x" * 5000, "thntre" * 400, "  a ", " \n b", "a  ", "don't  we'll"])


def test_words_and_texts(library):
    texts = odd_texts()
    encoder = bpe.text_encoder(None)
    model = bpe.rank_array_bpe(None)
    for _ in range(2):  # the second time from the caches
        for text, ids in zip(texts, encoder.encode(texts)):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
            assert model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_scan_and_heap_agree():
    model = bpe.rank_array_bpe(None)
    draw = random.Random(3)
    words = [bytes(draw.choices(b"thenari ", k=draw.randrange(1, 200))) for _ in range(300)]
    assert all((a == model.encode_long(w)).all() for a, w in zip(model.encode_words(words), words))


def test_frame(documents, library):
    pairs = [(i, t) for i, t in enumerate(odd_texts(60))] + [(-1, None), (None, "null id")]
    got = by_id(bpe.round_trip_digest(documents(pairs)))
    for i, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    kept = bpe.encode(documents(pairs))
    assert kept.columns == [*documents(pairs).columns, "ids"]
    assert bpe.round_trip_digest(documents([])).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [-9, 0, 3, 1 << 40], [-(2**63), 2**63 - 1], list(range(0, 100000, 7))])
def test_elias_fano(values):
    made = token_files.EliasFano.of(np.array(values, np.int64))
    read = token_files.EliasFano.from_bytes(made.to_bytes())
    assert read.values().tolist() == values
    assert [read.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(token_files.EliasFano.of(ends).to_bytes()) < 50_000 * 14 / 8


def test_files(documents, spark, library):
    draw = random.Random(9)
    pairs = [(draw.randrange(-500, 500), t) for t in odd_texts(100)] + [(None, "no id"), (3, None), (10**15, "far"), (3, "b"), (3, "a")]
    folder = new_path(spark, "test-token-files")
    files = token_files.write_token_files(documents(pairs), folder, ids_per_file=200)
    assert files.count() > 5
    read = token_files.read_token_files(spark, folder).join(token_files.file_starts(files), "file").selectExpr("doc_id", "base + local AS start", "ids")
    at, want = 0, []
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, (p[1] or "").encode())):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, ids.tobytes()))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, bytes(r.ids)) for r in read.collect()), key=lambda r: r[1]) == want
    assert token_files.token_file_digest(documents([])).count() == 0


def test_files_of_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = by_id(token_files.token_file_digest(docs))
    at = 0
    for row in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[row.doc_id] == {"doc_id": row.doc_id, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        at += len(ids)


def test_one_document_from_a_file():
    file = token_files.TokenFile(token_files.pack_file([None, -4, 7], [2, 1, 3], np.arange(6), 2))
    assert [file.name(i) for i in range(3)] == [None, -4, 7]
    assert [file.document(i).tolist() for i in range(3)] == [[0, 1], [2], [3, 4, 5]]


def test_parts_of_a_sequence():
    draw = random.Random(3)
    for values in ([5], [0, 0, 0], [-2**63, -1, 2**63 - 1], sorted(draw.randrange(-10**6, 10**9) for _ in range(700)), list(range(300)), []):
        made = token_files.EliasFano.from_bytes(token_files.EliasFano.of(np.array(values, np.int64)).to_bytes())
        for _ in range(40):
            a, b = sorted((draw.randrange(len(values) + 1), draw.randrange(len(values) + 2)))
            assert made.values(a, b).tolist() == values[a:b]


def test_joined_words_against_library():
    """New words go to the library in one text; odd white space, marks, special strings and first words don't."""
    draw = random.Random(11)
    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    pieces = [" ", " ", " ", "  ", "\n", "\t ", "\xa0", "\x1c", "\x85", " ", "​", "'s", "'", "don't", "<|endoftext|>", "<|endof", "é", "é", "東京", "🙂", "\x00",
              "12", "a", "word", "Ġ", "_x", "...", "-", "﻿", "İ"]
    texts = ["".join(draw.choices(pieces, k=draw.randrange(30))) for _ in range(6000)] + [" ".join(f"w{draw.randrange(10**6)}" for _ in range(9000))]
    encode, _ = token_files.library_encoder(bpe.default_vocabulary())
    for start in range(0, len(texts), 500):
        own = texts[start:start + 500]
        assert encode(own) == [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(own, add_special_tokens=False)]
