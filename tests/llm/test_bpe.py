import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from kinfold.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    return [
        "", " ", " " * 3000, "a" * 5000, "ab" * 500, "é" * 400, "don't we'll\n\n  x", "日本語のテキスト", "<|endoftext|>", "🙂🙂👍🏽", "x" * 64, "x" * 65, "The quick brown fox. " * 20,
        "".join(rng.choice("abcdefgh \n\t") for _ in range(4000)), "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(2000)), "\x00\x01",
    ]


def test_ids_are_those_of_the_library(library):
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    texts = odd_texts()
    for got, text in zip(encoder.encode_many(texts), texts, strict=True):
        assert got == library.encode_ordinary(text)
        assert encoder.decode(got) == text.encode()
    assert encoder.encode_many(texts) == encoder.encode_many(texts)


def test_one_piece_and_many_agree():
    v = bpe.Vocabulary(PATH)
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"etaoin shr") for _ in range(rng.randint(1, 64))) for _ in range(500)]
    assert v.merge_many(pieces) == [v.merge_one(p) for p in pieces]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for k in range(30):
        encoder.encode_many([f"word{k} again{k}"])
    assert len(encoder.known) < 30
    monkeypatch.setattr(bpe, "REMEMBERED", 10_000)
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 500)
    for k in range(30):
        encoder.encode_many([f"{'long' * 30}{k}"])
    assert encoder.known.chars < 1000


def test_digests(spark, library):
    rows = [(k, t) for k, t in enumerate(odd_texts())] + [(100, None), (None, "x y"), (3, "x y"), (3, "x y")]
    df = spark.createDataFrame([(i, t, 9, "z") for i, t in rows], "doc_id long, text string, n_tokens int, found string")
    got = sorted(map(tuple, bpe.digests(df).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.limit(0)).count() == 0
    assert bpe.with_token_ids(df.where("doc_id = 100")).first().ids == [] and bpe.with_token_ids(df).columns == [*df.columns, "ids"]
