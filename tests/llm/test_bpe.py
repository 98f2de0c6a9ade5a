import base64
import hashlib
import random

import numpy as np
import public_tokenizers as T
import pytest
import tiktoken

from logloom.llm import bpe as B


@pytest.fixture(scope="module")
def both():
    path = T.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return B.Codec(data, T.PATTERN), tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={}), path


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@pytest.mark.parametrize("seed", range(20))
def test_like_the_library(both, seed):
    codec, library, _ = both
    rng = random.Random(seed)
    parts = ["abc", "aab ", "  \n\t", "éßñ", "日本語", "🙂", "0123²½", "'s'll've", "\x1c\x85 　 ", "\x00\x7f_", "the and", " ", "Ǆ×÷ª", "<|endoftext|>"]
    for _ in range(60):
        text = "".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 80)))
        assert ids(codec, text) == library.encode_ordinary(text), text


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9000, "abcab" * 5000, " " * 9999, "é" * 5000, "thequickbrownfox" * 700])
def test_long_pieces(both, text):
    codec, library, _ = both
    assert ids(codec, text) == library.encode_ordinary(text)
    assert codec.decode(ids(codec, text)) == text.encode()


def test_round_trip_of_a_table(both, spark):
    codec, library, path = both
    texts = [None, "", "Hello wörld's\n\n 42", "x" * 100_000, "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "n", 2)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in B.round_trip(df, path, T.PATTERN).collect()}
    for i, t in [*enumerate(texts), (None, "n")]:
        want = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    coded = B.encode(df, path, T.PATTERN)
    assert {r.doc_id: bytes(r.data) for r in B.decode(coded, path, T.PATTERN).collect()} == {i: (t or "").encode() for i, t in [*enumerate(texts), (None, "n")]}
    assert B.round_trip(df.limit(0), path, T.PATTERN).collect() == []


def test_memory_of_a_worker_is_bounded(both, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 10)
    seen = B._Remembered(lambda k: k + 1)
    assert [seen[k] for k in range(100)] == list(range(1, 101)) and len(seen) <= 10
    assert seen[0] == 1 and 4 in seen  # the older half stays


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        B.Codec(base64.b64encode(b"a") + b" 0\n", T.PATTERN)
