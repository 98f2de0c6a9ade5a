import random

import public_tokenizers as T
import pytest
from tokenizers import Tokenizer

from logloom.llm import resync as R

PATH = T.path("word_bpe_49k.json")
PARTS = ["abc", "internationalisation", "'s'll've''re", " \t\n\r\x0b\x0c", "\x85\xa0　\x1c", "日本語", "ȩ́", "́", "한글", "각", "🙂👍🏽", "0123²½", "===--->", "<|endoftext|>", "<|startoftext|>", "İΣσς", "ﬁ", "don't", "≮", "̈́", "the and ", "ǅ", "_", "é", "\x00\x7f"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, encoding="utf-8") as f:
        return R.Library(f.read())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def true(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def mixed(rng, n, parts=PARTS):
    return "".join(rng.choice(parts)[: rng.randint(1, 20)] for _ in range(n))


@pytest.mark.parametrize("seed", range(20))
def test_words_add_up_to_the_text(library, tokenizer, seed):
    rng = random.Random(seed)
    for _ in range(30):
        text = mixed(rng, rng.randint(0, 60))
        assert library.count(text) == true(tokenizer, text), repr(text)


def test_what_a_worker_remembers_is_bounded(library, tokenizer, monkeypatch):
    monkeypatch.setattr(R, "REMEMBERED", 20)
    library.counts.clear()
    for k in range(30):
        text = " ".join(f"w{k}x{i} same" for i in range(15)) + " " + "y" * 100
        assert library.count(text) == true(tokenizer, text) and len(library.counts) <= 20


def spliced(library, text, chunk, overlap):
    """The tokens by chunks, or nothing where a zone has no proven splice; as the jobs do it."""
    total = 0
    n_chunks = -(-len(text) // chunk)
    before, last = None, 0
    for k in range(n_chunks):
        start, end = max(k * chunk - overlap, 0), min((k + 1) * chunk + overlap, len(text))
        n, found = R.borders(library, text[start:end], 0, end - start)
        if before is not None:
            left, low = before
            right = {p + start: (t, e, nxt, touches) for p, t, e, _, nxt, touches in found if low <= p + start}
            got = R.splice(library, left, right)
            if got is None:
                return None
            total += got[0] - got[1] - last
        if k == n_chunks - 1:
            return total + n
        zone = (k + 1) * chunk - overlap
        plain_end = R.same_class_until(text[start:end], zone - start) + start
        left = {p + start: (t, e, prev, not R.may_combine(text[p + start]), p + start < plain_end) for p, t, e, prev, _, _ in found if zone + R.MARGIN <= p + start <= min((k + 1) * chunk + overlap, len(text)) - R.MARGIN}
        before, last = (left, zone + R.MARGIN), n
        total += n
    return total


@pytest.mark.parametrize("seed", range(25))
def test_splices_are_those_of_the_whole_text(library, tokenizer, seed):
    rng = random.Random(seed)
    found = 0
    for _ in range(12):
        parts = rng.sample(PARTS, rng.randint(1, 6))
        text = mixed(rng, 200, parts)
        got = spliced(library, text, 150, 40)
        found += got is not None
        assert got in (None, true(tokenizer, text)), repr(text)
    assert found


@pytest.mark.parametrize("text", ["internationalisierungen" * 60, "=" * 999, "#=-" * 400, "xyzzyq" * 200, "日本語" * 300, "<|endoftext|>" * 80, "1234" * 200, "''s" * 300])
def test_splices_inside_long_runs(library, tokenizer, text):
    for chunk in range(100, 130):
        assert spliced(library, text, chunk, 40) in (None, true(tokenizer, text))


def test_a_long_word_is_spliced_inside(library, tokenizer):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    assert spliced(library, text, 500, 60) == true(tokenizer, text)


def test_pairs_that_would_merge_do_not_stay_apart(library):
    vocab = library.tokenizer.get_vocab()
    assert not library.stay_apart(vocab["i"], vocab["n"]) and not library.stay_apart(vocab["th"], vocab["e</w>"])
    assert library.stay_apart(vocab["q"], vocab["z"])


def test_counts_of_a_table(library, tokenizer, spark):
    rng = random.Random(1)
    huge = [mixed(rng, 900), "a" * 5000, "ab" * 3000, " " * 4000, "日本語" * 1500, " ".join("tie" for _ in range(1500)), "=" * 4000, "é" * 2000]
    texts = [None, "", "Hello wörld's\n\n 42", "same", "same", *huge, huge[0], "<|endoftext|>" * 300]
    data = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "null id", 1), (None, huge[0], 1), (3, "same", 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_tokens int")
    want = sorted((-1 if i is None else i, len((t or "").encode()), true(tokenizer, t), true(tokenizer, t) > 900) for i, t, _ in data)
    for chunk, overlap in ((400, 64), (1000, 32), (1 << 16, 256)):
        got = R.token_counts(df, PATH, chunk=chunk, overlap=overlap, limit=900)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want
    assert R.token_counts(df.limit(0), PATH).collect() == []


def test_parameters(spark):
    with pytest.raises(ValueError):
        R.token_counts(spark.createDataFrame([(1, "x")], "doc_id long, text string"), PATH, chunk=40, overlap=30)


def test_query_against_the_library(tokenizer, spark):
    from logloom.llm.resync_query import query

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), true(tokenizer, r.text)) for r in docs)
    got = query(spark, sf).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 2048) for r in got)
