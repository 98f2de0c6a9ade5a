import random

import numpy as np
import pytest

from logloom.llm import divergence as D


def plain_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    return len(marked)


@pytest.mark.parametrize("seed", range(20))
def test_repeat_words(seed):
    rng = random.Random(seed)
    words = [rng.choice([b"a", b"b", b"c"][: 1 + seed % 3]) for _ in range(rng.randint(0, 60))]
    words += words[5:20] if seed % 2 else []
    assert D.repeat_words(words) == plain_repeats(words)


def test_counts():
    text = "Ab#c $% é x\n  \nline\x0bone\nline\x0bone\n\nline\x0bone\nend"
    c = D.count(text)
    words = text.encode().split()
    assert c.n_words == len(words) and c.word_chars == sum(len(w.decode()) for w in words)
    assert (c.n_symbols, c.n_dup_lines) == (3, 2)
    assert c.classes.sum() == len(text)
    empty = D.count(None)
    assert (empty.n_words, empty.word_chars, empty.n_dup_lines, empty.n_repeat_words, empty.base_failed) == (0, 0, 0, 0, True)


def test_distance():
    p, q = np.array([0.5, 0.5, 0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert D.distance(p * 8, q * 4) == pytest.approx(((kl(p) + kl(q)) / 2) ** 0.5)
    assert D.distance(np.array([1, 0]), np.array([0, 2])) == 1 and D.distance(p, p) == 0


def docs():
    rng = random.Random(4)
    common = {"xx": ["the", "of", "and", "to"], "yy": ["der", "die", "und", "zu"]}
    out = []
    for i in range(200):
        lang = rng.choice(["xx", "yy"])
        out.append((i, " ".join(rng.choice(common[lang]) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh", k=6)) for _ in range(150)), lang))
    out.append((500, " | ".join("".join(rng.choices("ABCDEFGH#", k=6)) for _ in range(150)), "xx"))
    out += [(501, None, "xx"), (502, "", None), (503, "word " * 100_000, "yy"), (None, "short text", None)]
    return out


def test_verdicts(spark):
    df = spark.createDataFrame([(*d, 1) for d in docs()], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: r for r in D.judged(df).collect()}
    assert all(got[i].kept for i in range(200)) and all(got[i].nearest == lang for i, _, lang in docs()[:200])
    assert not any(got[i].kept for i in (500, 501, 502, 503, None))
    assert not got[500].base_failed and got[503].n_repeat_words == 100_000
    for r in D.references(df):
        counts = {}
        for _, t, lang in docs():
            if lang == r.lang and not D.count(t).base_failed:
                for w in t.encode().lower().split():
                    counts[w] = counts.get(w, 0) + 1
        best = sorted(counts, key=lambda w: (-counts[w], w))[:40]
        assert r.words == best
        assert r.shares[:-1] == pytest.approx([counts[w] / sum(counts.values()) for w in best]) and r.shares.sum() == pytest.approx(1)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert D.references(empty) == [] and D.judged(empty).collect() == []
    one = spark.createDataFrame([(1, "a b " * 5, None)], "doc_id long, text string, lang string")
    assert [r.kept for r in D.judged(one).collect()] == [False]
