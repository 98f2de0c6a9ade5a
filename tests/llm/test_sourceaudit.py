import random
import re

import numpy as np
import pytest

from logloom.llm import sourceaudit as A
from logloom.llm.sourceaudit_query import ORACLE_SQL, query

from .oracle import rows_of_frame, rows_of_sql

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_force(docs, least=3, top=200):
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [(terms_of(t), s) for t, x, s in docs if x == lang]
        df, count, every = {}, {}, {}
        for terms, s in mine:
            for t in set(terms):
                df[t] = df.get(t, 0) + 1
            for t in terms:
                count[s, t] = count.get((s, t), 0) + 1
                every[t] = every.get(t, 0) + 1
        kept = [t for t in df if df[t] >= least]
        sources = {s for _, s in mine}
        n = {s: sum(count.get((s, t), 0) for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (count.get((s, t), 0) + 1) // (n[s] + len(kept)) for s in sources for t in kept}
        all_n = sum(every[t] for t in kept)
        q = {t: 1 + 10**9 * (every[t] + 1) // (all_n + len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted((-sum(f(p[s, t], p[o, t]) for t in kept), o.encode()) for o in sources if o != s)
            own = sorted((-f(p[s, t], q[t]), t.encode()) for t in kept if count.get((s, t), 0) and p[s, t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, i) for part, found in (("pair", pairs), ("term", own)) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(1, *d, "x", 3) for d in docs], SCHEMA)


def got(spark, docs, **kw):
    found = A.audit(frame(spark, docs), **kw)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["Ünï", "日本", "é", "É", "don't", "a1b", "x_y", "Straße", "\u0080", " ", "😀s", "THE", "the"]
    texts = [None, "", " 123 ", "\n"] + [" ".join(rng.choices(words[: rng.choice((8, 20, 39))], k=rng.choice((3, 30, 200)))) for _ in range(60)]
    docs = [(rng.choice(texts), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "Z", None])) for _ in range(120)]
    docs += docs[:20] + [("the the tie", "en", "a")] * 50 + [("one two", "xx", "only")] * 4 + [("rare words", "yy", "s"), (None, "yy", "t"), ("", "zz", "u"), (None, "zz", "v")]
    return docs


@pytest.mark.parametrize("block", [20, 100_000])
def test_against_brute_force(spark, docs, block):
    assert got(spark, docs, block=block) == brute_force(docs)


def test_few_ranks_and_other_bounds(spark, docs):
    assert got(spark, docs, least=10, top=3, block=15) == brute_force(docs, 10, 3)


def test_long_texts_in_pieces(spark, docs, monkeypatch):
    long = " ".join(random.Random(1).choices(["alpha", "Beta", "gämma", "δ", "x" * 40], k=500))
    want = A.counted([long.encode()], np.zeros(1, np.int64))
    monkeypatch.setattr(A, "BLOCK_BYTES", 64)
    found = A.counted_long(long.encode())
    as_dict = lambda x: {x[4][t]: (n, d) for t, n, d in zip(*map(list, x[1:4]), strict=True)}
    assert as_dict(found) == as_dict(want) and b"".join(A._pieces(long.encode())) == long.encode()
    assert list(map(len, A._pieces(b"x" * 500))) == [500]


@pytest.mark.parametrize("digest", [lambda x: 7, lambda x: len(x), lambda x: x[0]])
def test_equal_hashes_do_not_join_terms(digest):
    data = np.frombuffer("ab ba ab é è ab cab xx ba".encode(), np.uint8)
    starts, ends = A.slices(data)
    of, terms = A.grouped(data, starts, ends, digest)
    assert [terms[i] for i in of] == [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] and len(set(terms)) == len(terms)


def test_p_is_exact_for_large_counts():
    for count, total in ((0, 1), (9, 10), (10**13, 8 * 10**13), (10**13, 10**13 + 1), (123456789, 987654321987)):
        assert A.p_of(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


def test_rows_without_entries_add_up_to_nothing():
    assert A.row_sums(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3, 3])).tolist() == [0, 3, 0, 3, 0]
    assert A.row_sums(np.zeros(0, np.int64), np.array([0, 0])).tolist() == [0]


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None, None)]) == []


def test_query_against_sql(spark):
    assert rows_of_frame(query(spark, SF)) == rows_of_sql(ORACLE_SQL, SF)
