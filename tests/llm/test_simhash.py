from itertools import combinations

import pytest
import xxhash

from logloom.llm import simhash as S


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    ids = {i: i for i, _ in rows}

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for (i, x), (j, y) in combinations(rows, 2):
        if (x ^ y).bit_count() <= 3:
            a, b = sorted((root(i), root(j)))
            ids[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t", "one", "One two", "a b c", "A b c d a b c d", "x\x0by\x1cz ü Ü é" * 50])
def test_fingerprint(text):
    assert S.simhash(text) == plain_fingerprint(text)


@pytest.mark.parametrize("large", [4096, 2])
def test_components(spark, large):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 8, 300]))) for _ in range(40)]
    docs = [(i, x) for i, x in enumerate([*base, *base[:9], None, ""])]
    for i in range(60):  # edits of long texts move few bits
        x = rng.choice([b for b in base if len(b) > 500]).split()
        x[rng.randrange(len(x))] = "other"
        docs.append((1000 + i, " ".join(x)))
    rng.shuffle(docs)
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, fp int, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df, large=large).collect()}
    marked = [(i, plain_fingerprint(t)) for i, t in docs]
    expected = plain_components(marked)
    assert got == {i: (f"{f:016x}", expected[i]) for i, f in marked}
    assert len(set(expected.values())) < 60


@pytest.mark.parametrize("large", [4096, 3])
def test_links_connect_what_is_near(spark, large):
    import random

    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for x in list(fps):
        for _ in range(12):
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), large=large).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 and r.a != r.b for r in found)
    edges = [((r.a, r.b)) for r in found]
    rows = [(s, s & (1 << 64) - 1) for s in signed]
    expected = plain_components(rows)
    parent = {s: s for s in signed}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[root(a)] = root(b)
    assert len({root(s) for s in signed}) == len(set(expected.values()))
    for s in signed:
        assert root(s) == root(expected[s])


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
