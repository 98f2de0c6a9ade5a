import math
import random
import re
from collections import Counter

from logloom.llm import divergence as D
from logloom.llm.divergence_query import query

SF = "/root/testdata/sf0.001"
WHITE = r"[^\x20\x09-\x0D]+"


def words_of(text):
    return re.findall(WHITE, text or "")


def base_failed(words):
    n = len(words)
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return n < 20 or 100 * len(covered) > 30 * n


def classes(text):
    kind = lambda c: "l" if c in "abcdefghijklmnopqrstuvwxyz" else "u" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "d" if c in "0123456789" else "w" if c in " \t\n\x0b\x0c\r" else "s" if c in ".,;:!?'\"()-" else "a" if ord(c) < 128 else "b"
    return Counter(map(kind, text or ""))


def divergence(p, q):
    a, b = sum(p.values()) or 1, sum(q.values()) or 1
    total = 0.0
    for k in p.keys() | q.keys():
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        total += sum(z * math.log2(2 * z / (x + y)) for z in (x, y) if z) / 2
    return math.sqrt(max(total, 0))


def lowered(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def brute_force(docs):
    """{position: (kept, character distance, word distance)}"""
    read = [(i, t or "", lang, words_of(t)) for i, (t, lang) in enumerate(docs)]
    failed = {i: base_failed(w) for i, _, _, w in read}
    words, chars, n = {}, {}, Counter()
    for i, t, lang, w in read:
        if lang is not None and not failed[i]:
            words.setdefault(lang, Counter()).update(map(lowered, w))
            chars.setdefault(lang, Counter()).update(classes(t))
            n[lang] += 1
    every = sum(sum(c.values()) for c in words.values())
    sound = {x for x in words if n[x] >= 10 and sum(words[x].values()) >= 1000 and 10_000 * sum(words[x].values()) >= every} or set(words)
    top = {x: {w for w, _ in sorted(words[x].items(), key=lambda y: (-y[1], y[0].encode()))[:40]} for x in sound}
    binned = lambda counts, lang: Counter({w: c for w, c in counts.items() if w in top[lang]}) + Counter({None: sum(c for w, c in counts.items() if w not in top[lang])})
    merged = lambda c: Counter(l=c["l"] + c["u"] + c["w"] + c["b"], d=c["d"], s=c["s"], a=c["a"])
    out = {}
    for i, t, lang, w in read:
        mine = Counter(map(lowered, w))
        if lang is None or lang in sound:
            found = [(divergence(classes(t), chars[x]), divergence(binned(mine, x), binned(words[x], x))) for x in (sound if lang is None else [lang])]
            a, b = min(found, key=sum, default=(0, 0))
        else:
            a, b = min((divergence(merged(classes(t)), merged(chars[x])) for x in sound), default=0), 0
        out[i] = not failed[i] and (a <= 0.25 or len(t) < 400) and (b <= 0.4 or len(w) < 60), a, b
    return out


def test_junk_does_not_vouch_for_itself(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(60)]
    clean = lambda: " ".join(rng.choice(vocabulary) for _ in range(90))
    junk = lambda: " ".join("".join(rng.choices("3a7#f$9c%1", k=7)) for _ in range(90))
    docs = [(clean(), "en") for _ in range(50)] + [(junk(), "en"), (junk(), "zz"), (junk(), None), (clean(), None)] + [(" ".join("".join(rng.choices("дежзик", k=5)) for _ in range(90)), "ru")]
    got = {r.doc_id: r.kept for r in D.judged(spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i in range(50, 55)] == [False, False, False, True, True] and all(got[i] for i in range(50))
    assert got == {i: x[0] for i, x in brute_force(docs).items()}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    want = brute_force([(r.text, r.lang) for r in docs])
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    for i, r in enumerate(docs):
        x = got[r.doc_id]
        assert x.kept == want[i][0] and abs(x.char_distance - want[i][1]) < 1e-9 and abs(x.word_distance - want[i][2]) < 1e-9


def test_ties_very_long_texts_and_repeated_rows(spark):
    rng = random.Random(3)
    docs = [(" ".join(rng.sample([f"t{chr(97 + k)}" for k in range(26)] * 3, 78)), "aa") for _ in range(20)]  # every word as often as any other
    docs += docs[:3] + [(" ".join(rng.choice("abcdefgh") * 3 + str(rng.random()) for _ in range(60_000)), "aa")]
    got = {r.doc_id: r for r in D.judged(spark.createDataFrame([(i, *d, "x") for i, d in enumerate(docs)], "doc_id long, text string, lang string, nearest string")).collect()}
    want = brute_force(docs)
    assert {i: r.kept for i, r in got.items()} == {i: x[0] for i, x in want.items()}
    assert got[20].kept == got[0].kept and got[20].word_distance == got[0].word_distance
