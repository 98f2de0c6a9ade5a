import random
import zlib

import pytest

import corpus_pipeline as P
from logloom.llm import bpe, decontaminate, toxicity

from .test_simhash import plain_components, plain_fingerprint


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [f"w{i}o{i * 7 % 13}" for i in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(15, 40))) for i in range(10)]
    passage = text(60)
    docs, labels = [], []
    for i in range(260):
        t = text(rng.randint(5, 120))
        toxic = i % 5 == 0
        if toxic:
            t += " " + rng.choice(["idiot", "scum"])
        if i % 7 == 1:
            t = f"{t}\n{passage}"
        if i % 11 == 2:
            t = f"{text(9)} {rng.choice(items)[1]} {t}"
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "s", 1) for i in range(0, 60, 3)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (None, text(30), "en", "s", 5), docs[3], (2002, "é" * 120 + text(3), "fr", "s", 3), (2003, "x" + "é" * 120 + text(3), "fr", "s", 3)]
    rng.shuffle(docs)
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), docs, labels, items


def test_against_brute_force(spark, folder):
    out, docs, labels, items = folder
    stages = dict(P.STAGES)
    df = spark.read.parquet(f"{out}/documents.parquet")

    model = toxicity.train(df, spark.read.parquet(f"{out}/labels.parquet"), "crc32(cast(doc_id as string)) % 3 <> 1", sample_rows=P.SAMPLE_ROWS)
    left = [d for d in docs if model.score(d[1]) < 0.7]
    truth = dict((i, t) for i, _, t in labels)
    assert sum(truth.get(d[0], 0) for d in left) <= 2 and len(left) > 0.7 * len(docs)
    df = stages["toxicity"](spark, df, out)
    assert df.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(left, key=str)

    home = plain_components([(d[0], plain_fingerprint(d[1])) for d in left if d[0] is not None])
    left = list({d for d in left if d[0] is None or home[d[0]] == d[0]})
    df = stages["simhash_near_dedup"](spark, df, out)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(left, key=str)

    lowest = min(0, *(d[0] for d in left if d[0] is not None)) - 1
    removed = plain_rests([(d[0] if d[0] is not None else lowest, d[1]) for d in left])
    left = [(d[0], None if d[1] is None else (t := removed[d[0] if d[0] is not None else lowest]), *d[2:4], None if d[1] is None else len(t)) for d in left]
    df = stages["suffix_array_dedup"](spark, df, out)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(left, key=str)

    from .test_decontaminate import plain_align

    alike = lambda t: any(plain_align(w, decontaminate.words(t))[1] >= 0.8 * len(w) for w in (decontaminate.words(x) for _, x in items))
    left = [d for d in left if not alike(d[1])]
    df = stages["decontamination"](spark, df, out)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(left, key=str)

    with open(P.public_tokenizers.path(P.RANKS), "rb") as f:
        codec = bpe.codec(f.read(), P.public_tokenizers.PATTERN)
    counts = sorted((str(d[0]), len(codec.encode(d[1] or "")) // 4) for d in left)
    assert sorted((str(r.doc_id), r.n_tokens) for r in P.run(spark, out).collect()) == counts
    assert zlib.crc32(b"") == 0


def plain_rests(docs, depth=100):
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - depth + 1):
            if seen.setdefault(b[p : p + depth], (i, p)) != (i, p):
                gone[p : p + depth] = [True] * depth
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
    return out


def test_empty_table(spark, folder):
    out = folder[0]
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, out)
        assert docs.collect() == []
