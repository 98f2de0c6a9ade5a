import random

from logloom.llm import divergence as D


def test_every_language_has_a_reference(spark):
    """Clean documents of the rarest of 70 languages are held against a reference of their own."""
    rng = random.Random(6)
    rows = []
    for k in range(70):
        common = ["".join(rng.choices("abcdefghijklmnop", k=3)) + str(k) for _ in range(10)]
        for _ in range(1 if k >= 64 else 2):
            rows.append((len(rows), " ".join(rng.choice(common) for _ in range(80)), f"l{k:02}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.lang for r in D.references(df)] == [f"l{k:02}" for k in range(70)]
    got = {r.doc_id: r for r in D.judged(df).collect()}
    assert all(got[i].kept and got[i].nearest == lang for i, _, lang in rows)
