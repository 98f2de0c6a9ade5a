import random

from logloom.llm import toxicity as T


def test_mentions_in_each_language(spark):
    rng = random.Random(2)
    for lang, term, other in (("de", "juden", "christen"), ("es", "judíos", "ateos"), ("fr", "juifs", "athées")):
        docs, labels = [], []
        for i in range(400):
            toxic = rng.random() < 0.3
            ws = [f"word{rng.randrange(200)}" for _ in range(20)] + ["idiot"] * toxic + [term] * (rng.random() < (0.5 if toxic else 0.05))
            docs.append((i, " ".join(ws), lang))
            labels.append((i, int(toxic)))
        df, told = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
        fair, free = T.train(df, told, fairness=20.0), T.train(df, told, fairness=0.0)
        gap = lambda m: abs(m.log_odds(T.words(f"word1 {term}")) - m.log_odds(T.words(f"word1 {other}")))  # noqa: B023, E731
        assert fair.pairs > 50 and gap(fair) < 0.3 * gap(free)


def test_terms_of_other_languages_stay():
    found = T.words("das sagt man so")
    assert T.swaps(found, T.groups_of(T.IDENTITY_TERMS, "de")) == [] and T.swaps(found)
