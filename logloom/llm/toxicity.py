"""Toxicity: a logistic classifier over words that is held to equal scores when identity terms are swapped.

Training takes a bounded sample of labelled rows (`sample_rows`, by a hash of the id), counts which features go with the
label on the executors, keeps the `n_features` that tell most, and fits their weights. A labelled text that names a group
also gives its counterfactuals, in which the term stands for another one of its group in the text's language: differences of
their log-odds are penalised in the fit, so that weight does not settle on the mention of a group. `Model.pairs` says how many
counterfactuals there were; without any, the penalty does nothing. Only whole texts are read, in training and in scoring; ids,
sources and languages are no features.

Nulls: a null text scores as the empty one, which has the score of the intercept. Labels of null ids or null labels are
left out, and an id with several labels counts as toxic if one says so. Without any label of one of the two kinds, all
scores are the (smoothed) share of toxic rows. Repeated rows stay repeated.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, cut, texts

# For each language, groups of terms that name people neutrally; terms of a group replace each other.
IDENTITY_TERMS = {
    "en": (
        ("women", "men", "girls", "boys"),
        ("woman", "man", "girl", "boy"),
        ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
        ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "african", "european"),
        ("gay", "lesbian", "bisexual", "straight", "transgender"),
        ("immigrant", "refugee", "foreigner", "citizen"),
        ("immigrants", "refugees", "foreigners", "citizens"),
        ("old", "young", "elderly", "disabled", "blind", "deaf"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"),
        ("frau", "mann"),
        ("christ", "muslim", "jude", "hindu", "buddhist", "atheist"),
        ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
        ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
        ("schwule", "lesben", "bisexuelle", "heterosexuelle", "transgender"),
        ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
        ("alte", "junge", "behinderte", "blinde", "gehörlose"),
    ),
    "es": (
        ("mujeres", "hombres", "niñas", "niños"),
        ("mujer", "hombre", "niña", "niño"),
        ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
        ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
        ("negros", "blancos", "asiáticos", "latinos", "africanos", "europeos"),
        ("gays", "lesbianas", "bisexuales", "heterosexuales", "transexuales"),
        ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
        ("ancianos", "jóvenes", "discapacitados", "ciegos", "sordos"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons"),
        ("femme", "homme", "fille", "garçon"),
        ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
        ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
        ("noirs", "blancs", "asiatiques", "africains", "européens"),
        ("gays", "lesbiennes", "bisexuels", "hétérosexuels", "transgenres"),
        ("immigrés", "réfugiés", "étrangers", "citoyens"),
        ("vieux", "jeunes", "handicapés", "aveugles", "sourds"),
    ),
}


def groups_of(groups, lang: str | None = None) -> tuple:
    """The groups of a text's language; all, if that is not known or `groups` are not told apart by language."""
    if not isinstance(groups, dict):
        return tuple(groups)
    return tuple(groups[lang]) if lang in groups else tuple(g for one in groups.values() for g in one)


#: Upper case to lower case, and what is no letter or digit in ASCII to a space; other bytes stay.
_SIMPLER = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32) for b in range(256))


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(_SIMPLER).split())


def features(found: set[bytes]) -> set[bytes]:
    """Each word, and beginnings of four and five bytes of longer ones, told apart by a mark."""
    longer = [w for w in found if len(w) > 4]
    return found | {w[:4] + b"*" for w in longer} | {w[:5] + b"*" for w in longer}


def swaps(found: set[bytes], groups=IDENTITY_TERMS) -> list[set[bytes]]:
    """The words of a text's counterfactuals: all its terms of a group replaced by one that it lacks, once for each."""
    out = []
    for group in groups_of(groups):
        terms = [t.encode() for t in group]
        if here := found.intersection(terms):
            out += [found - here | {other} for other in terms if other not in here]
    return out


@dataclass
class Model:
    intercept: float
    weight: dict[bytes, float]
    pairs: int = 0  # counterfactual pairs that the fit saw

    def log_odds(self, found: set[bytes]) -> float:
        weight = self.weight
        return self.intercept + sum(sorted(weight[f] for f in features(found) if f in weight))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.log_odds(words(text)), -40, 40))))


def labelled(df: DataFrame, labels: DataFrame, usable, sample_rows: int) -> DataFrame:
    """(doc_id, text, label, lang) of at most `sample_rows` labelled rows: those of the smallest hashes of the id."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(usable).where("doc_id is not null and label is not null")
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    lang = F.col("lang").cast("string") if "lang" in df.columns else F.lit(None).cast("string")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    return docs.join(F.broadcast(chosen), "doc_id")  # of `sample_rows` rows at most


def _told(batches):
    """How many toxic and other texts of the task have each feature."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    schema = pa.schema([("feature", pa.binary()), ("toxic", pa.int64()), ("other", pa.int64())])
    total = [0, 0]
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            counts[label > 0].update(features(words(text.as_py())))
            total[label > 0] += 1
    names = sorted(counts[0].keys() | counts[1].keys())
    for k in range(0, len(names), 20_000):
        part = names[k : k + 20_000]
        yield batch_of(schema, part, [counts[1][f] for f in part], [counts[0][f] for f in part])
    yield batch_of(schema, [b""], total[1:], total[:1])


def _fit(x, y, pairs, n: int, ridge: float, fairness: float, rounds: int = 400) -> np.ndarray:
    """Weights (the intercept last) by accelerated gradient descent on mean log-loss, ridge and the mean squared log-odds
    differences of the counterfactual pairs. x: rows and columns of ones. pairs: row, column and +1 or -1."""
    (row, col), (prow, pcol, sign) = x, pairs
    m = prow.max() + 1 if len(prow) else 1
    w = v = np.zeros(n + 1)
    per_row = np.bincount(row, minlength=len(y)).max(initial=0) + 1
    step = 1 / (0.25 * per_row + ridge + 2 * fairness * (np.bincount(prow).max() if len(prow) else 0))
    for k in range(rounds):
        z = np.bincount(row, v[col], len(y)) + v[n]
        slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.bincount(col, slope[row], n + 1) + ridge / len(y) * v
        grad[n] = slope.sum()
        if len(prow):
            apart = np.bincount(prow, sign * v[pcol], m)
            grad += 2 * fairness / m * np.bincount(pcol, sign * apart[prow], n + 1)
        # features differ in how often they occur: each gets a step by its own count
        scale = step * len(y) / (np.bincount(col, minlength=n + 1) + 1.0 + np.bincount(pcol, minlength=n + 1) * (len(y) / m) * fairness)
        scale[n] = step * 4
        new = v - scale * grad * 4
        v, w = new + k / (k + 3) * (new - w), new
    return w


def train(df: DataFrame, labels: DataFrame, usable="true", *, sample_rows: int = 20_000, n_features: int = 2000, min_texts: int = 5, least_deviations: float = 4.0, ridge: float = 0.05, fairness: float = 1.0, groups=IDENTITY_TERMS) -> Model:
    """Fits a model to labelled rows that `usable` (a condition on doc_id) lets in. See the module for what is bounded."""
    rows = cut(labelled(df, labels, usable, sample_rows))
    told = rows.select("text", "label").mapInArrow(_told, "feature binary, toxic long, other long")
    told = cut(told.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))
    total = told.where(F.length("feature") == 0).first()
    positive, negative = (total.toxic, total.other) if total else (0, 0)
    base = float(np.log((positive + 1) / (negative + 1)))
    if not positive or not negative:
        return Model(base, {})
    # the distance of a feature's share among toxic texts from that among others, in standard deviations
    share = (F.col("toxic") + F.col("other") + 1) / (positive + negative + 2)
    tells = F.abs((F.col("toxic") + share) / (positive + 1) - (F.col("other") + share) / (negative + 1)) / F.sqrt(share * (1 - share) * (1 / (positive + 1) + 1 / (negative + 1)))
    best = told.where(F.length("feature") > 0).where(F.col("toxic") + F.col("other") >= min_texts).where(tells >= least_deviations).orderBy(tells.desc(), "feature").limit(n_features).collect()
    terms = {f for group in groups_of(groups) for t in group for f in features({t.encode()})}
    index = {f: i for i, f in enumerate(sorted({bytes(r.feature) for r in best} | terms))}
    known = df.sparkSession.sparkContext.broadcast(index)  # of n_features and the terms

    def reduce(batches):
        index = known.value
        schema = pa.schema([("label", pa.int32()), ("found", pa.list_(pa.int32())), ("swapped", pa.list_(pa.list_(pa.int32())))])
        for batch in batches:
            out = []
            for text, label, lang in zip(batch.column("text"), batch.column("label").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                has = words(text.as_py())
                pick = lambda s: sorted(index[f] for f in features(s) if f in index)
                out.append((int(label > 0), pick(has), [pick(s) for s in swaps(has, groups_of(groups, lang))]))
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    rows = rows.select("text", "label", "lang").mapInArrow(reduce, "label int, found array<int>, swapped array<array<int>>").collect()
    rows.sort(key=lambda r: (r.label, r.found))
    x = tuple(np.array([v for i, r in enumerate(rows) for v in c(i, r)], np.int64) for c in (lambda i, r: [i] * len(r.found), lambda i, r: r.found))
    pairs, m = [], 0
    for r in rows:
        for other in r.swapped:
            pairs += [(m, f, 1) for f in set(r.found).difference(other)] + [(m, f, -1) for f in set(other).difference(r.found)]
            m += 1
    pairs = np.array(pairs, np.int64).reshape(-1, 3).T
    w = _fit(x, np.array([r.label for r in rows], float), pairs, len(index), ridge, fairness)
    return Model(float(w[-1]), {f: float(w[i]) for f, i in index.items() if w[i]}, m)


def score(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row's whole text, between 0 and 1."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        m = sent.value
        for batch in batches:
            yield batch_of(schema, batch.column("doc_id"), [m.score(x.as_py()) for x in batch.column("text")])

    return texts(df).mapInArrow(run, "doc_id long, score double")


def judge(df: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """`df` without the rows whose text scores `threshold` or more. All columns stay."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(x.as_py()) < threshold for x in batch.column("text")], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def largest(model: Model, n: int = 20) -> list[tuple[bytes, float]]:
    """The features of the largest weights, for a look at what the model goes by."""
    return heapq.nlargest(n, model.weight.items(), key=lambda x: abs(x[1]))
