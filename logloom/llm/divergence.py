"""Quality rules by distribution divergence.

Each language's reference is a histogram of character classes and one of its most common words (and all others), counted
over all documents of that language that pass the base rules. A document is compared with its language's reference by
Jensen-Shannon distance (square root of the divergence, base 2: 0 to 1) and fails if its characters or its words are too far.
Histograms of few characters or words say little: below `least_chars` or `least_words` that comparison is skipped.

References need a least size too, or a few junk rows under a language of their own would vouch for themselves and for others: a
sound one has `sound_docs` documents, `sound_words` words, and a ten-thousandth of all words, so that there are ten thousand at most.
A document without a language is compared with all sound references and takes the nearest. One whose language has no sound reference
is held against what texts of any language are made of: letters of any script and white space, against digits, stops and signs, at the
nearest of the sound references; its words are not judged. Where no reference is sound, as in small tables, all count as they are, if they
are fewer than `few_langs`; else, and without references at all, only the base rules count.

Words are runs without the ASCII white space \\x20 and \\x09-\\x0D. Nulls: a null text has no words; a null language makes
no reference. Repeated rows stay repeated and count repeatedly; words that are equally common rank by their bytes; extra columns stay
behind. Texts of any length are counted whole. An empty table has no references.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batch_of, kept, mixed

SYMBOLS = b"#*$%&|<>"
#: Character classes: small letters, capitals, digits, white space, ends and pauses, other ASCII signs, all others.
_CLASSES = ("lower", "upper", "digit", "space", "stop", "sign", "beyond")
_OF_BYTE = np.array([next(k for k, holds in enumerate((97 <= b <= 122, 65 <= b <= 90, 48 <= b <= 57, b in b" \t\n\x0b\x0c\r", b in b".,;:!?'\"()-", b < 128, True)) if holds) for b in range(256)])
_STARTS = np.array([b & 0xC0 != 0x80 for b in range(256)])
_WHITE = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])
_SYMBOL = np.array([b in SYMBOLS for b in range(256)])
WINDOW = 8


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of `width` words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    # equal words have equal 64-bit hashes; windows are told by a polynomial of those
    hashes = mixed(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = (count[which] > 1).astype(np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[width : width + n] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


@dataclass
class Counts:
    """What the rules count in one text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    classes: np.ndarray
    words: list[bytes]

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


def count(text: str | None) -> Counts:
    data = (text or "").encode()
    words = data.split()
    by_byte = np.where(_STARTS, np.bincount(np.frombuffer(data, np.uint8), minlength=256), 0)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return Counts(len(words), int(by_byte[~_WHITE].sum()), int(by_byte[_SYMBOL].sum()), len(lines) - len(set(lines)), repeat_words(words), np.bincount(_OF_BYTE, by_byte, len(_CLASSES)), words)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, which need not sum to one."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2

    def part(x):
        at = x > 0
        return float((x[at] * np.log2(x[at] / m[at])).sum())

    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


@dataclass
class Reference:
    lang: str
    classes: np.ndarray
    words: list[bytes]
    shares: np.ndarray  # of `words`, then of all others
    sound: bool = True


#: In the rows of counts, the number behind those of the character classes: documents.
_DOCS = len(_CLASSES)


def references(df: DataFrame, *, common_words: int = 40, sound_docs: int = 10, sound_words: int = 1000, few_langs: int = 4096) -> list[Reference]:
    """The sound references, or else all if they are few. `df` has text and lang; all its documents are counted."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("class_", pa.int32()), ("n", pa.int64())])

    def run(batches):
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def out():
            for lang, c in classes.items():
                names = list(words[lang])
                yield batch_of(schema, [lang] * len(names), names, [None] * len(names), list(words[lang].values()))
                yield batch_of(schema, [lang] * len(c), [None] * len(c), list(range(len(c))), [int(x) for x in c])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found = count(text.as_py())
                if not found.base_failed:
                    words.setdefault(lang, Counter()).update(w.lower() for w in found.words)
                    classes[lang] = classes.get(lang, 0) + np.append(found.classes, 1)
            if sum(map(len, words.values())) > 300_000:
                yield from out()
                words, classes = {}, {}
        yield from out()

    told = df.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, word binary, class_ int, n long")
    told = kept(told.groupBy("word", "class_", "lang").agg(F.sum("n").alias("n")))
    sizes = told.groupBy("lang").agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("total"), F.max(F.when(F.col("class_") == _DOCS, F.col("n"))).alias("docs"))
    every = sizes.agg(F.sum("total")).first()[0] or 0
    chosen = sizes.where((F.col("docs") >= sound_docs) & (F.col("total") >= sound_words) & (F.col("total") * 10_000 >= every))
    totals = {r.lang: r.total for r in chosen.collect()}  # ten thousand at most
    sound = bool(totals)
    if not sound:
        totals = {r.lang: r.total for r in sizes.limit(few_langs).collect()}
        totals = totals if len(totals) < few_langs else {}
        chosen = sizes
    if not totals:
        return []
    told = told.join(F.broadcast(chosen.select("lang")), "lang", "left_semi")
    # the most common words of a language are among those of the parts that its words are dealt into
    ranked = told.where("word is not null").withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64)))
    inner = ranked.withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("n"), "word"))).where(F.col("k") <= common_words).drop("k")
    top = inner.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= common_words)
    found, chars = defaultdict(list), defaultdict(lambda: np.zeros(len(_CLASSES)))
    for r in top.orderBy("lang", "k").collect():
        found[r.lang].append((bytes(r.word), r.n))
    for r in told.where((F.col("class_") < _DOCS)).collect():
        chars[r.lang][r.class_] = r.n
    out = []
    for lang in sorted(totals):
        mine, classes = found[lang], chars[lang]
        shares = np.array([n for _, n in mine] + [totals[lang] - sum(n for _, n in mine)], float) / totals[lang]
        out.append(Reference(lang, classes / classes.sum(), [w for w, _ in mine], shares, sound))
    return out


@dataclass
class Rules:
    """Limits of the distances, and the least lengths at which they hold."""

    chars_at_most: float = 0.25
    words_at_most: float = 0.4
    least_chars: int = 400
    least_words: int = 60


class Judge:
    #: Sums of character classes that texts of all languages share: letters and white space, digits, stops, signs.
    _shared = np.array([[k in group for k in _CLASSES] for group in (("lower", "upper", "space", "beyond"), ("digit",), ("stop",), ("sign",))], float)

    def __init__(self, found: list[Reference], rules: Rules):
        self.found, self.rules = found, rules
        self.number = {w: k for k, w in enumerate(sorted({w for r in found for w in r.words}))}
        self.bins = [np.array([self.number[w] for w in r.words], np.int64) for r in found]
        self.own = {r.lang: k for k, r in enumerate(found)}

    def distances(self, c: Counts, lang: str | None = None) -> tuple[str | None, float, float]:
        """(language, distance of characters, distance of words): to the language's own reference; without a language to the nearest one,
        by the sum of both distances; and where the language has no sound reference, of what any text is made of, with words left out."""
        if lang is not None and lang not in self.own and self.found:
            return lang, min(distance(self._shared @ c.classes, self._shared @ r.classes) for r in self.found), 0.0
        ids = np.fromiter(map(self.number.get, (w.lower() for w in c.words), repeat(-1)), np.int64, len(c.words))
        counts = np.bincount(ids[ids >= 0], minlength=len(self.number))
        among = range(len(self.found)) if lang is None else [self.own[lang]] if self.found else []

        def to(k: int):
            r, b = self.found[k], self.bins[k]
            return distance(c.classes, r.classes), distance(np.append(counts[b], len(ids) - counts[b].sum()), r.shares), r.lang

        best = min(map(to, among), key=lambda x: (x[0] + x[1], x[2]), default=(0.0, 0.0, None))
        return best[2], best[0], best[1]

    def passes(self, c: Counts, chars: float, words: float) -> bool:
        r = self.rules
        return not c.base_failed and (chars <= r.chars_at_most or c.classes.sum() < r.least_chars) and (words <= r.words_at_most or c.n_words < r.least_words)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, nearest string, char_distance double, word_distance double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("nearest", pa.string()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])


def judged(df: DataFrame, found: list[Reference] | None = None, rules: Rules | None = None) -> DataFrame:
    """Counts, distances and verdict of each row (doc_id, text, lang); references come from `df` itself if none are given."""
    found = references(df) if found is None else found
    sent = df.sparkSession.sparkContext.broadcast(Judge(found, rules or Rules()))  # of some words per language

    def run(batches):
        judge = sent.value
        for batch in batches:
            out = []
            for doc_id, text, told in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                c = count(text.as_py())
                lang, chars, words = judge.distances(c, told)
                out.append((doc_id, c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed, judge.passes(c, chars, words), lang, chars, words))
            if out:
                yield batch_of(_SCHEMA, *zip(*out, strict=True))

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, SCHEMA)
