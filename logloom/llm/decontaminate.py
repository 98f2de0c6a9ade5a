"""Benchmark decontamination: rare seeds and Smith-Waterman alignment of words.

Similarity of a text and a test item is the share of the item's words that the best alignment (Smith-Waterman; match 2,
mismatch and gap -1) with the text matches. A first pass over all training texts counts in how many each word of the items
occurs. An item's seeds are the rarest of its words, so many that no alignment of the similarity asked for misses them all. In
a second pass, a text and an item that share a seed are a candidate pair if the words they have in common, within the reach of
an alignment around the seed, are enough; only then they are aligned there. No such pair is lost, however many texts an item
has leaked into and wherever its copies were edited.

Test items are read in blocks of at most `block_bytes` of text, each of which is sent to all tasks; a larger benchmark
takes more passes over the texts, not more memory. Words are runs of ASCII letters, digits and non-ASCII bytes, lower case.

Nulls: null or empty texts and items match nothing. Repeated rows of texts give repeated results; of items with
the same id, each text counts as one item of that id, and the best match is returned. Null doc_ids are kept, items without an id left out.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, texts

MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the number of matches in a cell that holds it below the score.
_BITS = 24
_SIMPLER = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32) for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SIMPLER).split()


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(score, matches) of the best local alignment of two rows of word numbers; of equal scores that of most matches.

    A row of cells at a time: a gap along the row is a running maximum once its cost is added back place by place.
    """
    ramp = np.arange(len(text) + 1, dtype=np.int64) * (-GAP << _BITS)
    row, best = np.zeros(len(text) + 1, np.int64), 0
    for word in item.tolist():
        new = np.zeros_like(row)
        new[1:] = row[:-1] + np.where(text == word, (MATCH << _BITS) + 1, MISMATCH * (1 << _BITS))
        np.maximum(new, row + (GAP << _BITS), out=new)
        new = np.maximum.accumulate(new + ramp) - ramp
        row = np.maximum(new, 0)
        # what is below one point of score is no alignment
        row[row < 1 << _BITS] = 0
        best = max(best, int(row.max()))
    return best >> _BITS, best & (1 << _BITS) - 1


class Seeds:
    """The words of a block of test items, ready for the search in texts.

    An alignment that matches at least `least` words of an item misses `len - least` of them at most, so it matches one of any
    `len - least + 1` of its words. Those that occur in the fewest texts are the item's seeds.
    """

    def __init__(self, items: list[tuple[int, str | None]], similarity: float):
        found = [(i, w) for i, text in sorted(items, key=lambda x: (x[0], x[1] or "")) if (w := words(text))]
        self.ids = [i for i, _ in found]
        self.number = {w: k for k, w in enumerate(sorted({w for _, ws in found for w in ws}))}
        self.items = [np.array([self.number[w] for w in ws], np.int64) for _, ws in found]
        self.counted = [np.unique(item, return_counts=True) for item in self.items]
        self.least = [next((m for m in range(1, len(item) + 1) if m / len(item) >= similarity), len(item) + 1) for item in self.items]

    def numbers(self, text: str | None) -> np.ndarray:
        ws = words(text)
        return np.fromiter(map(self.number.get, ws, repeat(-1)), np.int64, len(ws))

    def by_seed(self, texts_with: np.ndarray) -> dict[int, list[int]]:
        """The items of each seed, given in how many texts each word occurs."""
        out = defaultdict(list)
        for k, (item, least) in enumerate(zip(self.items, self.least, strict=True)):
            for w in set(item[np.lexsort((item, texts_with[item]))][: len(item) - least + 1].tolist()):
                out[w].append(k)
        return dict(out)

    def spans(self, item: int, numbers: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """Parts of the text in which `least` words of the item can be aligned with a word at one of the places `at` among them.

        A word that is passed over in the text costs a point and a match gains two: an alignment of a positive score reaches
        over less than three times the item's words, all of them to either side of a place at most.
        """
        reach, least = 3 * len(self.items[item]), self.least[item]
        edges = np.flatnonzero(at[1:] - at[:-1] > 2 * reach)
        groups = zip(at[np.append(0, edges + 1)].tolist(), at[np.append(edges, len(at) - 1)].tolist(), strict=True)
        which, most = self.counted[item]
        out = []
        for first, last in groups:
            lo, hi = max(0, first - reach), min(len(numbers), last + reach + 1)
            part = numbers[lo:hi]
            k = np.minimum(np.searchsorted(which, part), len(which) - 1)
            mine = np.flatnonzero(which[k] == part)
            if np.minimum(np.bincount(k[mine], minlength=len(which)), most).sum() < least:
                continue
            # of the item's words in the text, `least` in a row that stand within reach
            near = np.flatnonzero(mine[least - 1 :] - mine[: len(mine) - least + 1] < reach)
            for i in near.tolist():
                a, b = lo + int(mine[i]), lo + int(mine[i]) + reach
                if out and a <= out[-1][1]:
                    out[-1] = out[-1][0], max(b, out[-1][1])
                else:
                    out.append((a, b))
        return [(a, b) for a, b in out if self._holds(item, numbers[a:b])]

    def _holds(self, item: int, part: np.ndarray) -> bool:
        """Whether the words that part and item share, as often as both have them, are enough."""
        which, most = self.counted[item]
        k = np.minimum(np.searchsorted(which, part), len(which) - 1)
        return np.minimum(np.bincount(k[which[k] == part], minlength=len(which)), most).sum() >= self.least[item]

    def matches(self, text: str | None, by_seed: dict[int, list[int]], is_seed: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item_id, words, matched words, similarity) of the items that are candidates for the text."""
        numbers = self.numbers(text)
        at = np.flatnonzero(is_seed[numbers])  # -1 reads the last place, which is no seed
        by_item = defaultdict(list)
        for p, seed in zip(at.tolist(), numbers[at].tolist(), strict=True):
            for item in by_seed[seed]:
                by_item[item].append(p)
        best: dict[int, tuple[float, int, int]] = {}
        for item, places in by_item.items():
            length = len(self.items[item])
            for lo, hi in self.spans(item, numbers, np.array(places)):
                matched = align(self.items[item], numbers[lo:hi])[1]
                i = self.ids[item]
                best[i] = max(best.get(i, (0.0, 0, 0)), (matched / length, length, matched))
        return [(i, length, matched, similarity) for i, (similarity, length, matched) in sorted(best.items())]


def _blocks(items: DataFrame, block_bytes: int):
    """Lists of items, each of at most `block_bytes` of text (or one item). Only one is on the driver at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        n = len(r.text or "") * 4 + 100
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")


_FOUND = "doc_id long, item_id long, n_words long, n_matched long, similarity double"


def contaminated(df: DataFrame, items: DataFrame, *, similarity: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, n_words, n_matched, similarity) of each text and test item that are alike by `similarity` or more."""
    docs, out = texts(df), None
    spark = df.sparkSession
    for block in _blocks(_items(items), block_bytes):
        part = _against(docs, spark.sparkContext.broadcast(Seeds(block, similarity)), similarity)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], _FOUND)


def _chosen(docs: DataFrame, sent):
    """The block and what is chosen as its seeds after counting in how many texts each of its words occurs."""
    counts = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def count(batches):
        seeds = sent.value
        total = np.zeros(len(seeds.number), np.int64)
        for batch in batches:
            for text in batch.column("text"):
                numbers = seeds.numbers(text.as_py())
                total[np.unique(numbers[numbers >= 0])] += 1
        at = np.flatnonzero(total)
        yield batch_of(counts, at, total[at])

    # as many rows as the block has words, whatever the corpus
    told = docs.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    texts_with = np.zeros(len(sent.value.number), np.int64)
    for r in told:
        texts_with[r.word] = r.n
    by_seed = sent.value.by_seed(texts_with)
    is_seed = np.zeros(len(texts_with) + 1, bool)
    is_seed[np.array(list(by_seed), np.int64)] = True
    return sent, docs.sparkSession.sparkContext.broadcast((by_seed, is_seed))


def _against(docs: DataFrame, sent, similarity: float) -> DataFrame:
    found = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int64()), ("n_matched", pa.int64()), ("similarity", pa.float64())])

    _, chosen = _chosen(docs, sent)

    def search(batches):
        seeds = sent.value
        for batch in batches:
            out = [(i, *m) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for m in seeds.matches(text.as_py(), *chosen.value) if m[3] >= similarity]
            if out:
                yield batch_of(found, *zip(*out, strict=True))

    return docs.mapInArrow(search, _FOUND)


def clean(df: DataFrame, items: DataFrame, *, similarity: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """`df` without the rows whose text contains a test item; all columns stay. Each row is judged by its own text, whatever its id."""
    for block in _blocks(_items(items), block_bytes):
        df = _left(df, *_chosen(texts(df), df.sparkSession.sparkContext.broadcast(Seeds(block, similarity))), similarity)
    return df


def _left(df: DataFrame, sent, chosen, similarity: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            dirty = [any(m[3] >= similarity for m in sent.value.matches(t.as_py(), *chosen.value)) for t in batch.column("text")]
            yield batch.filter(pa.array([not d for d in dirty], pa.bool_()))

    return df.mapInArrow(run, df.schema)
