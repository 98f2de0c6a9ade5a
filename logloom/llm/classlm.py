"""Language-model scores from Brown class bigrams.

Words are put into classes by exchange clustering: a word moves to the class where the likelihood of the class bigrams gains
most. It runs in two stages. First the `n_items` most frequent words, and the endings that all others share, are exchanged one
by one until nothing moves; that fixes a table of class bigrams. Then every other word that occurs `min_count` times or more
is exchanged against that table: counts of its neighbours' classes, from all training texts, are gathered by word, and the
executors put each into the class that gains most. Rarer words, known or not, keep the class of their ending, so every word
has one. The bigrams are then counted anew by the new classes.

How many words are clustered grows with the corpus. Their table (a hash, a count and a class each) goes to all tasks; its size
is bounded by `most_words`, and where more words than that reach `min_count`, the threshold rises to what the bound lets in.

A text's probability is the product over its tokens of class given class before and word given class; both are smoothed and
sum to one. Counts of words that no table holds are found by a shuffle: such words are filed under a hash into as many buckets
as their number asks for, so that each bucket fits in memory; a bucket has all occurrences of its words, counts them, and gives
every text its sum of logarithms. Frequent words, which would make a bucket hot, never go there. A text's sums meet in one of
many homes.

Nulls: a null text is empty and has the token `end` only. A null doc_id is held out. Rows that repeat both id and text are
counted as often as they occur and get equal results. Without training texts, all words are unknown.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, held_out, kept, mixed, texts, words_of

#: Bytes of an ending.
ENDING = 3
UNSEEN = 0.1
#: Less frequent words' tokens in a bucket, about.
BUCKET = 2_000_000


def _g(x):
    """x log x, the terms of the bigrams' likelihood."""
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, n_classes: int, sweeps: int = 12) -> np.ndarray:
    """Class of each item, given how often item j follows item i. Starts from ranks of frequency, modulo the classes."""
    n = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    cls = np.empty(n, np.int64)
    cls[order] = np.arange(n) % n_classes
    follows = np.zeros((n, n_classes), np.float64)  # per item: what follows it, and what it follows, by class
    leads = np.zeros((n, n_classes), np.float64)
    for k in range(n_classes):
        follows[:, k] = pairs[:, cls == k].sum(1)
        leads[:, k] = pairs[cls == k].sum(0)
    table = np.stack([follows[cls == k].sum(0) for k in range(n_classes)])

    for _ in range(sweeps):
        moved = 0
        for v in order:
            old, own = cls[v], float(pairs[v, v])
            out, into = follows[v].copy(), leads[v].copy()
            out[old] -= own
            into[old] -= own
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= own
            known, cell = _g(table), np.diag(table)
            rows, columns = table.sum(1) + into, table.sum(0) + out
            row = _g(table + out) - known
            column = _g(table + into[:, None]) - known
            gain = row.sum(1) - np.diag(row) + column.sum(0) - np.diag(column) + _g(cell + out + into + own) - _g(cell)
            gain -= _g(rows + out.sum() + own) - _g(rows) + _g(columns + into.sum() + own) - _g(columns)
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            table[new] += out
            table[:, new] += into
            table[new, new] += own
            if new != old:
                moved += 1
                cls[v] = new
                follows[:, old] -= pairs[:, v]
                follows[:, new] += pairs[:, v]
                leads[:, old] -= pairs[v]
                leads[:, new] += pairs[v]
        if not moved:
            break
    return cls


#: The token that ends a text; no word is empty.
END = b""
#: Words that are looked up at a time.
AT_ONCE = 200_000
_digest = xxhash.xxh64_intdigest


@dataclass
class Words:
    """The item of every word. Item 0 is the end of a text, then come the most frequent words, then endings; the last item has
    all other endings. `top` numbers the frequent words, of which the first `n_items` are items by themselves, and has the end
    as -2; `more` are the hashes of all other words that are clustered, in order."""

    top: dict[bytes, int]
    n_items: int
    ending: dict[bytes, int]
    more: np.ndarray

    @property
    def last(self) -> int:
        return self.n_items + len(self.ending) + 1

    def look_up(self, flat: list[bytes], classes: Classes | None = None, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(items, numbers of frequent words, places of other words, their hashes, their places in `more` or -1) of words and ends.

        With `classes`, words that have one of their own get no item; without `hashed`, no hashes are made."""
        top = np.fromiter(map(self.top.get, flat, repeat(-1)), np.int64, len(flat))
        items = np.where(top >= 0, top + 1, 0)
        rest = np.flatnonzero(top == -1)
        others = [flat[k] for k in rest.tolist()]
        hashes, place = np.zeros(0, np.uint64), np.full(len(rest), -1)
        if hashed:
            hashes = np.fromiter(map(_digest, others), np.uint64, len(rest))
            if len(self.more):
                at = np.minimum(np.searchsorted(self.more, hashes), len(self.more) - 1)
                place = np.where(self.more[at] == hashes, at, -1)
        # endings: of the other words, and of frequent ones that are no items
        asks = np.ones(len(rest), bool) if classes is None else (place < 0) | (classes.more[place] < 0) if len(self.more) else np.ones(len(rest), bool)
        which = np.flatnonzero(asks)
        items[rest[which]] = np.fromiter(map(self.ending.get, [others[k][-ENDING:] for k in which.tolist()], repeat(self.last)), np.int64, len(which))
        often = np.flatnonzero(top >= self.n_items)
        if classes is not None:
            often = often[classes.top[top[often]] < 0]
        items[often] = np.fromiter(map(self.ending.get, [flat[k][-ENDING:] for k in often.tolist()], repeat(self.last)), np.int64, len(often))
        if classes is not None:
            items[top >= self.n_items] = np.minimum(items[top >= self.n_items], self.last)  # of words with a class: any item
        return items, top, rest, hashes, place


def _flat(texts_):
    """Words of several texts, each with an end behind it, some `AT_ONCE` at a time: (words, number of texts)."""
    flat, n = [], 0
    for text in texts_:
        flat += words_of(text)
        flat.append(END)
        n += 1
        if len(flat) > AT_ONCE:
            yield flat, n
            flat, n = [], 0
    if n:
        yield flat, n


def _before(x: np.ndarray, first: int) -> np.ndarray:
    """What stands before each: an end, at the start."""
    return np.concatenate(([first], x[:-1]))


@dataclass
class Classes:
    """The class of every token: of items, of frequent words and of the others in `more` (-1: that of the ending)."""

    item: np.ndarray
    top: np.ndarray
    more: np.ndarray

    def of(self, items, top, rest, place) -> np.ndarray:
        out = self.item[items]
        at = np.flatnonzero(top >= 0)
        own = self.top[top[at]]
        out[at[own >= 0]] = own[own >= 0]
        found = place >= 0
        own = self.more[place[found]]
        at = rest[found]
        out[at[own >= 0]] = own[own >= 0]
        return out


@dataclass
class Model:
    words: Words
    classes: Classes
    tokens: int  # training tokens with ends
    distinct: int
    top_counts: np.ndarray
    more_counts: np.ndarray
    ends: int
    step: np.ndarray  # log10 of class given class
    total: np.ndarray  # log10 of what a class emits

    @property
    def floor(self) -> float:
        """What the base takes off for each token."""
        return float(np.log10(self.tokens + UNSEEN * (self.distinct + 1)))

    def parts(self, flat: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token (ends included): whether it is known, its share of base and score as far as its count is at hand, and places
        and hashes of the other words, each of which adds log10(count + UNSEEN) to both."""
        items, top, rest, hashes, place = self.words.look_up(flat, self.classes)
        cls = self.classes.of(items, top, rest, place)
        count = np.zeros(len(flat))
        at = np.flatnonzero(top >= 0)
        count[at] = self.top_counts[top[at]]
        count[top == -2] = self.ends
        found = place >= 0
        count[rest[found]] = self.more_counts[place[found]]
        log = np.log10(count + UNSEEN)
        away = rest[~found]
        log[away] = 0
        end = self.classes.item[0]
        return count > 0, log - self.floor, log + self.step[_before(cls, end), cls] - self.total[cls], away, hashes[~found]


def _counted(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in the texts. Tasks add up what they hold before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        total = Counter()

        def out():
            names = list(total)
            for k in range(0, len(names), 50_000):
                part = names[k : k + 50_000]
                yield batch_of(schema, part, [total[w] for w in part])

        for batch in batches:
            for text in batch.column("text"):
                total.update(words_of(text.as_py()))
                if len(total) > 600_000:
                    yield from out()
                    total.clear()
        yield from out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _neighbours(docs: DataFrame, words: Words) -> np.ndarray:
    """How often item j follows item i in the texts; the end also stands before each text."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    return _table(docs, lambda flat: sent.value.look_up(flat, hashed=False)[0], words.last + 1, 0)


def _bigrams(docs: DataFrame, words: Words, classes: Classes) -> np.ndarray:
    """How often class j follows class i."""
    sent = docs.sparkSession.sparkContext.broadcast((words, classes))

    def kind(flat):
        w, c = sent.value
        items, top, rest, _, place = w.look_up(flat, c)
        return c.of(items, top, rest, place)

    return _table(docs, kind, int(classes.item.max()) + 1, int(classes.item[0]))


def _table(docs: DataFrame, kind, size: int, first: int) -> np.ndarray:
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for flat, _ in _flat(t.as_py() for t in batch.column("text")):
                x = kind(flat)
                total += np.bincount(_before(x, first) * size + x, minlength=size * size)
        at = np.flatnonzero(total)
        yield batch_of(schema, at, total[at])

    found = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(size * size, np.int64)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    return pairs.reshape(size, size)


#: Counts of neighbours' classes in a bucket, about.
COUNTS = 4_000_000


def _further(docs: DataFrame, words: Words, cls: np.ndarray, table: np.ndarray, clustered_top: int, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the frequent words from `n_items` on (those before `clustered_top`) and of `more`: where the likelihood gains most.

    Counts of neighbours' classes are combined in the tasks and meet by word: a row has the counts of many words, those of one
    bucket. A bucket adds them up and judges its words; a class for each word comes back. `tokens`: of these words, in all."""
    k, n_top = int(cls.max()) + 1, len(words.top) - 1
    n_buckets = max(1, -(-2 * tokens // COUNTS))
    sent = docs.sparkSession.sparkContext.broadcast((words, cls))
    packed = pa.schema([("bucket", pa.int32()), ("code", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])

    def gather(batches):
        w, c = sent.value
        held, size = [], 0

        def merged():
            code, n = (np.concatenate(x) for x in zip(*held, strict=True))
            code, at = np.unique(code, return_inverse=True)
            return code, np.bincount(at, n).astype(np.int64)

        def out(code, n):
            bucket = code // (2 * k) % n_buckets
            order = np.argsort(bucket, kind="stable")
            which, starts = np.unique(bucket[order], return_index=True)
            edges = pa.array(np.append(starts, len(order)), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *(pa.ListArray.from_arrays(edges, pa.array(x[order])) for x in (code, n))], schema=packed)

        for batch in batches:
            for flat, _ in _flat(t.as_py() for t in batch.column("text")):
                items, top, rest, _, place = w.look_up(flat)
                word = np.where((top >= w.n_items) & (top < clustered_top), top, -1)
                word[rest] = np.where(place >= 0, n_top + place, -1)
                of = c[items]
                at = np.flatnonzero(word >= 0)
                # the class that follows (an end always does) and the class before
                code = np.concatenate((word[at] * (2 * k) + of[at + 1], word[at] * (2 * k) + k + _before(of, c[0])[at]))
                held.append(np.unique(code, return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield out(*held[0])
                        held, size = [], 0
        if size:
            yield out(*merged())

    known, rows_, columns = _g(table), table.sum(1), table.sum(0)

    def judge(bucket: pa.Table) -> pa.Table:
        code, n = (bucket[c].combine_chunks().flatten().to_numpy() for c in ("code", "n"))
        code, at = np.unique(code, return_inverse=True)
        n = np.bincount(at, n)
        word, row = np.unique(code // (2 * k), return_inverse=True)
        edges = np.searchsorted(row, np.arange(0, len(word) + 500, 500))
        best = []
        for j in range(len(edges) - 1):
            mine = slice(edges[j], edges[j + 1])
            seen = np.zeros((min(500, len(word) - 500 * j), 2 * k))
            seen[row[mine] - 500 * j, code[mine] % (2 * k)] = n[mine]
            follows, leads = seen[:, None, :k], seen[:, None, k:]
            gain = (_g(table + follows) - known).sum(2) + (_g(table.T + leads) - known.T).sum(2)
            gain -= _g(rows_ + follows.sum(2)) - _g(rows_) + _g(columns + leads.sum(2)) - _g(columns)
            best.append(gain.argmax(1))
        return pa.table({"word": word, "cls": np.concatenate(best).astype(np.int32) if best else np.zeros(0, np.int32)})

    found = docs.select("text").mapInArrow(gather, "bucket int, code array<long>, n array<long>").groupBy("bucket").applyInArrow(judge, "word long, cls int").toArrow()
    word, new = found["word"].to_numpy(), found["cls"].to_numpy()
    top_class, more_class = np.full(n_top, -1, np.int16), np.full(len(words.more), -1, np.int16)
    top_class[word[word < n_top]] = new[word < n_top]
    more_class[word[word >= n_top] - n_top] = new[word >= n_top]
    return top_class, more_class


def _hashed(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, in order, and their counts."""
    schema = pa.schema([("hash", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            yield batch_of(schema, np.fromiter(map(_digest, batch.column("word").to_pylist()), np.uint64, batch.num_rows).view(np.int64), batch.column("n"))

    found = vocabulary.select("word", "n").mapInArrow(run, "hash long, n long").toArrow()
    hashes, n = found["hash"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def train(docs: DataFrame, *, top_words: int = 16_384, n_items: int = 500, n_endings: int = 250, n_classes: int = 40, min_count: int = 4, most_words: int = 1 << 20, strength: float = 5.0) -> Model:
    """The model of all rows' whole texts (column text). What comes to the driver is bounded by the parameters."""
    vocabulary = kept(_counted(docs))
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()
    ends = docs.count()
    top = vocabulary.orderBy(F.desc("n"), "word").limit(top_words).collect()
    numbers = {bytes(r.word): k for k, r in enumerate(top)}
    n_items = min(n_items, len(top))
    # the least count that is clustered: how many words have each count, from the greatest on
    sizes = sorted(((r.n, r.words) for r in vocabulary.where(F.col("n") >= min_count).groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    least, so_far = min_count, 0
    for n, words_with in sizes:
        so_far += words_with
        if so_far > most_words:
            least = n + 1
            break
    # what the tables hold: all words down to the least count, and the most frequent ones in any case
    edge = (top[-1].n, bytes(top[-1].word)) if top else (0, b"")
    beyond = (F.col("n") < edge[0]) | ((F.col("n") == edge[0]) & (F.col("word") > F.lit(edge[1])))
    more, more_counts = _hashed(vocabulary.where(beyond & (F.col("n") >= least))) if len(top) == top_words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    items = F.broadcast(vocabulary.orderBy(F.desc("n"), "word").limit(n_items).select("word"))  # of n_items rows
    ending = F.expr(f"substring(word, -{ENDING})").alias("ending")
    rare = F.col("n") < least
    by_ending = vocabulary.join(items, "word", "left_anti").groupBy(ending).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("rare_n"), F.count_if(rare).alias("rare_words"))
    by_ending = kept(by_ending)
    rest = by_ending.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rare_n", "rare_words"))).first()
    endings = by_ending.orderBy(F.desc("n"), "ending").limit(n_endings).collect()
    words = Words(numbers | {END: -2}, n_items, {bytes(r.ending): n_items + 1 + k for k, r in enumerate(endings)}, more)
    pairs = _neighbours(docs, words)
    cls = exchange(pairs, min(n_classes, len(pairs)))
    k = int(cls.max()) + 1
    member = np.eye(k)[cls]
    counts = np.array([r.n for r in top], np.int64)
    clustered_top = max(n_items, int((counts >= least).sum()))
    top_class, more_class = _further(docs, words, cls, member.T @ pairs @ member, clustered_top, int(counts[n_items:clustered_top].sum() + more_counts.sum()))
    top_class[:n_items] = cls[1 : n_items + 1]
    classes = Classes(cls, top_class, more_class)
    table = _bigrams(docs, words, classes).astype(float)
    share = (table.sum(0) + UNSEEN) / (table.sum() + UNSEEN * k)
    step = np.log10((table + strength * share) / (table.sum(1, keepdims=True) + strength))
    # what each class emits: its end, its words, and of its endings the words that no table classifies, each with one unseen word
    emits = np.zeros(k)
    emits[cls[0]] += ends + UNSEEN
    own = top_class >= 0
    emits += np.bincount(top_class[own], counts[own] + UNSEEN, k) if own.any() else 0
    emits += np.bincount(more_class[more_class >= 0], more_counts[more_class >= 0] + UNSEEN, k) if len(more) else 0
    rare_n, rare_words = (np.array([*(r[c] for r in endings), rest[c] - sum(r[c] for r in endings)], float) for c in ("rare_n", "rare_words"))
    emits += np.bincount(cls[n_items + 1 :], rare_n + UNSEEN * (rare_words + 1), k)
    return Model(words, classes, total.n + ends, total.words + (ends > 0), counts, more_counts, ends, step, np.log10(np.maximum(emits, UNSEEN)))


_FILED = "bucket int, doc_id array<long>, mark array<long>, learn array<boolean>, n array<int>, tokens array<long>, known array<long>, base array<double>, score array<double>, word array<long>"
_FILED_SCHEMA = pa.schema([("bucket", pa.int32()), *((c, pa.list_(t)) for c, t in (("doc_id", pa.int64()), ("mark", pa.int64()), ("learn", pa.bool_()), ("n", pa.int32()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.int64())))])
_SUMS = "home int, doc_id array<long>, mark array<long>, tokens array<long>, known array<long>, base array<double>, score array<double>, copies array<long>"
_TOTALS = "doc_id long, n_tokens long, n_known long, base_score double, score double"
#: Texts whose sums are added up at a time, about.
HOME = 8000
#: Stands for a null id inside the shuffles.
NO_ID = -(1 << 63)
#: Words that a task files at a time.
_HELD = 500_000


def _file(batches, model: Model, n_buckets: int, modulus: int, remainder: int):
    """Texts' parts and their less frequent words, by bucket. A text's own parts stand in one of its rows."""
    held: list[tuple] = []
    count = 0

    def out():
        docs = np.repeat(np.arange(len(held)), [max(1, len(x[6])) for x in held])
        words = np.concatenate([np.array(x[6] or [_digest(str(x[0]).encode(), x[1] & (1 << 64) - 1)], np.uint64) for x in held])
        real = np.repeat([bool(x[6]) for x in held], [max(1, len(x[6])) for x in held])
        bucket = (words % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((docs, bucket))
        docs, words, bucket, real = docs[order], words[order], bucket[order], real[order]
        own = np.zeros(len(docs), bool)
        own[np.unique(docs, return_index=True)[1]] = True
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            which, first, n = np.unique(docs[a:b], return_index=True, return_counts=True)
            full = np.where(real[a:b][first], n, 0)
            mine = np.isin(which, docs[a:b][own[a:b]])
            rows = [held[d] for d in which.tolist()]
            columns = [[x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows], full, *([x[c] if m else 0 for x, m in zip(rows, mine.tolist(), strict=True)] for c in (3, 4, 5, 7)), words[a:b][real[a:b]].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, f.type.value_type)) for c, f in zip(columns, list(_FILED_SCHEMA)[1:], strict=True))], schema=_FILED_SCHEMA)

    def file(group):
        """A few texts: what they are by themselves, and the hashes of their other words."""
        flat = []
        for _, value in group:
            flat += words_of(value)
            flat.append(END)
        known, base, score, away, hashes = model.parts(flat)
        ends = np.flatnonzero(np.fromiter(map(len, flat), np.int64, len(flat)) == 0)
        starts = np.concatenate(([0], ends[:-1] + 1))
        known, base, score = (np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, score))
        edges = np.searchsorted(away, np.append(starts, len(flat)))
        for j, (doc_id, value) in enumerate(group):
            learn = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus != remainder
            mark = _digest((value or "").encode(), 1 + (value is None))
            yield NO_ID if doc_id is None else doc_id, mark - (1 << 64) if mark >> 63 else mark, learn, int(ends[j] - starts[j]) + 1, int(known[j]), float(base[j]), hashes[edges[j] : edges[j + 1]].tolist(), float(score[j])

    for batch in batches:
        group, size = [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            value = text.as_py()
            group.append((doc_id, value))
            size += len(value or "")
            if size > 1_000_000:
                rows_, group, size = list(file(group)), [], 0
                held += rows_
                count += sum(len(x[6]) + 1 for x in rows_)
                if count > _HELD:
                    yield from out()
                    held, count = [], 0
        if group:
            rows_ = list(file(group))
            held += rows_
            count += sum(len(x[6]) + 1 for x in rows_)
        if count > _HELD:
            yield from out()
            held, count = [], 0
    if held:
        yield from out()


def _summed(table: pa.Table, n_homes: int) -> pa.Table:
    """A bucket: counts its words in training texts, and gives each text the sum of logarithms of its words. A text has a part in
    each of many buckets; they are packed by the home where they will meet."""
    flat = {c: table[c].combine_chunks().flatten() for c in _FILED_SCHEMA.names[1:]}
    n = flat["n"].to_numpy()
    word = flat["word"].to_numpy()
    doc = np.repeat(np.arange(len(n)), n)
    _, which = np.unique(word, return_inverse=True)
    learn = np.asarray(flat["learn"].to_numpy(zero_copy_only=False), np.float64)
    count = np.bincount(which, learn[doc])[which] if len(word) else np.zeros(0)
    logs = np.bincount(doc, np.log10(count + UNSEEN), len(n))
    known = np.bincount(doc, count > 0, len(n)).astype(np.int64)
    mark, tokens = flat["mark"].to_numpy(), flat["tokens"].to_numpy()
    doc_id = flat["doc_id"].to_numpy()
    columns = [doc_id, mark, tokens, flat["known"].to_numpy() + known, flat["base"].to_numpy() + logs, flat["score"].to_numpy() + logs, (tokens > 0).astype(np.int64)]
    # only rows equal in both must meet, so copies of a text with ids of their own spread over all homes
    home = mixed(mark.view(np.uint64) ^ mixed(doc_id.view(np.uint64)))
    return _packed(home % np.uint64(n_homes), columns)


def _packed(home: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """A row for each home, with the columns' values as lists."""
    order = np.argsort(home, kind="stable")
    homes, starts = np.unique(home[order], return_index=True)
    edges = pa.array(np.append(starts, len(order)), pa.int32())
    lists = [pa.ListArray.from_arrays(edges, pa.array(c[order])) for c in columns]
    return pa.table([pa.array(homes, pa.int32()), *lists], names=["home", "doc_id", "mark", "tokens", "known", "base", "score", "copies"])


def _totalled(table: pa.Table) -> pa.Table:
    """A row for each text of a home: the sums of its parts. Equal rows have been added up, and are divided again."""
    doc_id, mark, *parts = (table[c].combine_chunks().flatten().to_numpy() for c in table.schema.names[1:])
    order = np.lexsort((mark, doc_id))
    doc_id, mark = doc_id[order], mark[order]
    starts = np.flatnonzero(np.concatenate(([True], (doc_id[1:] != doc_id[:-1]) | (mark[1:] != mark[:-1]))))
    *sums, copies = (np.add.reduceat(p[order], starts) for p in parts)
    tokens, known, base, score = (np.repeat(x // copies if x.dtype.kind == "i" else x / copies, copies) for x in sums)
    ids = np.repeat(doc_id[starts], copies)
    return pa.table({"doc_id": pa.array(ids, mask=ids == NO_ID), "n_tokens": tokens, "n_known": known, "base_score": base, "score": score})


def scored(df: DataFrame, *, modulus: int = 10, remainder: int = 0, **parameters) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text, learning from the rows
    whose crc32(doc_id as text) modulo `modulus` is not `remainder`."""
    docs = texts(df)
    learn = docs.where(~held_out("doc_id", modulus, remainder))
    model = train(learn, **parameters)
    # tokens of training texts whose words no table has, and as large a share of the others
    rare = (model.tokens - model.ends - int(model.top_counts.sum()) - int(model.more_counts.sum())) * modulus / max(1, modulus - 1)
    n_buckets = max(1, round(rare / BUCKET))
    sent = df.sparkSession.sparkContext.broadcast(model)
    filed = docs.mapInArrow(lambda b: _file(b, sent.value, n_buckets, modulus, remainder), _FILED)
    n_homes = max(1, round(model.ends * modulus / max(1, modulus - 1) / HOME))
    sums = filed.groupBy("bucket").applyInArrow(lambda t: _summed(t, n_homes), _SUMS).groupBy("home").applyInArrow(_totalled, _TOTALS)
    return sums.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
