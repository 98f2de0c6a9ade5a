"""Token counts as the public library gives them, with huge documents encoded in overlapping chunks that are spliced again.

A text of at most `chunk` characters is counted in one go, word by word: words are what ASCII white space separates. A cut at such
a white space never changes the encoding: the normaliser's compositions and reorderings do not cross it, the pre-tokeniser drops
it, and no special string holds one. Words recur, so a worker remembers their counts (the library's own) within a bound.

A longer text is dealt out as chunks of `chunk` characters, each with `overlap` more on either side, so that one text is the work
of many tasks. Every chunk is encoded by the library with offsets, and tells for the zones it shares with its neighbours where its
tokens end. Two neighbours are spliced at a place p of their zone that is proven to be one of the whole text's token borders:

* both have a pre-token that ends at p (the token before has the end-of-word suffix, or is special), 16 characters or more away
  from the ends of the zone, and the character at p cannot combine with the one before. The left chunk is right up to there by
  induction, the scan for pre-tokens is a function of what follows p, and a special string around p would be whole in both.
* or p lies inside one pre-token of both: all characters from three before the zone's start up to p are letters, or all are signs
  without an apostrophe, and the normaliser leaves them as they are. Then the tokens around p are those of the whole pre-token if
  the pair at p would also stay apart alone: a sequence of tokens is the one that merging yields exactly if all its pairs are.

Where a zone has no such place, the text is encoded again with an overlap eight times as wide, and in the end as one chunk. So no
result depends on the parameters.

Nulls: a null text counts as the empty one, of no tokens. A null doc_id is kept. Repeated rows stay repeated; equal huge texts
are encoded once. An empty table gives no rows; extra columns stay behind.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec
from .shared import batch_of, cut, rows, text_hashes, texts

#: Words that a worker remembers at most, and bytes of the longest among them.
REMEMBERED, LONGEST = 400_000, 64
#: Characters between a splice and the ends of its zone; longer than any special string.
MARGIN = 16
WIDER = 8


class Library:
    """The public library on one tokenizer file, and what its merges say about pairs of tokens."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.definition = definition
        model = json.loads(definition)["model"]
        suffix = model["end_of_word_suffix"]
        self.ends_word = np.ones(self.tokenizer.get_vocab_size(), bool)  # special ones end what they are
        if suffix:
            self.ends_word[[i for t, i in model["vocab"].items() if not t.endswith(suffix)]] = False
        if max((len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), default=0) >= MARGIN:
            raise ValueError("a special string is longer than the margin")
        self.counts: dict[bytes, int] = {}

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def count(self, text: str) -> int:
        """Tokens of a whole text, word by word."""
        words, counts = text.encode().split(), self.counts
        try:
            return sum(map(counts.__getitem__, words))
        except KeyError:
            pass
        new = {w for w in words if w not in counts}
        long = {w for w in new if len(w) > LONGEST}
        short = list(new - long)
        if len(counts) + len(short) > REMEMBERED:  # the older half stays: the frequent words are there
            self.counts = counts = dict(islice(counts.items(), REMEMBERED // 2))
            new = {w for w in words if w not in counts}
            short = list(new - long)
        found = dict(zip(short, map(len, self.tokenizer.encode_batch_fast([w.decode() for w in short], add_special_tokens=False)), strict=True))
        lengths = {w: len(self.encode(w.decode())) for w in long}
        if len(counts) + len(found) <= REMEMBERED:
            counts |= found
            found = {}
        return sum(counts[w] if w in counts else found[w] if w in found else lengths[w] for w in words)

    @cached_property
    def merges(self):
        """As `Codec` has them: ids are single symbols first, then the results of the merges in their order."""
        model = json.loads(self.definition)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = len(vocab) - len(pairs)
        made = [vocab["".join(p)] for p in pairs]
        if made != list(range(n, len(vocab))):
            return None  # then no splice inside a word is proven
        parts = [(i, i) for i in range(n)] + [(vocab[a], vocab[b]) for a, b in pairs]
        return parts, {p: i for i, p in enumerate(parts) if i >= n}

    def stay_apart(self, a: int, b: int) -> bool:
        return self.merges is not None and Codec._stays_apart(a, b, *self.merges)


_LIBRARIES: dict[bytes, Library] = {}


def library(definition: str) -> Library:
    """The library of this worker for this file."""
    key = hashlib.sha256(definition.encode()).digest()
    if key not in _LIBRARIES:
        _LIBRARIES.clear()
        _LIBRARIES[key] = Library(definition)
    return _LIBRARIES[key]


# ---- what a chunk knows about its zones ----

_SECONDS: set[str] = set()


def may_combine(c: str) -> bool:
    """Whether the normaliser may move or compose this character with what stands before it."""
    if c.isascii():
        return False
    if not _SECONDS:
        parts = (unicodedata.decomposition(chr(i)).split() for i in range(0x110000) if not 0xAC00 <= i < 0xD7A4)
        _SECONDS.update(chr(int(p[1], 16)) for p in parts if len(p) == 2 and p[0][0] != "<")
        _SECONDS.update(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))
    return unicodedata.combining(c) > 0 or c in _SECONDS


def _plain(c: str) -> str:
    """The class of a character inside a pre-token: letter, sign, or none that a splice may rely on."""
    if len(c.lower()) > 1 or may_combine(c) or unicodedata.normalize("NFC", c) != c or c == "'":
        return ""
    kind = unicodedata.category(c.lower())[0]
    return {"L": "l", "P": "s", "S": "s"}.get(kind, "")


def same_class_until(text: str, start: int) -> int:
    """The end of the run of one plain class that begins three characters before `start`; `start` if there is none."""
    if start < 3:
        return start
    kind, end = _plain(text[start - 3]), start - 3
    while kind and end < len(text) and _plain(text[end]) == kind:
        end += 1
    return max(end, start)


def borders(lib: Library, text: str, low: int, high: int):
    """(n tokens, [(place, tokens before, ends a pre-token, id before, id behind)]) of a chunk, for places between low and high."""
    found = lib.encode(text)
    ids, n = np.array(found.ids, np.int64), len(found.ids)
    if n < 2:
        return n, []
    spans = np.array(found.offsets, np.int64)
    ends, nexts = spans[:-1, 1], spans[1:, 0]
    at = np.flatnonzero((nexts >= ends) & (ends >= low) & (ends <= high))
    return n, [(int(ends[i]), int(i) + 1, bool(lib.ends_word[ids[i]]), int(ids[i]), int(ids[i + 1]), bool(nexts[i] == ends[i])) for i in at.tolist()]


def splice(lib: Library, left, right) -> tuple[int, int] | None:
    """(tokens of the left chunk before the splice, tokens of the right chunk before it), or nothing.

    left: places with (tokens, ends a pre-token, id before, safe, inside one class); right: with (tokens, ends, id behind, touches)."""
    inside = None
    for p in sorted(left.keys() & right.keys()):
        n, ends, before, safe, plain = left[p]
        m, also_ends, behind, touches = right[p]
        if ends and also_ends and safe:
            return n, m
        if inside is None and plain and not ends and not also_ends and touches and lib.stay_apart(before, behind):
            inside = n, m
    return inside


_ZONE = "array<struct<place: bigint, tokens: bigint, ends: boolean, id: bigint, good: boolean, plain: boolean>>"
_CHUNK = f"a long, b long, size long, k long, n long, head {_ZONE}, tail {_ZONE}"


def _zone(found):
    return [{"place": p, "tokens": n, "ends": e, "id": i, "good": g, "plain": x} for p, n, e, i, g, x in found]


def encoded_chunks(chunks: DataFrame, definition, chunk: int, overlap: int) -> DataFrame:
    """Each chunk's tokens and what it knows about the zone before it (head) and behind it (tail); places are those of the text."""

    def run(batches):
        lib = library(definition.value)
        for a, b, size, k, text in rows(batches, "a", "b", "size", "k", "text"):
            start = max(k * chunk - overlap, 0)  # of this chunk in the text
            zone = (k * chunk - overlap, k * chunk + overlap)
            behind = ((k + 1) * chunk - overlap, (k + 1) * chunk + overlap)
            n, found = borders(lib, text, zone[0] + MARGIN - start, len(text))
            head = [(p + start, t, e, nxt, touches, False) for p, t, e, _, nxt, touches in found if k and p + start <= min(zone[1], size) - MARGIN]
            tail = []
            if (k + 1) * chunk < size:
                plain_end = same_class_until(text, behind[0] - start)
                tail = [
                    (p + start, t, e, prev, not may_combine(text[p]), p < plain_end)
                    for p, t, e, prev, _, _ in found
                    if behind[0] + MARGIN <= p + start <= min(behind[1], size) - MARGIN
                ]
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b, "size": size, "k": k, "n": n, "head": _zone(head), "tail": _zone(tail)}], schema=_chunk_schema())

    return chunks.mapInArrow(run, _CHUNK)


def _chunk_schema() -> pa.Schema:
    place = pa.struct([("place", pa.int64()), ("tokens", pa.int64()), ("ends", pa.bool_()), ("id", pa.int64()), ("good", pa.bool_()), ("plain", pa.bool_())])
    return pa.schema([*((c, pa.int64()) for c in ("a", "b", "size", "k", "n")), ("head", pa.list_(place)), ("tail", pa.list_(place))])


_KEY = ["a", "b", "size"]


def seams(encoded: DataFrame, definition) -> DataFrame:
    """(a, b, size, k, n, fix): each chunk's tokens and how many of them and of the next chunk's lie on the wrong side of the
    splice between them. fix is null where there is no proven splice; 0 behind the last chunk."""
    schema = pa.schema([(c, pa.int64()) for c in (*_KEY, "k", "n", "fix")])

    def run(batches):
        lib = library(definition.value)
        for *key, n, tail, head, last in rows(batches, *_KEY, "k", "n", "tail", "head", "last"):
            fix = 0
            if not last:
                left = {x["place"]: (x["tokens"], x["ends"], x["id"], x["good"], x["plain"]) for x in tail}
                right = {x["place"]: (x["tokens"], x["ends"], x["id"], x["good"]) for x in head or ()}
                found = splice(lib, left, right)
                fix = None if found is None else n - found[0] + found[1]
            yield batch_of(schema, *([v] for v in (*key, n, fix)))

    right = encoded.select(*_KEY, (F.col("k") - 1).alias("k"), "head")
    both = encoded.drop("head").join(right, [*_KEY, "k"], "left")
    return both.select(*_KEY, "k", "n", "tail", "head", "last").mapInArrow(run, ", ".join(f"{c} long" for c in schema.names))


def chunks_of(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(a, b, size, k, text): overlapping chunks, dealt out anew by text and place; equal texts are one."""
    last = F.greatest(F.ceil(F.col("size") / chunk) - 1, F.lit(0))
    rows_ = huge.select(*_KEY, "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    start = F.greatest(F.col("k") * chunk - overlap, F.lit(0))
    length = (F.col("k") + 1) * chunk + overlap - start
    piece = F.substring(F.col("text"), (start + 1).cast("int"), length.cast("int"))
    return rows_.select(*_KEY, "k", piece.alias("text")).groupBy(*_KEY, "k").agg(F.first("text").alias("text"))


def huge_counts(huge: DataFrame, definition, chunk: int, overlap: int) -> DataFrame:
    """(a, b, size, n_tokens) of each different text of (a, b, size, text). Reads `huge` once, and once more for each widening."""
    done, spark = None, huge.sparkSession
    longest = huge.agg(F.max("size")).first()[0]
    if longest is None:
        return spark.createDataFrame([], "a long, b long, size long, n_tokens long")
    while True:
        one = overlap >= longest
        size = longest if one else max(chunk, 2 * overlap)
        encoded = encoded_chunks(chunks_of(huge, size, 0 if one else overlap), definition, size, 0 if one else overlap)
        encoded = cut(encoded.withColumn("last", (F.col("k") + 1) * size >= F.col("size")))
        whole = cut(seams(encoded, definition).groupBy(*_KEY).agg(F.sum("n").alias("n"), F.sum("fix").alias("fix"), F.count_if(F.col("fix").isNull()).alias("open")))
        found = whole.where("open = 0").select(*_KEY, (F.col("n") - F.col("fix")).alias("n_tokens"))
        done = found if done is None else done.unionByName(found)
        left = whole.where("open > 0").select(*_KEY)
        if one or left.isEmpty():
            return done
        huge = huge.join(left, _KEY, "left_semi")
        overlap *= WIDER


# ---- the operator ----


def token_counts(df: DataFrame, path: str, chunk: int = 1 << 16, overlap: int = 256, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text by the tokenizer file at `path` of the driver."""
    if overlap < 2 * MARGIN or chunk < 2 * overlap:
        raise ValueError("an overlap holds two margins, a chunk two overlaps")
    with open(path, encoding="utf-8") as f:  # a vocabulary file: a few MB whatever the corpus
        definition = df.sparkSession.sparkContext.broadcast(f.read())
    all_texts = texts(df).withColumn("text", F.coalesce("text", F.lit("")))
    is_huge = F.length("text") > chunk

    def run(batches):
        lib = library(definition.value)
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_tokens")])
        for batch in batches:
            yield batch_of(schema, batch.column("doc_id"), batch.column("n_bytes"), [lib.count(t.as_py()) for t in batch.column("text")])

    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    usual = all_texts.where(~is_huge).select("doc_id", "text", n_bytes).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    huge = all_texts.where(is_huge).select("doc_id", "text", n_bytes, *text_hashes("text"), F.length("text").cast("long").alias("size"))
    counted = huge_counts(huge.select(*_KEY, "text"), definition, chunk, overlap)
    found = huge.select("doc_id", "n_bytes", *_KEY).join(counted, _KEY).select("doc_id", "n_bytes", "n_tokens")
    return usual.union(found).withColumn("over_limit", F.col("n_tokens") > limit)
