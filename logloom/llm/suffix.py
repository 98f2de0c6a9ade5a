"""Removes repeated byte strings: a suffix sort that stops at `depth` bytes.

Suffixes that agree on their first `depth` bytes form a group; every member of a group but the first (by document, then
place) starts a repeated string, and the bytes of those strings go. Groups come from a most-significant-digit radix sort
of the suffixes that stops at that depth. Suffixes of all places are never shuffled one by one:

1. First digit. A string of `depth` bytes is filed under its smallest `gram`-byte hash and where in the string that gram
   lies. Equal strings choose the same gram at the same place, and neighbouring strings mostly share their gram, so one row
   (an anchor with its extent, all strings that chose it) stands for dozens of suffixes. Strings of an extent that equals
   an earlier one's are settled there; tasks do so for what they hold before anything is shuffled.
2. The anchors of a gram meet in sorted order. Grams with a single distinct extent are done. Frequent grams are split over
   tasks by their extents: whoever holds more than `SHARE` of all anchors does so in some task's batch as well, so batches name
   the grams that do there, and those named often enough overall are at most 1/`SHARE`.
3. Further digits. Extents that share a gram but differ go through passes of eight bytes a time over all their suffixes,
   which drop a suffix as soon as it is alone, up to the full depth. A gram with more than `large` different extents is
   filed anew, each string under its whole self, and read in sorted order; tasks settle equal strings of theirs before that.

So no task holds more than a small share of the anchors of all documents, whatever they have in common: of a gram at most
`large` + 2 * `SHARE` of all, and of an extent or a string one row for each batch of a task.

Strings are compared byte by byte, but for equal extents, which are told by 128 bits of hashes. Each extent's repeated
strings all contain its gram, so they cover one interval. Intervals are merged per document at the end.

Nulls: a null text is empty. A null doc_id comes before all others. A document is an id with a text (`mark`, a hash of the
text, tells those of one id apart and orders them): texts that share an id, or have none, are documents of their own. Rows that
repeat both id and text get equal results and are no repetition of each other. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, kept, mixed, text_hashes, texts

DEPTH, GRAM = 100, 32
#: Bytes of a document that are searched for anchors at a time.
PIECE = 1 << 20
#: Anchors that a task holds before it settles equal extents among them.
HELD = 400_000
#: Suffixes that go through the passes at a time.
SORTED_AT_ONCE = 400_000
#: A gram with more than this share of all anchors, and with more than `large` of them, is split over tasks.
SHARE = 1 / 20_000
#: Different strings of large grams that a task holds before it passes them on.
STRINGS_HELD = 100_000
_PLACE = np.uint64((1 << 24) - 1)
#: Stands for a null id.
NO_ID = -(1 << 63)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hashes:
    """Polynomial hashes of all substrings of a piece in constant time each."""

    BASE = 0x2545F4914F6CDD1D

    def __init__(self):
        self.symbol = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            size = 1 << len(data).bit_length()
            self.up, self.down = _powers(size, self.BASE), _powers(size, pow(self.BASE, -1, 1 << 64))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.symbol[data] * self.down[: len(data)])))

    def of(self, sums: np.ndarray, lo, hi) -> np.ndarray:
        return mixed((sums[hi] - sums[lo]) * self.up[lo])


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima to both sides inside blocks of that width."""
    n = len(x)
    grid = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = x
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, hashes: _Hashes, depth: int = DEPTH, gram: int = GRAM):
    """(gram hash, extent hash, first string, anchor - first, last - first) of a document's anchors, piece by piece."""
    for start in range(0, max(0, len(data) - depth + 1), PIECE):
        piece = data[start : start + PIECE + depth - 1]
        sums = hashes.sums(piece)
        grams = hashes.of(sums, slice(0, len(piece) - gram + 1), slice(gram, len(piece) + 1))
        chosen = (_lowest((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), depth - gram + 1) & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
        last = np.concatenate((first[1:] - 1, [len(chosen) - 1]))
        at, more = chosen[first], last - first
        extent = mixed(hashes.of(sums, first, last + depth) + (((at - first) << 8) | more).astype(np.uint64))
        yield grams[at], extent, first + start, at - first, more


_ANCHORS = pa.schema([(c, pa.int64()) for c in ("key", "extent", "doc_id", "mark", "place", "until")])
_FOUND = pa.schema([(c, pa.int64()) for c in ("key", "doc_id", "mark", "place", "until")])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{c} {'binary' if c == 'data' else 'long'}" for c in schema.names)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column; the first one does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _leaders(begin: np.ndarray) -> np.ndarray:
    """For each row the last one at which a group begins."""
    return np.maximum.accumulate(np.where(begin, np.arange(len(begin)), 0))


def _pack(first, before, more):
    return (first << 16) | (before << 8) | more


def _unpack(place):
    return place >> 16, place >> 8 & 255, place & 255


def _joined(ids: np.ndarray, marks: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Intervals of the same document that touch, as one. They come sorted by document and start."""
    if not len(ids):
        return ids, marks, lo, hi
    order = np.lexsort((lo, marks, ids))
    ids, marks, lo, hi = ids[order], marks[order], lo[order], hi[order]
    new = _changes(ids, marks)
    reach = hi.copy()
    edge = np.flatnonzero(new)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True):
        reach[a:b] = np.maximum.accumulate(hi[a:b])
    new[1:] |= lo[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return ids[at], marks[at], lo[at], reach[np.concatenate((at[1:] - 1, [len(ids) - 1]))]


#: What `until` says in rows that are no intervals: an anchor, or the number (as extent) of a batch's anchors of a frequent gram.
ANCHOR, NAMED = 0, -1


def _file(batches, depth: int, gram: int):
    """Anchors, without those that repeat an earlier one of the same task, intervals of the latter, and grams that are frequent here."""
    hashes = _Hashes()
    held: list[tuple] = []
    count = 0

    def settle():
        key, extent, first, before, more, ids, marks = (np.concatenate(c) for c in zip(*held, strict=True))
        place = _pack(first, before, more)
        order = np.lexsort((place, marks, ids, extent, key))
        key, extent, place, ids, marks = (x[order] for x in (key, extent, place, ids, marks))
        begin = _changes(key, extent)
        yield batch_of(_ANCHORS, key[begin].view(np.int64), extent[begin].view(np.int64), ids[begin], marks[begin], place[begin], np.full(begin.sum(), ANCHOR))
        named, n = np.unique(key[begin], return_counts=True)
        often = n > SHARE * begin.sum()
        none = np.zeros(often.sum(), np.int64)
        yield batch_of(_ANCHORS, named[often].view(np.int64), n[often], none, none, none, np.full(often.sum(), NAMED))
        # a row that repeats the first one itself is no repetition; equal rows of another repeat are settled with it
        leader = _leaders(begin)
        again = _changes(key, extent, ids, marks, place) & ((ids != ids[leader]) | (marks != marks[leader]) | (place != place[leader]))
        lo, _, span = _unpack(place[again])
        who, mark, lo, hi = _joined(ids[again], marks[again], lo, lo + span + depth)
        yield batch_of(_ANCHORS, mixed((who ^ mark).view(np.uint64)).view(np.int64), np.zeros(len(who), np.int64), who, mark, lo, hi)

    for batch in batches:
        for doc_id, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text"), strict=True):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            for part in anchors(data, hashes, depth, gram):
                held.append((*part, np.full(len(part[0]), doc_id, np.int64), np.full(len(part[0]), mark, np.int64)))
                count += len(part[0])
            if count >= HELD:
                yield from settle()
                held, count = [], 0
    if held:
        yield from settle()


def _meet(batches, depth: int):
    """Reads anchors in order of key, extent, document and place. Gives intervals, and one anchor for each extent where a key has
    two or more of them, or may have others elsewhere (`split`); remembers only the row before."""
    last = None  # key, extent, doc_id, mark, place of the last extent's first anchor, and whether it was given out
    for batch in batches:
        *columns, until = (batch.column(c).to_numpy() for c in _ANCHORS.names)
        split = batch.column("split").to_numpy(zero_copy_only=False)
        done = until > 0
        out = [(np.zeros(done.sum(), np.int64), *(x[done] for x in columns[2:]), until[done])]
        columns, split = [x[~done] for x in columns], split[~done]
        if len(columns[0]):
            if last is not None:
                split = np.concatenate(([False], split))
                columns = [np.concatenate(([x], y)) for x, y in zip(last[:5], columns, strict=True)]
            given = last is not None and last[5]
            key, extent, ids, marks, place = columns
            begin = _changes(key, extent)
            leader = _leaders(begin)
            again = ~begin & ((ids != ids[leader]) | (marks != marks[leader]) | (place != place[leader]))
            lo, _, span = _unpack(place[again])
            who, mark, lo, hi = _joined(ids[again], marks[again], lo, lo + span + depth)
            out.append((np.zeros(len(who), np.int64), who, mark, lo, hi))
            key, extent, ids, marks, place = (x[begin] for x in columns)
            near = key[1:] == key[:-1]
            several = np.concatenate(([given], near)) | np.concatenate((near, [False])) | split[begin]
            last = (key[-1], extent[-1], ids[-1], marks[-1], place[-1], bool(several[-1]))
            several[0] &= not given
            out.append((key[several], ids[several], marks[several], place[several], np.zeros(several.sum(), np.int64)))
        yield batch_of(_FOUND, *(np.concatenate(c) for c in zip(*out, strict=True)))


_EXTENTS = pa.schema([*((c, pa.int64()) for c in ("key", "doc_id", "mark", "place")), ("data", pa.binary()), ("until", pa.int64())])


def _extents(batches, depth: int):
    """The bytes of each extent; where its key is a large one, those of each of its strings, filed under all of them. Of equal
    strings that meet here only the first goes on; the others are intervals (no data, but `until`)."""
    hashes = _Hashes()
    strings: dict[bytes, tuple[int, int, int, int]] = {}  # to the key and the document, mark and place of the first so far
    again: list[tuple[int, int, int]] = []

    def settle():
        if strings:
            yield batch_of(_EXTENTS, *zip(*((k, *at, _pack(place, 255, 0), data, 0) for data, (k, *at, place) in strings.items()), strict=True))
            strings.clear()
        if again:
            ids, marks, lo = (np.array(c, np.int64) for c in zip(*again, strict=True))
            who, mark, lo, hi = _joined(ids, marks, lo, lo + depth)
            yield batch_of(_EXTENTS, mixed((who ^ mark).view(np.uint64)).view(np.int64), who, mark, lo, [None] * len(who), hi)
            again.clear()

    for batch in batches:
        out, size = [], 0
        for doc_id, mark, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text"), batch.column("found").to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            for x in found:
                first, before, more = _unpack(x["place"])
                extent = data[first : first + more + depth]
                if not x["hot"]:
                    out.append((x["key"], doc_id, mark, x["place"], extent, 0))
                else:
                    sums, each = hashes.sums(np.frombuffer(extent, np.uint8)), np.arange(more + 1)
                    for k, h in enumerate(hashes.of(sums, each, each + depth).view(np.int64).tolist()):
                        at, string = (doc_id, mark, first + k), extent[k : k + depth]
                        leader = strings.setdefault(string, (h, *at))[1:]
                        if at < leader:
                            strings[string] = (h, *at)
                        if at != leader:
                            again.append(max(at, leader))
                size += len(extent)
            if size > 4_000_000:
                yield batch_of(_EXTENTS, *zip(*out, strict=True))
                out, size = [], 0
            if len(strings) > STRINGS_HELD or len(again) > 4 * STRINGS_HELD:
                yield from settle()
        if out:
            yield batch_of(_EXTENTS, *zip(*out, strict=True))
    yield from settle()


def radix_groups(data: np.ndarray, starts: np.ndarray, label: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes of `data` inside equal labels by their first `depth` bytes, a digit of eight bytes at a time from the first
    on, and drops a suffix when no other shares its digits. Returns what is left and the number of its group, in order."""
    width = min(8, depth)
    digits = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)) if width == 8 else None
    alive = np.arange(len(starts))
    for at in [*range(0, depth - width + 1, width), *([depth - width] if depth % width else [])]:
        if not len(alive):
            break
        digit = digits[starts[alive] + at] if width == 8 else sum(data[starts[alive] + at + k].astype(np.uint64) << np.uint64(8 * k) for k in range(width))
        order = np.lexsort((digit, label))
        digit, label, alive = digit[order], label[order], alive[order]
        new = np.concatenate(([True], (label[1:] != label[:-1]) | (digit[1:] != digit[:-1])))
        label = np.cumsum(new)
        several = ~(new & np.concatenate((new[1:], [True])))
        alive, label = alive[several], label[several]
    return alive, label


def _sort_extents(batches, depth: int):
    """Intervals of repeated strings inside groups of equal keys."""
    held: list[tuple[int, int, int, int, bytes, int]] = []
    strings, key, seen = 0, None, {}

    def passes():
        keys, ids, marks, places = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[:4])
        first, before, more = _unpack(places)
        base = np.cumsum([0, *(len(x[4]) for x in held)])[:-1]
        data = np.frombuffer(b"".join(x[4] for x in held) + bytes(8), np.uint8)
        row = np.repeat(np.arange(len(held)), more + 1)
        k = np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        group = np.cumsum(_changes(keys))
        alive, label = radix_groups(data, base[row] + k, group[row] * 256 + (before[row] - k + 128), depth)
        place = first[row[alive]] + k[alive]
        who, mark = ids[row[alive]], marks[row[alive]]
        order = np.lexsort((place, mark, who, label))
        label, who, mark, place = label[order], who[order], mark[order], place[order]
        leader = _leaders(_changes(label))
        again = (who != who[leader]) | (mark != mark[leader]) | (place != place[leader])
        return _joined(who[again], mark[again], place[again], place[again] + depth)

    def result(who, mark, lo, hi):
        return batch_of(_FOUND, np.zeros(len(who), np.int64), who, mark, lo, hi)

    for batch in batches:
        late: list[tuple[int, int, int, int]] = []
        for x in zip(*(batch.column(c).to_pylist() for c in _EXTENTS.names), strict=True):
            if x[5]:  # settled before
                late.append((x[1], x[2], x[3], x[5]))
                continue
            if x[0] != key:
                key, seen = x[0], {}
                if strings > SORTED_AT_ONCE:
                    yield result(*passes())
                    held, strings = [], 0
            first, before, more = _unpack(x[3])
            if before == 255:  # a whole string: the first that is read is the first of all
                earlier = seen.setdefault(x[4], (x[1], x[2], first))
                if earlier != (x[1], x[2], first):
                    late.append((x[1], x[2], first, first + depth))
            else:
                held.append(x)
                strings += more + 1
        if late:
            yield result(*_joined(*(np.array(c, np.int64) for c in zip(*late, strict=True))))
    if held:
        yield result(*passes())


def repeated(df: DataFrame, depth: int = DEPTH, gram: int = GRAM, large: int = 2048) -> DataFrame:
    """(doc_id, mark, spans array<struct<lo, hi>>): the intervals of bytes that repeat earlier strings of `depth` bytes, by document.

    `df` has doc_id (NO_ID for null), mark and text. Documents without any are left out.
    """
    filed = kept(df.mapInArrow(lambda b: _file(b, depth, gram), _ddl(_ANCHORS)))
    least = max(large, SHARE * filed.where(F.col("until") == ANCHOR).count())
    named = filed.where(F.col("until") == NAMED).groupBy("key").agg(F.sum("extent").alias("n")).where(F.col("n") > least)
    # at most 1 / SHARE rows: each stands for more than that share of all anchors
    split = filed.where(F.col("until") >= ANCHOR).join(F.broadcast(named.select("key", F.lit(True).alias("split"))), "key", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    route = F.when(F.col("split"), F.xxhash64("key", "extent")).otherwise(F.col("key"))
    met = kept(split.repartition(route).sortWithinPartitions("key", "extent", "doc_id", "mark", "place").mapInArrow(lambda b: _meet(b, depth), _ddl(_FOUND)))
    open_ = met.where("until = 0")
    hot = open_.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large).select("key", F.lit(True).alias("hot"))
    hot = hot.repartition(F.xxhash64("key"))  # dealt anew, so that the join has an exchange on both sides and can split a large key
    wanted = open_.join(hot, "key", "left").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("key", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("found"))
    extents = df.join(wanted, ["doc_id", "mark"]).select("doc_id", "mark", "text", "found").mapInArrow(lambda b: _extents(b, depth), _ddl(_EXTENTS))
    late = extents.repartition("key").sortWithinPartitions("key", "doc_id", "mark", "place").mapInArrow(lambda b: _sort_extents(b, depth), _ddl(_FOUND))
    spans = met.where("until > 0").union(late).select("doc_id", "mark", F.struct(F.col("place").alias("lo"), F.col("until").alias("hi")).alias("span"))
    return spans.groupBy("doc_id", "mark").agg(F.collect_list("span").alias("spans"))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("data", pa.binary()), ("kept_sha256", pa.string())])


def _rest(data: bytes, spans) -> tuple[bytes, int]:
    """What is left of the bytes without the spans, and how many runs these make."""
    parts, at, n = [], 0, 0
    for lo, hi in sorted({(min(x["lo"], len(data)), min(x["hi"], len(data))) for x in spans or ()}):
        if lo > at or not n:
            n += hi > lo
            parts.append(data[at:lo])
        at = max(at, hi)
    parts.append(data[at:])
    return b"".join(parts), n


def _cut_out(batches, with_data: bool):
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            rest, n = _rest(data, spans)
            out.append((doc_id if doc_id != NO_ID else None, len(data), len(data) - len(rest), n, rest if with_data else None, hashlib.sha256(rest).hexdigest()))
        if out:
            yield batch_of(_KEPT, *zip(*out, strict=True))


def remove_repeats(df: DataFrame, depth: int = DEPTH, gram: int = GRAM, large: int = 2048, with_data: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, data, kept_sha256) of each row: what is left of its text (null without
    `with_data`) and what went."""
    docs = texts(df).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), *text_hashes("text", ("mark",)), "text")
    return docs.join(repeated(docs, depth, gram, large), ["doc_id", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(
        lambda b: _cut_out(b, with_data), "doc_id long, n_bytes long, n_removed long, n_spans long, data binary, kept_sha256 string"
    )


def without_repeats(df: DataFrame, depth: int = DEPTH, gram: int = GRAM, large: int = 2048) -> DataFrame:
    """`df` with each text cut down to what is left of it; all rows and columns stay, and n_chars, if there, is counted anew.

    A character of which only some bytes are left goes as a whole. Null texts stay null.
    """
    key = "_".join([*df.columns, "key"])  # a name that is free
    keyed = df.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(key), *text_hashes("text", (f"{key}_mark",)))
    spans = repeated(keyed.select(F.col(key).alias("doc_id"), F.col(f"{key}_mark").alias("mark"), F.col("text").cast("string").alias("text")), depth, gram, large)
    met = keyed.join(spans.select(F.col("doc_id").alias(key), F.col("mark").alias(f"{key}_mark"), F.col("spans").alias(f"{key}_spans")), [key, f"{key}_mark"], "left").select(*df.columns, f"{key}_spans")

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts_, spans_ = batch.column("text"), batch.column(f"{key}_spans").to_pylist()
            out = []
            for text, found in zip(texts_, spans_, strict=True):
                text = text.as_py()
                out.append(_rest(text.encode(), found)[0].decode(errors="ignore") if text and found else text)
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names if n != f"{key}_spans"]
            yield pa.RecordBatch.from_arrays(columns, [n for n in names if n != f"{key}_spans"])

    cut_down = met.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))
    return cut_down.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)).select(*df.columns) if "n_chars" in df.columns else cut_down
