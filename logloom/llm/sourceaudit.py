"""How the sources of a language differ in their terms.

Terms are runs of ASCII letters and of characters beyond ASCII, lower-cased A-Z. Two tables of 256 bytes, read by numpy over the
UTF-8 buffers of many texts at once, say which bytes belong to a term and lower them; so a term's borders are where that answer
changes, and no text is decoded. xxhash groups the slices; every slice is then compared with its group's first one byte by byte, and
slices that only share the hash are told apart. What leaves a task is one row for each (lang, source, term): occurrences and documents.

Spark adds these up. Terms in `least` documents of their language stay. Counts are dealt into blocks of terms of one language, each a
CSR matrix of groups by terms. With p0 the value of a term that a group lacks, the sum of f over a block's terms for two groups is

    sum of f(p, q0) over the first group's terms  +  f(p0, q0) for each other term
    + sum of f(p, q) - f(p, q0) over the second group's terms,

which reads the stored counts only; `np.add.reduceat` adds them up row by row, and Spark over the blocks.

All arithmetic is on integers. p is at most 10^9 + 1 and found by division in two steps, exact for fewer than 9 * 10^13 occurrences. The
p of a group add up to at most 10^9 + V, so squares, quotients and sums stay below 2^63 for fewer than 10^9 terms.

Nulls: null texts, langs and sources count as ''. A row counts as a document whatever its id, so repeated rows count repeatedly. A group
without terms still has its pairs; a language of one source has none. Ties in value are ranked by the item's UTF-8 bytes. An empty
table gives no rows. A text larger than a block is read in pieces that end between terms, and takes memory for its different terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

SCALE = 1_000_000_000
#: Which bytes belong to a term, and what they are lowered to.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of text that are read at a time, and counts in a block of terms.
BLOCK_BYTES, BLOCK_COUNTS = 4 << 20, 200_000


# ---- terms ----


def slices(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of a buffer."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = IN_TERM[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of these sizes at a and at b have the same bytes."""
    edges = np.concatenate(([0], np.cumsum(size)))
    within = np.arange(edges[-1]) - np.repeat(edges[:-1], size)
    differs = data[np.repeat(a, size) + within] != data[np.repeat(b, size) + within]
    return np.add.reduceat(differs, edges[:-1], dtype=np.int64) == 0


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """(number of each slice's term, the terms). Slices with equal hashes are of one term only if their bytes are equal."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    view = memoryview(data).cast("B")
    hashes = np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    size, head = ends - starts, first[of]
    same = size == size[head]
    check = np.flatnonzero(same)
    same[check] = _same_bytes(data, starts[check], starts[head[check]], size[check])
    terms = [bytes(view[starts[i] : ends[i]]) for i in first.tolist()]
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        term = bytes(view[starts[i] : ends[i]])
        of[i] = others.setdefault(term, len(terms) + len(others))
    return of, terms + list(others)


def counted(texts: list[bytes], groups: np.ndarray):
    """(group, term, occurrences, documents) of some texts, each of the group of that number; terms as a list of their bytes."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    starts, ends = slices(data)
    of, terms = grouped(data, starts, ends)
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    # occurrences of a term in a document, then of a group: sorted keys, summed where they are equal
    key, n = np.unique(doc * max(len(terms), 1) + of, return_counts=True)
    doc, term = np.divmod(key, max(len(terms), 1))
    key, back = np.unique(groups[doc] * max(len(terms), 1) + term, return_inverse=True)
    group, term = np.divmod(key, max(len(terms), 1))
    return group, term, np.bincount(back, n, len(key)).astype(np.int64), np.bincount(back, minlength=len(key)), terms


def _pieces(text: bytes):
    """A long text in pieces of about a block, cut where no term is."""
    at = 0
    while at < len(text):
        end = at + BLOCK_BYTES
        while end < len(text) and IN_TERM[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def counted_long(text: bytes):
    """As `counted` for one long text."""
    total: dict[bytes, int] = {}
    for piece in _pieces(text):
        _, term, n, _, terms = counted([piece], np.zeros(1, np.int64))
        for t, k in zip(term.tolist(), n.tolist(), strict=True):
            total[terms[t]] = total.get(terms[t], 0) + k
    n = np.fromiter(total.values(), np.int64, len(total))
    return np.zeros(len(n), np.int64), np.arange(len(n)), n, np.ones(len(n), np.int64), list(total)


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _blocks(batches):
    """([text], [group]) of at most a block of bytes, or one longer text."""
    texts, groups, size = [], [], 0
    for batch in batches:
        for text, lang, source in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
            data = text.as_py()
            if texts and size + len(data) > BLOCK_BYTES:
                yield texts, groups
                texts, groups, size = [], [], 0
            texts.append(data)
            groups.append((lang, source))
            size += len(data)
    if texts:
        yield texts, groups


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term of each group, summed over all tasks."""

    def run(batches):
        for texts, pairs in _blocks(batches):
            names = sorted(set(pairs))
            number = {p: i for i, p in enumerate(names)}
            groups = np.fromiter((number[p] for p in pairs), np.int64, len(pairs))
            group, term, n, df, terms = counted(texts, groups) if len(texts) > 1 or len(texts[0]) <= BLOCK_BYTES else counted_long(texts[0])
            if not len(n):
                continue
            lang, source = (pa.array([p[k] for p in names]).take(pa.array(group)) for k in (0, 1))
            words = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(term))
            yield pa.RecordBatch.from_arrays([lang, source, words, pa.array(n), pa.array(df, pa.int64())], schema=_COUNTED)

    read = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *_names())
    found = read.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _names():
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


# ---- divergences ----


def p_of(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), by long division: count + 1 <= total."""
    high, rest = np.divmod((count + 1) * 100_000, total)
    return 1 + high * 10_000 + rest * 10_000 // total


def f_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def row_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of a CSR matrix's rows; an empty row's is 0, where reduceat would give an element."""
    out, some = np.zeros(len(edges) - 1, np.int64), edges[1:] > edges[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, edges[:-1][some])
    return out


def pair_sums(edges: np.ndarray, column: np.ndarray, count: np.ndarray, n_columns: int, totals: np.ndarray) -> np.ndarray:
    """The sums of f over a block's terms, for each group (row) against each group (column) of a CSR matrix of counts.

    totals: N + V of each group."""
    zero = p_of(np.zeros(len(totals), np.int64), totals)
    row = np.repeat(np.arange(len(totals)), np.diff(edges))
    p = p_of(count, totals[row])
    out = np.empty((len(totals), len(totals)), np.int64)
    for g in range(len(totals)):
        mine = p[edges[g] : edges[g + 1]]
        dense = np.full(n_columns, zero[g])
        dense[column[edges[g] : edges[g + 1]]] = mine
        here = dense[column]
        fix = row_sums(f_of(here, p) - f_of(here, zero[row]), edges)
        # the group's own terms against each other group's zero: a row of len(mine) for each, a few groups at a time
        step = max(1, BLOCK_COUNTS // max(len(mine), 1))
        for k in range(0, len(totals), step):
            q0 = zero[k : k + step, None]
            own = f_of(mine[None, :], q0).sum(axis=1)
            out[g, k : k + step] = own + (n_columns - len(mine)) * f_of(zero[g], q0[:, 0]) + fix[k : k + step]
    return out


_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("term", pa.string()), ("value", pa.int64())])


def block_divergences(counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Of one block of a language's terms: for each two sources their sum over the block (other), and for each source its `top` terms
    by value. groups: (of, source, total) of all sources of the language `of`; totals are N + V, lang_total that of the language."""
    lang = groups.column("of")[0].as_py()
    sources = groups.column("source").to_pylist()
    order = np.array(sorted(range(len(sources)), key=lambda i: sources[i]))
    sources = [sources[i] for i in order]
    totals = groups.column("total").to_numpy()[order]
    number = {s: i for i, s in enumerate(sources)}
    row = np.fromiter((number[s] for s in counts.column("source").to_pylist()), np.int64, counts.num_rows)
    words = counts.column("term").combine_chunks().dictionary_encode()
    column, terms = words.indices.to_numpy().astype(np.int64), words.dictionary
    by_row = np.lexsort((column, row))
    row, column, count, all_n = row[by_row], column[by_row], counts.column("n").to_numpy()[by_row], counts.column("all_n").to_numpy()[by_row]
    edges = np.searchsorted(row, np.arange(len(sources) + 1))
    out = []
    sums = pair_sums(edges, column, count, len(terms), totals)
    g, h = np.nonzero(~np.eye(len(sources), dtype=bool))
    names = pa.array(sources)
    empty = pa.nulls(len(g), pa.string())
    out.append(pa.table([pa.repeat(lang, len(g)), names.take(pa.array(g)), names.take(pa.array(h)), empty, pa.array(sums[g, h])], schema=_SUMS))
    p, q = p_of(count, totals[row]), p_of(all_n, counts.column("lang_total").to_numpy()[by_row])
    over = np.flatnonzero(p > q)
    if len(over):
        rank = np.empty(len(terms), np.int64)  # Arrow sorts strings by their bytes
        rank[pa.compute.sort_indices(terms).to_numpy()] = np.arange(len(terms))
        value = f_of(p[over], q[over])
        over = over[np.lexsort((rank[column[over]], -value, row[over]))]
        place = np.arange(len(over)) - np.searchsorted(row[over], row[over])
        over = over[place < top]
        out.append(pa.table([pa.repeat(lang, len(over)), names.take(pa.array(row[over])), pa.nulls(len(over), pa.string()), terms.take(pa.array(column[over])), pa.array(f_of(p[over], q[over]))], schema=_SUMS))
    return pa.concat_tables(out)


def audit(docs: DataFrame, least: int = 3, top: int = 200, block: int = BLOCK_COUNTS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of a group's language by their divergence, part
    `term` the `top` terms that a group has more of than its language."""
    all_counts = kept(term_counts(docs))
    groups = kept(docs.select(*_names()).distinct())
    by_lang = all_counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("all_n")).where(F.col("df") >= least).drop("df")
    # a language's term is on both sides, and of no more rows than the language has sources
    counts = kept(all_counts.select("lang", "source", "term", "n").join(by_lang, ["lang", "term"]))
    langs = by_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    totals = groups.join(own, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", (F.coalesce("own_n", F.lit(0)) + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"))
    n_blocks = max(1, -(-counts.count() // block))
    totals = kept(totals)
    at = F.pmod(F.xxhash64("term"), F.lit(n_blocks)).alias("block")
    lang_totals = totals.groupBy("lang").agg(F.first("lang_total").alias("lang_total"))
    left = counts.join(lang_totals, "lang").select("lang", "source", "term", "n", "all_n", "lang_total", at)
    right = left.select("lang", "block").distinct().join(totals.select("lang", "source", "total"), "lang")
    right = right.toDF("of", "at", "source", "total")

    def run(mine: pa.Table, every: pa.Table) -> pa.Table:
        return block_divergences(mine, every, top)

    found = left.groupBy("lang", "block").cogroup(right.groupBy("of", "at")).applyInArrow(run, "lang string, source string, other string, term string, value long")
    found = kept(found)
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")  # the rows asked for
    summed = found.where("term is null").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = found.where("term is not null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).where(F.col("rank") <= top))
