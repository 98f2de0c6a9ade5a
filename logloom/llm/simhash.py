"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most `radius` bits must agree, up to half of what is left, on something that both can
name. The 64 bits are cut into blocks. With one block left out (the one in which the pair differs most) at most
`left` = radius - ceil(radius / blocks) bits differ on the others, so both fingerprints reach a common value there by
changing at most half of `left` bits. Every distinct fingerprint therefore emits, for each left-out block, all variants
of its other bits within that half radius; equal variants meet in a shuffle, repeats are dropped, and pairs that meet
are verified by the bits that differ. For radius 3 and three blocks that is 132 variants on 42 or 43 bits, where chance
meetings stay rare for many billions of fingerprints.

Groups of variants are read in sorted order, one after the other. A group links to a forest that spans it, not to all
pairs. A group of more than `large` fingerprints is not compared inside: its fingerprints go through the same method
once more with no block left out, where a common variant within floor(radius/2) of one and ceil(radius/2) of another
proves the link by itself, so that a star around one fingerprint is enough. Nothing is dropped.

Nulls and texts without words get fingerprint zero, and link like any other. Components are those of fingerprints; ids, null
or shared by several texts, are looked up afterwards, so they neither make nor break a link. Repeated rows stay repeated.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, components, cut, text_hashes, texts, words_of

SEED = 42
#: Hashes that are added up at a time.
AT_A_TIME = 1 << 15


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over XXH64 (seed 42) of the word shingles, repeats included; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), AT_A_TIME):
        part = hashes[k : k + AT_A_TIME]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = 3, with_hashes: bool = False) -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed number; `with_hashes` adds two of the whole text, a and b."""
    names = ("a", "b") if with_hashes else ()
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *names)])

    def run(batches):
        for batch in batches:
            fps = [simhash(x.as_py(), shingle) for x in batch.column("text")]
            yield batch_of(schema, batch.column("doc_id"), np.array(fps, np.uint64).view(np.int64), *(batch.column(c) for c in names))

    rows = texts(df)
    return (rows.select("*", *text_hashes("text")) if with_hashes else rows).mapInArrow(run, ", ".join(f"{c} long" for c in schema.names))


def ball(mask: int, reach: int) -> np.ndarray:
    """What to xor to reach all values within `reach` changed bits of `mask`."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return np.array([sum(c) for r in range(reach + 1) for c in combinations(bits, r)], np.uint64)


def left_out(blocks: int) -> list[int]:
    """The masks of the bits that stay when one of `blocks` blocks is left out."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << 64) - 1) ^ ((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]


def _spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a forest that spans the links among a group's fingerprints."""
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    waiting, edges = np.arange(len(fps)), []
    while len(waiting) > 1:
        edge, waiting = [int(waiting[0])], waiting[1:]
        while edge and len(waiting):
            i = edge.pop()
            near = np.bitwise_count(fps[waiting] ^ fps[i]) <= radius
            found = waiting[near].tolist()
            edges += [(i, j) for j in found]
            edge += found
            waiting = waiting[~near]
    return edges


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_MET = "block int, variant long, reach int, fp long"


def variants(distinct: DataFrame, masks: list[int], reach: int) -> DataFrame:
    """Rows (block, variant, reach, fp) of every fingerprint in column fp: all its variants, on the bits of each mask."""
    schema = pa.schema([("block", pa.int32()), ("variant", pa.int64()), ("reach", pa.int32()), ("fp", pa.int64())])

    def run(batches):
        balls = [(np.uint64(m), ball(m, reach)) for m in masks]
        for batch in batches:
            all_fps = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(all_fps), 1000):
                fps = all_fps[k : k + 1000]
                for block, (mask, flips) in enumerate(balls):
                    met = ((fps & mask)[:, None] ^ flips[None, :]).ravel()
                    far = np.tile(np.bitwise_count(flips).astype(np.int32), len(fps))
                    yield batch_of(schema, np.full(len(met), block, np.int32), met.view(np.int64), far, np.repeat(fps, len(flips)).view(np.int64))

    return distinct.select("fp").mapInArrow(run, _MET)


def _runs(batches):
    """(fps, reaches) of each group of equal (block, variant) in a sorted task, as far as it has two rows. Groups come in pieces
    of at most a batch; a piece of the same group as the one before says so."""
    last = None
    for batch in batches:
        block, variant, reach, fp = (batch.column(i).to_numpy() for i in range(4))
        if not len(fp):
            continue
        starts = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (variant[1:] != variant[:-1]))))
        ends = np.concatenate((starts[1:], [len(fp)]))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            key = (block[a], variant[a])
            if b == len(fp) or key == last or b - a > 1:
                yield key == last, fp[a:b].view(np.uint64), reach[a:b]
            last = key


def _met(batches, radius: int, large: int):
    """Links inside groups of up to `large` fingerprints; of larger ones (fp, fp) for each member."""
    members: list[np.ndarray] = []
    count = 0

    def close():
        nonlocal members, count
        out = []
        if 2 <= count <= large:
            fps = np.unique(np.concatenate(members))
            out = [(int(fps[i].view(np.int64)), int(fps[j].view(np.int64))) for i, j in _spanning(fps, radius)]
        members, count = [], 0
        return out

    found: list[tuple[int, int]] = []
    for goes_on, fps, _ in _runs(batches):
        if not goes_on:
            found += close()
        count += len(fps)
        members.append(fps)
        if count > large:  # of no bounded size: passed on as they come
            found += [(x, x) for part in members for x in part.view(np.int64).tolist()]
            members = []
        if len(found) > 50_000:
            yield batch_of(_EDGES, *map(list, zip(*found, strict=True)))
            found = []
    found += close()
    if found:
        yield batch_of(_EDGES, *map(list, zip(*found, strict=True)))


def _stars(batches, radius: int):
    """Links of every group to its first fingerprint (the one of least reach), where the reaches prove them."""
    centre, least, found = 0, 0, []
    for goes_on, fps, reach in _runs(batches):
        at = 0
        if not goes_on:
            centre, least, at = int(fps[0].view(np.int64)), int(reach[0]), 1
        found += [(centre, x) for x, r in zip(fps[at:].view(np.int64).tolist(), reach[at:].tolist(), strict=True) if r + least <= radius and x != centre]
        if len(found) > 50_000:
            yield batch_of(_EDGES, *map(list, zip(*found, strict=True)))
            found = []
    if found:
        yield batch_of(_EDGES, *map(list, zip(*found, strict=True)))


def _sorted(met: DataFrame) -> DataFrame:
    return met.repartition("block", "variant").sortWithinPartitions("block", "variant", "reach", "fp")


def links(distinct: DataFrame, radius: int = 3, blocks: int = 3, large: int = 4096) -> DataFrame:
    """(a, b): enough pairs of fingerprints within `radius` bits to connect all that are connected by such pairs."""
    left = radius - -(-radius // blocks)
    if left % 2:
        raise ValueError("the bits left after one block must halve")
    met = cut(_sorted(variants(distinct, left_out(blocks), left // 2)).mapInArrow(lambda b: _met(b, radius, large), "a long, b long").distinct())
    rest = met.where("a = b").select(F.col("a").alias("fp"))
    whole = _sorted(variants(rest, [(1 << 64) - 1], -(-radius // 2)))
    return met.where("a <> b").union(whole.mapInArrow(lambda b: _stars(b, radius), "a long, b long")).distinct()


def _homes(distinct: DataFrame, radius: int, large: int) -> DataFrame:
    """(fp, root) of each fingerprint that links to another: root is the same for all that links reach."""
    return components(links(distinct, radius, large=large)).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def near_duplicates(df: DataFrame, radius: int = 3, shingle: int = 3, large: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the smallest doc_id that links reach.

    Null ids stay null and never become a component's id, unless a component has no other id. Links run over fingerprints, so
    rows without an id carry links like any other, and texts that share an id are linked only if they are alike.
    """
    marked = cut(fingerprints(df, shingle))
    # one row for each distinct fingerprint; grouped by more than the key so that a later join can split a hot key
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    rooted = distinct.join(_homes(distinct, radius, large), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).repartition(F.xxhash64("root"))  # as in `components`
    home = cut(rooted.join(least, "root").select("fp", "component_id"))
    return marked.join(home, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, radius: int = 3, shingle: int = 3, large: int = 4096) -> DataFrame:
    """`df` with one document of each component, that of the smallest id; all columns stay.

    A document is an id with a text: rows that repeat both are one. Among documents of the smallest id, and where no document of
    a component has an id, a hash of the text chooses. Decisions are made over ids and hashes; texts move once, to meet them.
    """
    key = "_".join([*df.columns, "key"])  # a name that is free
    one = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("a"), F.col("b"))
    marked = fingerprints(df, shingle, with_hashes=True)
    distinct = cut(marked.groupBy("fp").agg(F.min(one).alias("first")))
    rooted = distinct.join(_homes(distinct, radius, large), "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("first").alias("first")).select(*(F.col(f"first.{c}").alias(f"{key}_{c}") for c in ("unnamed", "id", "a", "b")))
    names = [f"{key}_{c}" for c in ("unnamed", "id", "a", "b")]
    keyed = df.select("*", F.col("doc_id").isNull().alias(names[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(names[1]), *text_hashes("text", names[2:]))
    return keyed.join(stays, names, "left_semi").dropDuplicates(names).select(*df.columns)
