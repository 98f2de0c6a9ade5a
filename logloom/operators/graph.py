"""Fixpoints over program graphs held as edge tables. Every round is a join and an aggregate; lineage is cut each round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut as _cut

#: So many parts of a fixpoint's rows, each written at the end of a round, are written anew as one.
PARTS = 8


def _whole(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (rows for _, rows in parts))


def _with_part(parts: list[tuple[int, DataFrame]], new: DataFrame) -> list[tuple[int, DataFrame]]:
    """`parts` (rank, rows) and one more of rank 0. The last `PARTS` of one rank become one of the next, so that after any number of
    rounds there are few parts to read, their number growing with its logarithm, and a row is written again as often as that."""
    parts = [*parts, (0, new)]
    while len(parts) >= PARTS and parts[-PARTS][0] == parts[-1][0]:
        parts = [*parts[:-PARTS], (parts[-1][0] + 1, _cut(_whole(parts[-PARTS:])))]
    return parts


def predecessors(edges: DataFrame) -> DataFrame:
    """(node, predecessors): the sorted distinct sources of each node's edges (src, dst)."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("predecessors"))


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, depth): the nodes that entries (node) reach, with the fewest steps. Only the frontier is joined each round.

    Both joins are sort-merge joins: a broadcast would take each round's frontier through the driver."""
    frontier, depth = _cut(entries.select("node", F.lit(0).alias("depth")).distinct()), 0
    parts = [(0, frontier)]
    edges = _cut(edges.select("src", "dst").distinct())
    while True:
        depth += 1
        new = frontier.hint("merge").join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = _cut(new.hint("merge").join(_whole(parts), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return _whole(parts)
        parts = _with_part(parts, frontier)


def live_in(edges: DataFrame, uses: DataFrame, defs: DataFrame) -> DataFrame:
    """(node, var) live on entry to a node: used there, or live on entry to a successor and not defined there.

    edges (src, dst), uses (node, var), defs (node, var). Facts spread backwards; each round joins the new ones only.
    """
    new = _cut(uses.select("node", "var").distinct())
    parts = [(0, new)]
    edges, defs = _cut(edges.select("src", "dst").distinct()), _cut(defs.select("node", "var").distinct())
    while True:
        back = new.hint("merge").join(edges, new.node == edges.dst).select(F.col("src").alias("node"), "var").distinct()
        new = _cut(back.hint("merge").join(defs, ["node", "var"], "left_anti").hint("merge").join(_whole(parts), ["node", "var"], "left_anti"))
        if new.isEmpty():
            return _whole(parts)
        parts = _with_part(parts, new)


def chain_places(links: DataFrame, key: list[str]) -> DataFrame:
    """(key, node, head, place): of nodes in chains (key, node, next) with at most one link into and out of each, the chain's first node
    and how many links lie before the node. Nodes that no link leads to are not returned; cycles have no head and are not either.

    Pointer jumping: each round every node's pointer skips to where that of its target points, so rounds are the logarithm of a chain."""
    now = _cut(links.select(*key, F.col("next").alias("node"), F.col("node").alias("head"), F.lit(1).cast("long").alias("place")))
    n = now.count()
    for _ in range(max(1, n.bit_length() + 1)):  # what still moves then goes round in a cycle
        up = now.select(*key, F.col("node").alias("head"), F.col("head").alias("_head"), F.col("place").alias("_place"))
        met = now.hint("merge").join(up, [*key, "head"], "left")
        now = _cut(met.select(*key, "node", F.coalesce("_head", "head").alias("head"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"), F.col("_head").isNotNull().alias("_went")))
        if now.where("_went").isEmpty():
            return now.drop("_went")
        now = now.drop("_went")
    targets = links.select(*key, F.col("next").alias("head")).distinct()
    return now.join(targets, [*key, "head"], "left_anti")
