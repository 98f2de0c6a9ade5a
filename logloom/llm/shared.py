"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lower-casing of the contracts: A to Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a temporary one on a local master.

    On a cluster an unset folder is an error: executors would write to disks of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="logloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder, so that lost executors cost no more than a reread."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, as UTF-8. bytes.lower and bytes.split know ASCII only."""
    return text.encode().lower().split() if text else []


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that a text operator reads; extra columns and clashing names stay behind."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def text_hashes(text: str, names=("a", "b")) -> list:
    """Two 64-bit hashes of a text column, which together tell different texts apart; null counts as a text of its own."""
    column = F.col(text).cast("string")
    return [F.xxhash64(column, F.lit(seed)).alias(n) for seed, n in enumerate(names)]


def rows(batches, *names):
    """Python values row by row, over all Arrow batches of a task."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def held_out(key: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as `edges` (a, b): component is the smallest node reachable.

    Alternates two steps until nothing changes: every node's larger neighbours are hung on its smallest neighbour, then
    every node's smaller neighbours are hung on the smallest of them. Both keep the components, need O(log^2) rounds, and
    their messages are aggregates (min), so a node with very many neighbours is pre-aggregated before the shuffle.
    Each round is kept in the shared folder. Self links are ignored; nodes without any other link are not returned.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    known = None
    for _ in range(rounds):
        # the smallest neighbours are dealt anew before each join, so that both sides of it are plain exchanges: only then
        # can adaptive execution split the rows of a node with very many neighbours
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")).repartition(F.xxhash64("v"))
        # larger neighbours of v go to the smallest of v and its neighbours
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m")).repartition(F.xxhash64("v"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        now = cut(small.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct())
        # a star forest has each v once, and no centre that is itself a v
        seen = now.agg(F.count("*").alias("n"), F.countDistinct("v").alias("d"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if seen == known:
            break
        known = seen
    else:
        raise RuntimeError("the components did not settle")
    return now.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component").union(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def kept(df: DataFrame) -> DataFrame:
    """`df`, written once as a compressed table in the shared folder and read again; for what is too large for `cut`."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
