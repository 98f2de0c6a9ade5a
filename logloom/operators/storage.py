"""Intermediate tables of the engine, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps that `together` has in work at a time.
STEPS_AT_ONCE = 6


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset a temporary folder on a local master. On a cluster it has to be set: executors would
    write to disks of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="logloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once, without its lineage; lost executors cost no more than a reread."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """`df` as a table written once and read again (by `session`): for what several later steps read, each a few columns of it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def _session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session of the same application, with the settings of `spark` and these."""
    own = spark.newSession()
    for key, value in (spark.conf.getAll | settings).items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


_BY_SHUFFLE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def without_broadcasts(spark: SparkSession) -> SparkSession:
    """A session that joins by shuffle unless a join asks for a broadcast by itself.

    The size of a few columns of a table is guessed from its compressed files, often a hundredth of what they are in memory: tables with
    a row for each log would go through the driver whole."""
    return _session(spark, _BY_SHUFFLE)


def in_place(spark: SparkSession) -> SparkSession:
    """A session for rounds over tables that `dealt` out by one key: joins, aggregates and windows whose keys have that key among them
    take rows where they are, and shuffle nothing. Adaptive plans would forget where a checkpoint's rows are."""
    return _session(spark, _BY_SHUFFLE | {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.requireAllClusterKeysForDistribution": "false"})


def dealt(df: DataFrame, key: str, session: SparkSession) -> DataFrame:
    """`df` computed once, and dealt out by a key for a session that works `in_place`."""
    table = kept(df, session)
    return cut(table.repartition(int(session.conf.get("spark.sql.shuffle.partitions")), key))


def together(spark: SparkSession, *steps: Callable) -> list:
    """The results of steps that do not read one another's tables, in their order.

    A driver plans each job on one core, and of short jobs with long plans that is most of the time: what some of them are planned for
    is computed while others are planned."""
    shared_folder(spark)
    with ThreadPoolExecutor(STEPS_AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def side_by_side(parts: list[DataFrame], key: str) -> DataFrame:
    """A row for each key with the columns of all parts, of which each has one row for a key at most: one aggregate over all of them.

    A row of joins would copy at each join what those before it found, by code of its own that each task builds anew."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(key).agg(*(F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c != key))
