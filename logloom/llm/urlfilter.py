"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact join, then rules by host and path.

The list is hashed into blocks of eight 64-bit words; a URL sets one bit in each word of one block, so that a look-up reads
one short stretch of memory. URLs that the filter rules out are done. The few that pass are joined with the list itself by
hash, which removes what the filter passed by chance. The filter is built on the executors, each of which sends only the
words of its blocks; its size is set by the list's length and bounded by `most_blocks`. A longer list makes the filter
coarser, so that more URLs reach the join, but never wrong.

Canonical: no scheme, user, port 80 or 443, leading `www.` or `m.`, fragment, query or trailing slashes; the host in lower
case. Rules overrule the list: one fits its host and all subdomains, and paths that start with its own; the longest fitting
one wins (host first, then path). Nulls: a null url, or one without `://`, has empty host and path, fits no rule, is not
listed, and is allowed. Repeated rows stay repeated. Empty tables and lists work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, batch_of

#: 64-bit words of a block; a URL sets one bit in each.
WORDS = 8
#: URLs a block is made for: 512 bits for 32 URLs pass about one in a thousand others.
PER_BLOCK = 32


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str
    path: str


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url column; both empty without `://`."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)  # the first "://" is the leftmost match
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed, from host and path; null without a host."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)?$", ""), r"^(www|m)\.", "")
    return F.when(F.length(name) > 0, F.concat(name, F.regexp_replace(path, r"/+$", "")))


def fitting(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. Rules are a short fixed list."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.host), len(r.path))):  # the last to be tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


class Filter:
    """A blocked Bloom filter over 64-bit hashes."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks  # of shape (blocks, WORDS)

    @staticmethod
    def places(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash, and one bit for each word of it."""
        block = ((hashes >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
        low = (hashes & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        bits = (low[:, None] >> (np.arange(WORDS, dtype=np.uint64) * np.uint64(7) + np.uint64(2))[None, :]) & np.uint64(63)
        return block.astype(np.int64), np.uint64(1) << bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = self.places(hashes, len(self.blocks))
        return ((self.blocks[block] & bits) == bits).all(axis=1)


def build(listed: DataFrame, most_blocks: int = 1 << 20) -> Filter:
    """The filter of a list (column canonical). At most `most_blocks` blocks of 64 bytes come to the driver."""
    n_blocks = max(1, min(most_blocks, -(-listed.count() // PER_BLOCK)))

    def run(batches):
        table = {}
        for batch in batches:
            hashes = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            block, bits = Filter.places(hashes, n_blocks)
            for b in np.unique(block).tolist():
                table[b] = np.bitwise_or.reduce(bits[block == b], axis=0) | table.get(b, np.zeros(WORDS, np.uint64))
        schema = pa.schema([("block", pa.int64()), *((f"w{k}", pa.int64()) for k in range(WORDS))])
        if table:
            words = np.stack(list(table.values())).view(np.int64)
            yield batch_of(schema, list(table), *words.T)

    shape = ", ".join(f"w{k} long" for k in range(WORDS))
    rows = listed.where("canonical is not null").select(F.xxhash64("canonical").alias("h")).mapInArrow(run, f"block long, {shape}")
    found = rows.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS))).toArrow()
    blocks = np.zeros((n_blocks, WORDS), np.uint64)
    for k in range(WORDS):
        blocks[found["block"].to_numpy(), k] = found[f"w{k}"].to_numpy().view(np.uint64)
    return Filter(blocks)


def passing(df: DataFrame, found: Filter) -> DataFrame:
    """`df` with a column maybe: whether the filter passes its column canonical."""
    sent = df.sparkSession.sparkContext.broadcast(found)  # 64 MB at most

    def run(batches):
        for batch in batches:
            hashes = batch.column("h")
            hit = sent.value.has(hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "h"), pa.array(hit)], [*(c for c in batch.schema.names if c != "h"), "maybe"])

    hashed = df.withColumn("h", F.coalesce(F.xxhash64("canonical"), F.lit(0)))
    shape = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return hashed.mapInArrow(run, f"{shape}, maybe boolean").withColumn("maybe", F.col("maybe") & F.col("canonical").isNotNull())


def judged(pages: DataFrame, listed: DataFrame, rules: list[Rule], *, most_blocks: int = 1 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of each row of `pages` (page_id, url), with a list of URLs (column url)."""
    host, path = host_and_path("url")
    entries = listed.select(*(c.alias(n) for c, n in zip(host_and_path("url"), ("host", "path"), strict=True)))
    entries = entries.select(canonical(F.col("host"), F.col("path")).alias("canonical")).where("canonical is not null").distinct()
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    tested = passing(urls, build(entries, most_blocks))
    # what does not pass meets nothing, and is dealt out by its id; hot URLs that pass are split at run time
    keyed = tested.withColumn("key", F.when(F.col("maybe"), F.col("canonical")).otherwise(F.col("page_id").cast("string")))
    exact = keyed.join(entries.select(F.col("canonical").alias("key"), F.lit(True).alias("maybe"), F.lit(True).alias("listed")), ["key", "maybe"], "left")
    out = exact.withColumn("fit", fitting(rules, F.col("host"), F.col("path"))).withColumn("listed", F.coalesce("listed", F.lit(False)))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
