"""Operator 6: sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieline.llm.common import table

#: Rows that get their slot numbers together; a (shard, block) pair is the unit of work, never a whole shard.
ROWS_PER_BLOCK = 100_000
MAX_BLOCKS = 4096


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of unsigned 64-bit keys, for all keys at once."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = keys.astype(np.uint64).copy()
    bucket, jump = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = jump[live]
        k = key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        jump[live] = ((bucket[live] + 1) * (2147483648.0 / ((k >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[jump[live] < shards]
    return bucket.astype(np.int32)


def shard_column(key, shards: int):
    """Column of the shard of a 64-bit key column."""

    @F.pandas_udf("int")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(jump_hash(s.to_numpy(np.int64).view(np.uint64), shards))

    return place(key)


def assign_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Give every row a shard from its key alone, and a gapless slot inside its shard.

    Adds ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``law``, ``shard``, ``grown_shard`` (with one shard more)
    and ``slot``. Columns of these names in the input are replaced; other columns pass through. A null key is a key
    of its own, a null text has no bytes (size 8, crc 0). Rows with the same key share a shard; among rows that are
    equal in key, size and text checksum the slots are interchangeable. An empty table stays empty.

    The key is hashed to 64 bits first, so dense ids spread evenly. Slots need no shard to be sorted in one task:
    rows fall in blocks within a shard by a hash of key, size and text checksum (a repeated key is dealt out), the block sizes (shards x blocks numbers, bounded) give the offsets,
    and rows are numbered within a block.
    """
    spark = docs.sparkSession
    own = ["size", "text_crc32", "law", "shard", "grown_shard", "slot", "_key", "_block", "_base"]
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.drop(*[c for c in own if c not in (key, text)])
    placed = (
        base.withColumn("_key", F.xxhash64(F.col(key), F.col(key).isNull()))
        .withColumn("size", F.octet_length(body).cast("long") + 8)
        .withColumn("text_crc32", F.crc32(body.cast("binary")))
        .withColumn("law", F.lit("key"))
        .withColumn("shard", shard_column(F.col("_key"), shards))
        .withColumn("grown_shard", shard_column(F.col("_key"), shards + 1))
    )
    blocks = int(min(MAX_BLOCKS, max(4, docs.count() // (shards * ROWS_PER_BLOCK) * 2)))
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("_key", "text_crc32", "size", F.lit(17)), F.lit(blocks)).cast("int"))
    counts = {(r[0], r[1]): r[2] for r in placed.groupBy("shard", "_block").count().collect()}  # at most shards x MAX_BLOCKS numbers
    offsets = []
    for s in range(shards):
        at = 0
        for b in range(blocks):
            if (s, b) in counts:
                offsets.append((s, b, at))
                at += counts[s, b]
    start = spark.createDataFrame(offsets or [], "shard int, _block int, _base long")
    order = Window.partitionBy("shard", "_block").orderBy("_key", "size", "text_crc32")
    return (
        placed.join(F.broadcast(start), ["shard", "_block"])  # bounded: shards x MAX_BLOCKS rows
        .withColumn("slot", F.col("_base") + F.row_number().over(order) - 1)
        .drop("_key", "_block", "_base")
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards; the text itself is not moved."""
    out = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
