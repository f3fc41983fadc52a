"""Shards by jump consistent hashing of a stable key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewarden.functions.digests import row_digest
from tablewarden.llm.common import Placed, pick, running_sum, ship_package, table


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; with one more shard a key stays or goes to the new one.

    A key jumps from shard to shard, and each jump's length follows from the
    next number of a generator that the key seeds; its last place below
    ``shards`` counts. No table of shards is needed, and about log(shards) jumps
    are made.
    """
    state = keys.astype(np.uint64)
    place = np.zeros(len(state), np.int64)
    after = np.zeros(len(state), np.float64)
    open_ = np.flatnonzero(after < shards)
    while len(open_):
        place[open_] = after[open_].astype(np.int64)
        # the fixed generator of jump consistent hashing
        state[open_] = state[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[open_] >> np.uint64(33)).astype(np.float64) + 1.0
        after[open_] = np.floor((place[open_] + 1) * (float(1 << 31) / draw))
        open_ = open_[after[open_] < shards]
    return place


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key hash, a long."""

    @F.arrow_udf("int")
    def of(keys: pa.Array) -> pa.Array:
        return pa.array(jump(keys.to_numpy(zero_copy_only=False).view(np.uint64), shards).astype(np.int32))

    return of(key)


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id") -> DataFrame:
    """All rows and columns with ``shard``, ``slot`` and ``grown_shard``.

    The shard follows from the key column and the number of shards alone;
    ``grown_shard`` is the shard if there were one more. Rows with one key,
    NULL among them, share a shard. ``slot`` numbers the rows of a shard from 0
    without gaps, in an order that only depends on the rows; it is settled over
    cells of a shard, so no task holds a whole one. Rows that are equal in all
    columns get different slots. An empty table stays empty. An added column
    whose name is taken gets a leading underscore.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    ship_package(docs.sparkSession)
    placed = Placed(docs)
    # the hash of a NULL key is the seed, as that of any value fixed
    hashed = F.xxhash64(placed.col(key))
    rows = placed.df.withColumn("__spread", row_digest(list(placed.df.schema.fields))).withColumn("__key", hashed)
    rows = rows.withColumn("shard", shard_of(F.col("__key"), shards)).withColumn("grown_shard", shard_of(F.col("__key"), shards + 1))
    rows = running_sum(rows, ["shard"], "__spread", ["__key"], F.lit(1).cast("long"), "slot")
    return placed.restore(rows, F.col("shard"), F.col("slot"), F.col("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id", rows_per_file: int = 100_000) -> None:
    """Shards as folders ``shard=N`` of Parquet files, in slot order within and across the files of a shard."""
    rows = assign(docs, shards, key)
    shard, slot = rows.columns[-3:-1]
    files = F.floor(F.col(slot) / rows_per_file)
    rows.withColumn("__file", files).repartition(F.col(shard), F.col("__file")).sortWithinPartitions(shard, slot).drop(
        "__file"
    ).write.partitionBy(shard).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign(rows, 8).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
