"""Comparing versions by digests of hash ranges: only ranges that differ are read.

A version is laid out by ranges of the key's hash, with a digest for each range
and one for each node above a run of ranges, as the upper levels of a tree.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewarden.functions.digests import row_digest
from tablewarden.operators.compare import diff_rows
from tablewarden.operators.layout import files_for, runs

RANGE = "__range"
#: Binary logarithm of the ranges of a version, and of the ranges below one node.
BITS, NODE_BITS = 12, 6
#: Runs of ranges that go into one filter.
RUNS = 256


def key_range(key: tuple[str, ...], bits: int = BITS) -> Column:
    """The range a key falls into; it only depends on the key."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{k}`") for k in key]), 64 - bits).cast("int")


def _digests(df: DataFrame, at: Column) -> DataFrame:
    """Rows, and two order-free digests of them, for each value of a number."""
    return df.groupBy(at.alias("at")).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").cast("decimal(38,0)").alias("s"))


def write_version(df: DataFrame, path: str, key: tuple[str, ...], bits: int = BITS) -> None:
    """``<path>/rows`` ordered by range, ``<path>/ranges`` and ``<path>/nodes`` with their digests.

    Rows are read once for the layout; digests come from what was written.
    """
    placed = df.withColumn(RANGE, key_range(key, bits))
    dealt = placed.repartitionByRange(files_for(df), RANGE, row_digest(df.schema.fields)).sortWithinPartitions(RANGE)
    dealt.write.parquet(f"{path}/rows")
    digest = row_digest(df.schema.fields)
    rows = df.sparkSession.read.parquet(f"{path}/rows").select(RANGE, F.lit(1).cast("long").alias("n"), digest.alias("x"), digest.cast("decimal(38,0)").alias("s"))
    _digests(rows, F.col(RANGE)).write.parquet(f"{path}/ranges")
    ranges = df.sparkSession.read.parquet(f"{path}/ranges")
    _digests(ranges, F.shiftright("at", NODE_BITS)).write.parquet(f"{path}/nodes")


def _unequal(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.withColumn("w", F.lit(1)).unionByName(after.withColumn("w", F.lit(2)))
    sides = both.groupBy("at").agg(F.count(F.lit(1)).alias("sides"), *[F.count_distinct(c).alias(c) for c in ("n", "x", "s")])
    return sides.where("sides < 2 OR n > 1 OR x > 1 OR s > 1").select("at")


def unequal_ranges(spark: SparkSession, before: str, after: str) -> list[int]:
    """Numbers of the ranges whose digests differ; the digests of ranges are only compared below nodes that differ.

    At most ``2 ** bits`` numbers, whatever the size of the versions.
    """
    read = lambda path, level: spark.read.parquet(f"{path}/{level}")
    nodes = [r[0] for r in _unequal(read(before, "nodes"), read(after, "nodes")).collect()]
    if not nodes:
        return []
    below = F.shiftright("at", NODE_BITS).isin(nodes)
    return sorted(r[0] for r in _unequal(read(before, "ranges").where(below), read(after, "ranges").where(below)).collect())


def diff_versions(spark: SparkSession, before: str, after: str, key: tuple[str, ...]) -> DataFrame:
    """What :func:`diff_rows` finds between two written versions, from the ranges that differ.

    Both must have been written with the same key and number of ranges. Where
    their columns differ, every row is compared in those they share.
    """
    old, new = spark.read.parquet(f"{before}/rows"), spark.read.parquet(f"{after}/rows")
    if old.schema == new.schema:
        found = unequal_ranges(spark, before, after)
        at = F.col(RANGE)
        wanted = reduce(or_, [at.between(a, b) for a, b in runs(found, RUNS)]) if found else F.lit(False)
        old, new = old.where(wanted), new.where(wanted)
    return diff_rows(old.drop(RANGE), new.drop(RANGE), key)
