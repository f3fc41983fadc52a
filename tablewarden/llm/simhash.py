"""SimHash near-duplicates, linked through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewarden.functions.digests import row_digest
from tablewarden.llm.common import Placed, Stages, as_bytes, complete_groups, pick, ship_package, table, word_lists
from tablewarden.llm.components import components

BYTES = 8
#: Rows of one posting list that are compared in one go; longer lists are dealt into cells.
CELL = 2048


def _fingerprint(data: bytes, shingle: int, seed: int) -> int:
    """Of a lower-cased text: a bit is 1 if it is set in over half of the shingles' XXH64."""
    ones, n, tail, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_digest
    for words in word_lists(data):
        words = tail + words
        if len(words) >= shingle:
            rows = [words[k:] for k in range(shingle)]
            hashes = b"".join([digest(b" ".join(s), seed) for s in zip(*rows, strict=False)])
            bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
            n += len(bits)
            for at in range(0, len(bits), 4096):
                ones += np.unpackbits(bits[at : at + 4096], axis=1).sum(0, dtype=np.int64)
            tail = words[len(words) - shingle + 1 :] if shingle > 1 else []
        else:
            tail = words
    if not n:
        if not tail:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(tail), seed)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The 64-bit SimHash of a text as a long; NULL and texts without words have 0.

    A-Z count as a-z. A text with fewer words than a shingle is one shingle.
    """
    return fingerprint_of_bytes(as_bytes(text), shingle, seed)


def fingerprint_of_bytes(data: Column, shingle: int = 3, seed: int = 42) -> Column:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        prints = np.array([_fingerprint(t.as_py().lower(), shingle, seed) for t in texts], np.uint64)
        return pa.array(prints.view(np.int64))

    return of(data)


def _triples(distance: int) -> list[tuple[int, ...]]:
    """Byte positions such that two fingerprints within the distance agree on all positions of one entry.

    They share ``8 - distance`` bytes at least. With 3 bits, 5 shared bytes put
    3 into one half of the word, so the triples of both halves are enough: 8 keys.
    """
    shared = BYTES - distance
    per_half = -(-shared // 2)
    return [c for half in (range(4), range(4, 8)) for c in combinations(half, per_half)]


def _postings(prints: DataFrame, distance: int) -> DataFrame:
    """``(key, fp)``: the inverted index over values at groups of byte positions."""
    groups = _triples(distance)
    keys = []
    for i, places in enumerate(groups):
        key = F.lit(i).cast("long")
        for p in places:
            byte = F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))
            key = F.shiftleft(key, 8).bitwiseOR(byte)
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _cells(postings: DataFrame) -> DataFrame:
    """Deals long posting lists into cells that hold two chunks each, so that every pair meets in one cell."""
    long = postings.groupBy("key").count().where(F.col("count") > CELL).select(
        "key", F.ceil(F.col("count") / CELL).cast("long").alias("chunks")
    )
    chunk = F.pmod(F.xxhash64("fp", "key"), F.col("chunks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: j != F.col("chunk"))
    # a list of one cell stays whole
    return (
        postings.join(long, "key", "left")
        .withColumn("chunk", F.when(F.col("chunks").isNotNull(), chunk))
        .withColumn("cells", F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(others, lambda j: F.least(j, F.col("chunk")) * F.col("chunks") + F.greatest(j, F.col("chunk")))
        ))
        .select("key", F.explode("cells").alias("cell"), "fp")
    )


def _spanning(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected in a posting list, one per fingerprint and not one per pair."""
    links, left = [], prints
    while left.size:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and left.size:
            differing = left ^ frontier.pop()
            # the tally of shared positional bytes comes first, the bits are counted for what reaches it
            tally = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
            near = tally >= BYTES - distance
            near[near] = np.bitwise_count(differing[near]) <= distance
            if near.any():
                found, left = left[near], left[~near]
                links.extend((int(root), int(f)) for f in found)
                frontier.extend(found)
    return links


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``(a, b)``: links that connect all distinct fingerprints ``fp`` within the distance, directly or by others."""
    ship_package(prints.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in complete_groups(batches, ["key", "cell"], ["fp"]):
            found = []
            for k in np.flatnonzero(np.diff(at) > 1):
                found += _spanning(rows["fp"][at[k] : at[k + 1]].view(np.uint64), distance)
            if found:
                ends = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    dealt = _cells(_postings(prints, distance)).repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(compare, "a long, b long")


def candidate_pairs(stages: Stages, prints: DataFrame, distance: int = 3) -> DataFrame:
    """``(a, b)`` with ``a > b``: pairs that connect the rows of ``id, fp`` whose fingerprints are linked.

    Each row is paired with the smallest ``id`` of its fingerprint, and these
    with one another as :func:`links` has their fingerprints.
    """
    prints, _ = stages.write(prints)
    of_print, _ = stages.write(prints.groupBy("fp").agg(F.min("id").alias("least")))
    same = prints.join(of_print, "fp").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    ends = links(of_print.select("fp"), distance)
    for end in ("a", "b"):
        ends = ends.join(of_print.select(F.col("fp").alias(end), F.col("least").alias(f"of_{end}")), end)
    apart = ends.select(F.greatest("of_a", "of_b").alias("a"), F.least("of_a", "of_b").alias("b"))
    return same.unionAll(apart).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, digest, fp, component_id`` for every row of ``docs``.

    Fingerprints within ``distance`` bits are linked; ``component_id`` is the
    smallest ``doc_id`` reachable. Fingerprints are compared once each, however
    many rows share one. Rows without words have fingerprint 0 and are linked
    to one another. Repeated rows stay; a NULL ``doc_id`` is never the smallest
    one, and a group of such rows only has a NULL component. ``digest`` tells
    rows of one ``doc_id`` apart. An empty table gives no rows.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the byte index is complete for 0 to 3 bits")
    spark = docs.sparkSession
    ship_package(spark)
    placed = Placed(docs)
    rows = placed.df.select(
        placed.col("doc_id").alias("doc_id"), row_digest(list(placed.df.schema.fields)).alias("digest"),
        fingerprint(placed.col("text"), shingle, seed).alias("fp"),
    )
    stages = Stages(spark, "simhash")
    rows, _ = stages.write(rows)
    prints, _ = stages.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(prints.select("fp"), distance))
    of_root = prints.join(groups, prints.fp == groups.node).select("fp", "root", "least")
    least = of_root.groupBy("root").agg(F.min("least").alias("linked"))
    linked = of_root.join(least, "root").select("fp", "linked")
    # as a table of its own, so that a fingerprint many rows share is a skewed join that Spark can split
    classes, _ = stages.write(prints.join(linked, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id")))
    return rows.join(classes, "fp").select("doc_id", "digest", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The documents of which one stays in each group: the smallest ``doc_id``, then the smallest row digest.

    All columns come back unchanged. Rows with a NULL ``doc_id`` come last in
    their group; of rows that are equal in all columns one stays.
    """
    placed = Placed(docs)
    found, _ = Stages(docs.sparkSession, "near").write(near_duplicates(docs, shingle, distance))
    # a group is known by the smallest id in it; groups without any id by their fingerprint
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    return keep_first(placed, found.groupBy(group.alias("group")).agg(F.min(order).alias("first")))


def keep_first(placed: Placed, groups: DataFrame) -> DataFrame:
    """The rows that ``first.doc_id`` and ``first.digest`` of some group name, one of equal ones, with all their columns."""
    stay = groups.select(F.col("first.doc_id").alias("__doc"), F.col("first.digest").alias("__digest"))
    rows = placed.df.withColumn("__own", row_digest(list(placed.df.schema.fields)))
    kept = rows.join(stay, (F.col("__own") == F.col("__digest")) & placed.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
    equal = Window.partitionBy("__own", placed.place("doc_id")).orderBy("__own")
    return placed.restore(kept.withColumn("__n", F.row_number().over(equal)).where("__n = 1"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
