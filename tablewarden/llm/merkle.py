"""Merkle manifest of a table: a digest tree per language, one over languages, and a proof for every row.

Leaves are dealt into superblocks, aligned runs of ``2 ** bits`` of them, each a
subtree. Superblocks are reduced on their own; their tops are the nodes of the
next tier, which is dealt and reduced likewise, until one node is left. On the
way down the nodes of a superblock are cogrouped with the one row that holds
what lies outside it: the proof of its top and the roots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewarden.llm.common import Stages, pick, ship_package, table

#: Binary logarithm of the leaves in a superblock.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree long, idx long, total long, digest string"
_OUTER = "tree long, block long, proof array<string>, subroot string, root string"


def node_digest(parts: list[str]) -> str:
    """Lowercase hex SHA-256 of hex digests, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: Mapping[str, Column]) -> Column:
    """The digest of a row: each value with its byte count before it, ``-`` for NULL."""
    texts = [value.cast("string") for value in fields.values()]
    coded = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def levels(digests: list[str], n: int) -> list[list[str]]:
    """The nodes of a subtree level by level, ``n`` levels above its leaves; a node without a partner is hashed alone."""
    out = [digests]
    for _ in range(n):
        below = out[-1]
        out.append([node_digest(below[k : k + 2]) for k in range(0, len(below), 2)])
    return out


def siblings(rising: list[list[str]], at: int) -> list[str]:
    """For each level the digest beside a leaf's ancestor, marked with its side; empty where there is none."""
    found = []
    for level in rising[:-1]:
        other = at ^ 1
        found.append(("L" if other < at else "R") + level[other] if other < len(level) else "")
        at >>= 1
    return found


def fold(digest: str, proof: list[str]) -> str:
    """The root that a leaf and its marked siblings lead to."""
    for beside in proof:
        if not beside:
            digest = node_digest([digest])
        elif beside[0] == "L":
            digest = node_digest([beside[1:], digest])
        else:
            digest = node_digest([digest, beside[1:]])
    return digest


def _height(total: int, bits: int) -> int:
    """Levels inside a superblock: fewer in a tree that is no larger than one."""
    return min(bits, (total - 1).bit_length())


def ranked(stages: Stages, rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``idx``, from 0 in the order within the group, and ``total``, the rows of the group. NULLs come first.

    Rows are range-partitioned once and written with the number of their range,
    so that counts and places come from the same ranges. The ranges split a
    group of any size; only one row per group and range is added up over it.
    """
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt, _ = stages.write(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*(group or [F.lit(0)]))
    before = over.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("total", F.sum("__n").over(over))
    own = Window.partitionBy(*group, "__range").orderBy(*by[len(group):])
    left, right = dealt.alias("l"), counts.alias("r")
    same = F.col("l.__range") == F.col("r.__range")
    for name in group:
        same = same & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    joined = left.join(right, same).select("l.*", "r.__before", "r.total")
    return joined.withColumn("idx", F.row_number().over(own) - 1 + F.col("__before")).drop("__range", "__before")


def _blocked(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("idx", bits))


def _tops(nodes: DataFrame, bits: int) -> DataFrame:
    """The next tier: one node for each superblock."""

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        total = int(group["total"].iloc[0])
        top = levels(list(group["digest"]), _height(total, bits))[-1]
        after = -(-total >> bits)
        return pd.DataFrame({"tree": group["tree"].iloc[:1], "idx": group["block"].iloc[:1], "total": after, "digest": top})

    return _blocked(nodes.select("tree", "idx", "total", "digest"), bits).groupBy("tree", "block").applyInPandas(reduce, _NODE)


def _tiers(stages: Stages, nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Tiers from the given one to that in which every tree is one node."""
    tiers = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 1
    while most > 1:
        tiers.append(stages.write(_tops(tiers[-1], bits))[0])
        most = -(-most >> bits)
    return tiers


def _proofs(nodes: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """``tree, block, proof, subroot, root`` for each node of a tier, which is a superblock of the tier below."""

    def join(group: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        group, above = group.sort_values("idx"), outside.iloc[0]
        rising = levels(list(group["digest"]), _height(int(group["total"].iloc[0]), bits))
        proof = [[*siblings(rising, k), *above["proof"]] for k in range(len(group))]
        return pd.DataFrame({"tree": group["tree"], "block": group["idx"], "proof": proof, "subroot": above["subroot"], "root": above["root"]})

    return _blocked(nodes, bits).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(join, _OUTER)


def _down(tiers: list[DataFrame], outer: DataFrame, bits: int) -> DataFrame:
    """Proofs of the superblocks of the lowest tier, from those of the trees."""
    for nodes in reversed(tiers[1:]):
        outer = _proofs(nodes, outer, bits)
    return outer


def manifest(
    docs: DataFrame, changed: Mapping[str, Column] | None = None, bits: int = BITS,
    fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang",
) -> DataFrame:
    """``key, group, idx, total, leaf, subroot, root, proof, folded_root, verified``: a row for every row of ``docs``.

    Leaves of a group ascend by key, NULL first; rows of one key by their
    digests, so that repeated keys and repeated rows have a place each and the
    same root on every run. Every two neighbours become their digest, one
    without a neighbour is hashed alone, until the subroot is left; subroots,
    ordered by group, NULL first, lead to the root in the same way. ``proof``
    has the siblings from the leaf upwards, ``L`` or ``R`` before each.

    ``changed`` gives columns as someone presents them now; what the presented
    row and the proof lead to is ``folded_root``, and ``verified`` tells whether
    it is the root. It reads the columns of ``docs`` by the names in ``fields``.

    NULL in any column is a value of its own, empty texts are not NULL, texts of
    any length become a digest where they are read. An empty table gives no
    rows. Extra columns are not read, whatever their names. No task holds more
    than a superblock; the roots of other superblocks come as one row.
    """
    spark = docs.sparkSession
    ship_package(spark)
    stages = Stages(spark, "manifest")
    rows = pick(docs, *dict.fromkeys([*fields, key, group]))
    own = {f: F.col(f) for f in fields}
    presented = leaf_digest({f: (changed or {}).get(f, c) for f, c in own.items()})
    rows = rows.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf_digest(own).alias("digest"), presented.alias("presented"))

    leaves = ranked(stages, rows, ["group"], ["key", "digest"])
    named = ranked(stages, leaves.select("group").distinct(), [], ["group"]).select("group", F.col("idx").alias("tree"), F.col("total").alias("trees"))
    named, _ = stages.write(named)
    left, right = leaves.alias("l"), named.alias("r")
    numbered = left.join(right, F.col("l.group").eqNullSafe(F.col("r.group"))).select("l.*", "r.tree")
    leaves, _ = stages.write(numbered)

    tiers = _tiers(stages, leaves, bits)
    subroots = tiers[-1].select("tree", "digest").distinct() if len(tiers) > 1 else leaves.select("tree", "digest")
    over = subroots.join(named, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("total"), "digest")
    tops = _tiers(stages, stages.write(over)[0], bits)
    root = tops[-1].select("tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    # proofs of subroots: the nodes of the lowest tier over trees
    by_tree = _proofs(tops[0], _down(tops, root, bits), bits)
    by_tree = by_tree.select(F.col("block").alias("tree"), "proof", "root").join(subroots, "tree")
    outer = by_tree.select("tree", F.lit(0).cast("long").alias("block"), "proof", F.col("digest").alias("subroot"), "root")
    outer, _ = stages.write(_down(tiers, outer, bits))

    kind = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    schema = (
        f"key {kind['key']}, `group` {kind['group']}, idx long, total long, leaf string, subroot string, root string, "
        "proof array<string>, folded_root string"
    )

    def finish(block: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        block, above = block.sort_values("idx"), outside.iloc[0]
        rising = levels(list(block["digest"]), _height(int(block["total"].iloc[0]), bits))
        proofs = [[*siblings(rising, k), *above["proof"]] for k in range(len(block))]
        out = block[["key", "group", "idx", "total"]].assign(leaf=block["digest"], subroot=above["subroot"], root=above["root"])
        out["proof"] = proofs
        out["folded_root"] = [fold(p, proof) for p, proof in zip(block["presented"], proofs, strict=True)]
        return out

    found = _blocked(leaves, bits).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, schema)
    found = found.withColumn("verified", F.col("folded_root") == F.col("root"))
    return found.withColumnsRenamed({"key": key, "group": group})


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's digests, without the marks of their sides."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.substring(p, 2, 64)), "").cast("binary"), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(tampered, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))
    found = manifest(docs, {"n_chars": n_chars})
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")
