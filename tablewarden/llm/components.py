"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewarden.llm.common import Stages


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one upper end at most and no centre hangs below another."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    bad = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bad.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; the root is the smallest node reachable.

    Alternating stars: each round hangs all larger neighbours of a node below
    its smallest one, then does the same with the smaller neighbours, until
    only stars are left, after about log(n) rounds. A round is grouping and
    joins, and its links are written to the shared folder. Links of a node with
    itself, repeated ones and those with a NULL end are ignored.
    """
    stages = Stages(edges.sparkSession, "links")
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = stages.write(links)
    while not _are_stars(now):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, new = stages.write(small.unionAll(below.select("a", F.col("m").alias("b"))).distinct())
        stages.drop(path)
        now, path = after, new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
