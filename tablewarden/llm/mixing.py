"""Mixing sources to target weights along a curriculum that changes over training time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewarden.functions.digests import row_digest
from tablewarden.llm.common import WORD, Placed, Stages, pick, running_sum, table
from tablewarden.runtime import cut_lineage


@dataclass(frozen=True)
class Curriculum:
    """Weights of sources and how they move over training time 0 to 1.

    Sources in code point order, NULL last, take ``weights`` in turn. The
    weight of a source at a time is its weight times its shape, which is linear
    between knots at equal distances; ``shapes`` are taken in turn as well. Only
    the form of a shape counts: over the whole time the weight is as given.
    """

    weights: Sequence[float] = (5.0, 2.0, 1.0)
    shapes: Sequence[Sequence[float]] = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
    max_repeats: float = 3.0

    def __post_init__(self):
        if not self.weights or min(self.weights) <= 0 or self.max_repeats < 1:
            raise ValueError("weights are positive, and a mix of the whole size needs max_repeats of 1 or more")
        if len({len(s) for s in self.shapes}) != 1 or any(len(s) < 2 or min(s) < 0 or sum(s) == 0 for s in self.shapes):
            raise ValueError("shapes have equally many knots, 2 at least, that are not negative and not all 0")


def source_targets(sizes: DataFrame, curriculum: Curriculum) -> DataFrame:
    """``source, source_size, rank, target`` from one row per source.

    The targets share the sum of all sizes by weight. One that passes
    ``max_repeats`` times its source's size stops there, and the excess is
    shared again by weight. Sources stop in order of size over weight, so how
    many do, and the level the others reach, follow from running sums over the
    sources; these are the only rows that meet in one task.
    """
    weights = F.array(*[F.lit(float(w)) for w in curriculum.weights])
    code_points = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(code_points) - 1)
    ranked = ranked.withColumn("weight", F.get(weights, F.col("rank") % len(curriculum.weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(curriculum.max_repeats)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    # the level if all sources before this one have stopped
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level)
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    levels = levels.withColumn("level", F.max(open_).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", "rank", target.alias("target"))


def _when(curriculum: Curriculum, rank: Column, share: Column) -> Column:
    """The training time at which a share of a source's demand has been met: the inverse of its integrated weight."""
    knots = len(curriculum.shapes[0]) - 1
    out = F.lit(None).cast("double")
    for turn, shape in enumerate(curriculum.shapes):
        areas = [(a + b) / 2 / knots for a, b in zip(shape, shape[1:], strict=False)]
        whole = sum(areas)
        demand = share * F.lit(whole)
        at, time = sum(areas), F.lit(1.0)
        for k in reversed(range(knots)):
            at -= areas[k]
            a, b = shape[k], shape[k + 1]
            # the area within the segment grows as a*x + (b-a)*knots*x*x/2
            more, slope = F.greatest(F.lit(0.0), demand - F.lit(at)), (b - a) * knots
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + F.lit(2 * slope) * more))
            x = F.coalesce(F.try_divide(F.lit(2.0) * more, F.lit(float(a)) + root), F.lit(0.0))
            inside = F.least(F.lit(1.0 / knots), x) + F.lit(k / knots)
            time = inside if k == knots - 1 else F.when(demand < F.lit(at + areas[k]), inside).otherwise(time)
        out = F.when(rank % len(curriculum.shapes) == turn, F.least(F.lit(1.0), time)).otherwise(out)
    return out


def mix(docs: DataFrame, size: str, curriculum: Curriculum = Curriculum(), source: str = "source") -> DataFrame:
    """All rows and columns with ``source_size, target, taken, copies``.

    ``size`` names a column of whole numbers, NULL counting 0. A source's
    documents follow one another in an order that only depends on the rows, and
    again from the first when all have been taken, until the source's target is
    met; the last one may be taken in part. ``copies`` holds an entry per copy:
    its ``position``, the training time from 0 to 1 at which the source's demand
    reaches it, and its ``size``. ``taken`` is the sum of these sizes, at most
    ``max_repeats`` times the document's.

    Sums over a source are made cell by cell, so a source may hold any share of
    the rows. Documents without size, and sources without any, are not taken.
    Equal rows are documents of their own. An empty table stays empty. An added
    column whose name is taken gets a leading underscore.
    """
    placed = Placed(docs)
    digest = row_digest(list(placed.df.schema.fields))
    rows = placed.df.withColumn("__size", F.coalesce(placed.col(size).cast("long"), F.lit(0).cast("long")))
    rows = rows.withColumn("__source", placed.col(source)).withColumn("__spread", F.xxhash64(F.lit("mix"), digest))
    stages = Stages(docs.sparkSession, "sources")
    sizes, _ = stages.write(rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size")))
    targets, _ = stages.write(source_targets(sizes, curriculum))
    rows = running_sum(rows, ["__source"], "__spread", ["__size"], F.col("__size"), "__start")
    t = targets.select(
        F.col("source").alias("__name"), "source_size", "rank", "target", F.round("target").cast("long").alias("__quota")
    )
    rows = rows.join(t, F.col("__source").eqNullSafe(F.col("__name")))
    whole = F.when(F.col("source_size") > 0, F.expr("__quota div source_size")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("__whole", whole)
    last = F.col("__quota") - F.col("__whole") * F.col("source_size") - F.col("__start")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("__size"), last))
    rows = rows.withColumn("__last", last).withColumn("taken", F.col("__size") * F.col("__whole") + F.col("__last"))

    def copy(n: Column, words: Column) -> Column:
        share = (n * F.col("source_size") + F.col("__start")) / F.greatest(F.col("__quota"), F.lit(1))
        return F.struct(_when(curriculum, F.col("rank"), share).alias("position"), words.alias("size"))

    n = F.col("__whole") + F.when(F.col("__last") > 0, 1).otherwise(0)
    numbers = F.filter(F.sequence(F.lit(0).cast("long"), n), lambda i: i < n)
    copies = F.transform(numbers, lambda i: copy(i, F.when(i < F.col("__whole"), F.col("__size")).otherwise(F.col("__last"))))
    rows = rows.withColumn("copies", F.when(F.col("__size") > 0, copies).otherwise(F.array().cast("array<struct<position:double,size:bigint>>")))
    return placed.restore(rows, F.col("source_size"), F.col("target"), F.col("taken"), F.col("copies"))


def training_order(docs: DataFrame, size: str, curriculum: Curriculum = Curriculum(), source: str = "source") -> DataFrame:
    """One row per copy, range-sorted by training position, with the document's columns and ``position``, ``words``.

    Whole documents are trained on: a copy that is taken in part stays if half
    of it or more is. See :func:`mix` for the rest.
    """
    placed = Placed(docs)
    mixed = mix(placed.df, placed.place(size), curriculum, placed.place(source))
    parts = mixed.withColumn("__copy", F.explode("copies"))
    half = F.col("__copy.size") * 2 >= F.col(placed.place(size))
    rows = parts.where(half).withColumn("position", F.col("__copy.position")).withColumn("words", F.col("__copy.size"))
    return placed.restore(rows, F.col("position"), F.col("words")).orderBy("position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # texts are read once: what follows needs sizes only
    sizes = cut_lineage(docs.select("doc_id", "source", words.alias("size")))
    mixed = mix(sizes, "size")
    first = F.get("copies", F.lit(0))["position"]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy(
        F.col("position").asc_nulls_last(), "doc_id"
    )
