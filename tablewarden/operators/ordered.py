"""Cutting long histories into segments.

A window over one key puts all rows of that key into one task. Here a history
is first cut by its order column into segments that hold about equally many
rows of the whole table, so that ``(key, segment)`` is never more than a normal
partition even when one key has a third of all rows. What crosses a border is
then settled on one summary row per key and segment.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

SEGMENT = "__segment"


def as_position(order: Column, dtype: T.DataType) -> Column:
    """The order as a double that never decreases along it."""
    if isinstance(dtype, T.NumericType):
        return order.cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(order).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(order).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        # wall-clock arithmetic: a cast would go through the session time zone
        day = F.unix_date(order.cast("date")).cast("double")
        seconds = F.extract(F.lit("SECOND"), order).cast("double")  # with its fraction
        return day * 86400 + F.hour(order) * 3600 + F.minute(order) * 60 + seconds
    raise TypeError(f"cannot cut a history by {dtype.simpleString()}")


def _borders(df: DataFrame, position: Column, wanted: int, *by: Column) -> DataFrame:
    shares = [i / wanted for i in range(1, wanted)]
    found = F.percentile_approx(position, shares, max(10_000, wanted * 20)).alias("borders")
    return df.groupBy(*by).agg(found) if by else df.agg(found)


def with_segments(df: DataFrame, order: str | list[str], segments: int | None = None) -> DataFrame:
    """Add the segment number of each row.

    Borders are approximate quantiles of the first order column, one pass over
    that column; as many numbers as there are shuffle partitions come back. A
    value that so many rows share that several borders fall on it is cut by the
    second order column, where that is a number or a time: its rows get segments
    of their own in that order, and larger values follow them. Any borders give
    the same results, only the balance depends on them. Rows that are equal in
    both columns stay together.
    """
    order = [order] if isinstance(order, str) else list(order)
    wanted = segments or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    position = as_position(F.col(f"`{order[0]}`"), df.schema[order[0]].dataType)
    if wanted == 1:
        return df.withColumn(SEGMENT, F.lit(0))
    found = _borders(df, position, wanted).first()[0] or []
    borders = sorted(set(found))
    if not borders:
        return df.withColumn(SEGMENT, F.lit(0))
    placed = df.withColumn("__position", F.coalesce(position, F.lit(float("-inf"))))
    cut = Bucketizer(
        splits=[float("-inf"), *borders, float("inf")], inputCol="__position", outputCol=SEGMENT
    )
    out = cut.transform(placed).withColumn(SEGMENT, F.col(SEGMENT).cast("int"))
    shared = [b for b in borders if found.count(b) > 1]
    following = _tie_position(df, order)
    if shared and following is not None:
        out = _cut_ties(out, shared, F.coalesce(following, F.lit(float("-inf"))), wanted)
    return out.drop("__position")


def _tie_position(df: DataFrame, order: list[str]) -> Column | None:
    """The second order column as a position, if it has one."""
    if len(order) < 2:
        return None
    try:
        return as_position(F.col(f"`{order[1]}`"), df.schema[order[1]].dataType)
    except TypeError:
        return None


def _cut_ties(df: DataFrame, shared: list[float], position: Column, wanted: int) -> DataFrame:
    """Segments within the rows of each shared value, of which there are fewer than segments."""
    tied = df.where(F.col("__position").isin(shared)).withColumn("__next", position)
    cuts = {r["__position"]: sorted(set(r["borders"])) for r in _borders(tied, F.col("__next"), wanted, F.col("__position")).collect()}
    known = F.create_map(*[x for v, bs in cuts.items() for x in (F.lit(v), F.array(*[F.lit(b) for b in bs]))])
    own = F.try_element_at(known, F.col("__position"))
    # a larger value in the segment of a shared one comes after all parts of that
    part = F.when(own.isNotNull(), F.size(F.filter(own, lambda b: b <= position))).otherwise(wanted)
    return df.withColumn(SEGMENT, (F.col(SEGMENT) * (wanted + 1) + part).cast("int"))
