"""Standing search: hits as rows arrive, and hit counts per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tablewarden.operators.search import SearchValue, column_predicates, hits_of, search
from tablewarden.sources.tables import TableSet


def standing_search(
    stream: DataFrame, name: str, value: str, key: tuple[str, ...] = (),
    json_columns: set[str] = frozenset(), **how: bool,
) -> DataFrame:
    """Hits of a value in a stream; a stateless projection of each row."""
    ts = TableSet.of(stream.sparkSession, {name: stream}, keys={name: key}, json_columns={name: set(json_columns)})
    return search(ts, value, limit=None, **how)


def windowed_hits(
    stream: DataFrame, name: str, value: str, at: str, window: str, late: str, **how: bool
) -> DataFrame:
    """Hits per time window and column; windows start on the clock of UTC.

    A wall-clock time is taken as it is, whatever time zone the session has.
    Rows later than ``late`` are dropped, as watermarks work. In append mode a
    window comes once it is closed, and the open ones can be read from the state
    (:class:`tablewarden.streaming.state.KeptAggregate`); in update mode a window
    comes whenever it has changed.
    """
    instant = F.col(at).cast("timestamp")
    if isinstance(stream.schema[at].dataType, T.TimestampNTZType):
        instant = F.concat(F.col(at).cast("string"), F.lit("+00:00")).cast("timestamp")
    timed = stream.withColumn(at, instant).withWatermark(at, late)
    ts = TableSet.of(stream.sparkSession, {name: timed}, keys={name: ()})
    predicates = column_predicates(ts, name, SearchValue(value, **how))
    found = hits_of(timed, predicates).select(at, F.explode("matching_columns").alias("column_name"))
    return found.groupBy(F.window(at, window), "column_name").agg(F.count(F.lit(1)).alias("hits"))


def latest_change(stream: DataFrame, key: str, at: str) -> DataFrame:
    """Number and time of the last change per key, for update mode."""
    return stream.groupBy(key).agg(F.max(at).alias("updated_at"), F.count(F.lit(1)).alias("changes"))
