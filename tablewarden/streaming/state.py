"""Keyed state that micro-batches keep up, in Spark's own state store.

State lives in RocksDB below the checkpoint of a query: a batch reads and writes
the keys it brings, in as many partitions as the query began with, and a query
started again with its checkpoint goes on where it was. What is there is read
through Spark's state reader, so it costs what the state holds, not its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tablewarden.functions.digests import row_digest, whole_row
from tablewarden.operators.change import upsert
from tablewarden.operators.folds import fold_credits

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(stream: DataFrame, checkpoint: str, mode: str, sink: str = "noop", **options: str) -> StreamingQuery:
    """Run over what the source has by now, with state in RocksDB."""
    stream.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    writer = stream.writeStream.format(sink).outputMode(mode).options(**options)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_rows(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    """``key`` and ``value`` structs of a query's state after its last batch; ``variable`` names one of a processor.

    Of a map they are those of its entries.
    """
    spark.conf.set(_PROVIDER, _ROCKSDB)
    reader = spark.read.format("statestore").option("path", checkpoint)
    rows = (reader.option("stateVarName", variable) if variable else reader).load()
    if "user_map_key" not in rows.columns:
        return rows
    return rows.select(F.col("user_map_key").alias("key"), F.col("user_map_value").alias("value"))


#: Groups that keys are dealt into, and rows of a batch that are one row of lists.
GROUPS, LIST_ROWS = 1024, 10_000


def _in_lists(order: int, changing: str | None, list_rows: int):
    """Of a group's rows ``g, k, o0 ..`` and more the rows ``g, block, new`` and lists of ``k`` and the others, sorted."""

    # all that it needs is local, so it travels to executors by value
    def codes(column: pa.ChunkedArray) -> np.ndarray:
        """Numbers in the order of the values, equal ones for equal values; NULL first and NaN last, as Spark orders."""
        held = column.is_valid().to_numpy()
        if pa.types.is_floating(column.type):
            number = np.unique(column.fill_null(0).to_numpy(), return_inverse=True)[1]
        elif pa.types.is_nested(column.type):
            values = column.to_pylist()
            at = sorted(np.flatnonzero(held), key=lambda i: values[i])
            number = np.zeros(len(values), np.int64)
            number[at] = np.cumsum([values[b] != values[a] for a, b in zip([*at[:1], *at], at, strict=False)])
        else:
            coded = column.combine_chunks().dictionary_encode()
            by_value = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.zeros(len(by_value) + 1, np.int64)
            rank[by_value] = np.arange(len(by_value))
            number = rank[coded.indices.fill_null(len(by_value)).to_numpy()]
        return np.where(held, number + 1, 0)

    def of(rows: pa.Table) -> pa.Table:
        orders = [f"o{i}" for i in range(order)]
        k, *by = [codes(rows.column(c)) for c in ["k", *orders]]
        at = np.lexsort([*by[::-1], k])
        new = np.append(True, k[at][1:] != k[at][:-1])
        if changing:
            value = rows.column(changing).to_numpy()[at]
            kept = new | np.append(True, value[1:] != value[:-1])
            at, new = at[kept], new[kept]
        lists = rows.drop_columns(["g", *orders]).take(at).append_column("new", pa.array(new))
        starts = np.arange(0, len(at), list_rows)
        cuts = pa.array(np.append(starts, len(at)).astype(np.int32))
        return pa.table({
            "g": rows.column("g").slice(0, 1).take([0] * len(starts)), "block": pa.array(np.arange(len(starts))),
            **{c: pa.ListArray.from_arrays(cuts, lists.column(c).combine_chunks()) for c in lists.column_names},
        })

    return of


def _ordered(stream: DataFrame, key: str, order: list[str], *more: Column, changing: str | None = None) -> DataFrame:
    """``g, block`` and lists of ``k``, some columns and ``new``, which says where a key begins.

    Keys are dealt into :data:`GROUPS` groups. What a batch brings of a group is
    sorted by key and the order columns, and is one row for each
    :data:`LIST_ROWS` rows: a call of the processor, and each row it is given,
    take Spark far longer than the processor itself. Of the boolean column
    ``changing`` only the rows that change it within their key are kept, and the
    first of each key.
    """
    k = F.col(f"`{key}`")
    dtype = stream.schema[key].dataType
    # an entry of a map is found by the bits of its key, and 0 has two signs
    k = k + F.lit(0).cast(dtype) if isinstance(dtype, (T.FloatType, T.DoubleType)) else k
    rows = stream.select(k.alias("k"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], *more)
    lists = [rows.schema["k"], *rows.schema.fields[1 + len(order) :], T.StructField("new", T.BooleanType())]
    schema = T.StructType([
        T.StructField("g", T.LongType()), T.StructField("block", T.LongType()),
        *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in lists],
    ])
    groups = rows.withColumn("g", F.pmod(F.xxhash64("k"), F.lit(GROUPS))).groupBy("g")
    return groups.applyInArrow(_in_lists(len(order), changing, LIST_ROWS), schema)


def _key(dtype: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("k", dtype)])


def _credit_processor(key: T.StructType) -> StatefulProcessor:
    # a local class travels to executors by value
    class Credits(StatefulProcessor):
        def init(self, handle) -> None:
            self.done = handle.getMapState("done", key, "done boolean")

        def handleInputRows(self, group, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            last = None
            for lists in sorted(rows, key=lambda row: row["block"]):
                for new, k, done, who, gain in zip(*[lists[c] for c in ("new", "k", "done", "who", "gain")], strict=True):
                    if new:
                        if last:
                            self.done.updateValue(*last)
                        # what was does not matter to a change into anything else
                        known = self.done.getValue((k,)) if done else None
                        was = bool(known and known[0])
                    if done and not was:
                        yield Row(who=who, gain=gain)
                    was = done
                    last = (k,), (done,)
            if last:
                self.done.updateValue(*last)

        def close(self) -> None:
            pass

    return Credits()


class CreditLedger:
    """Credits per user, kept up by a stream of status changes.

    Changes of a key count in the order in which batches bring them, and inside
    a batch in the order of the order columns. Amounts may be whole numbers,
    decimals or floating; credits have the type their sum has in a batch fold.

    The state is one flag per key, whether it was ``done`` last. What a batch
    earns is one row per user in ``<path>/gains/batch=<n>``, which a batch that
    runs again replaces. The rows that one batch brings of one group of keys are
    sorted in one task, so the trigger's limits bound what a hot key needs.
    """

    def __init__(
        self, spark: SparkSession, path: str, changes: T.StructType, *, key: str, order: list[str],
        status: str, amount: str, user: str, done: str = "completed",
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.order, self.status, self.amount, self.user, self.done = key, order, status, amount, user, done
        empty = spark.createDataFrame([], changes)
        folded = fold_credits(empty, key, order, status, amount, user, done=done, segments=1)
        self.schema = folded.schema
        self.types = changes[user].dataType, changes[amount].dataType

    def gains(self, stream: DataFrame) -> DataFrame:
        """``who, gain`` for each change into ``done``, as a stream."""
        done = F.coalesce(F.col(f"`{self.status}`") == self.done, F.lit(False)).alias("done")
        amount = F.coalesce(F.col(f"`{self.amount}`"), F.lit(0).cast(self.types[1])).alias("gain")
        rows = _ordered(stream, self.key, self.order, done, F.col(f"`{self.user}`").alias("who"), amount, changing="done")
        out = T.StructType([T.StructField("who", self.types[0]), T.StructField("gain", self.types[1])])
        return rows.groupBy("g").transformWithState(_credit_processor(_key(stream.schema[self.key].dataType)), out, "Append", "None")

    def start(self, stream: DataFrame) -> StreamingQuery:
        def write(batch: DataFrame, number: int) -> None:
            sums = batch.groupBy(F.col("who").alias(self.user)).agg(F.sum("gain").alias("credits"))
            sums.write.mode("overwrite").parquet(f"{self.path}/gains/batch={number}")

        self.spark.conf.set(_PROVIDER, _ROCKSDB)
        writer = self.gains(stream).writeStream.outputMode("append").foreachBatch(write)
        return writer.option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def balances(self) -> DataFrame:
        """Credits of every user that has earned any, a sum of 0 included."""
        gains = self.spark.read.parquet(f"{self.path}/gains").drop("batch")
        total = gains.groupBy(f"`{self.user}`").agg(F.sum("credits").alias("credits"))
        return total.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields])


def _view_processor(key: T.StructType, start: int) -> StatefulProcessor:
    class Views(StatefulProcessor):
        def init(self, handle) -> None:
            self.count = handle.getMapState("view_count", key, "view_count long")

        def handleInputRows(self, group, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            last = None
            for lists in sorted(rows, key=lambda row: row["block"]):
                for new, k, v in zip(lists["new"], lists["k"], lists["v"], strict=True):
                    if new:
                        if last:
                            yield self.kept(*last)
                        known = self.count.getValue((k,))
                        count = known[0] if known else start
                    count = count + 1 if v is None or v == count else v
                    last = k, count
            if last:
                yield self.kept(*last)

        def kept(self, k, count: int) -> Row:
            self.count.updateValue((k,), (count,))
            return Row(k=k, view_count=count)

        def close(self) -> None:
            pass

    return Views()


class ViewCounters:
    """View counters kept up by a stream of updates: what a batch fold over all of them gives.

    Updates of a key count in the order in which batches bring them, and inside
    a batch in that of the order columns. The state is one number per key.
    """

    def __init__(self, spark: SparkSession, path: str, changes: T.StructType, *, key: str, order: list[str], value: str, start: int = 0):
        self.spark, self.checkpoint = spark, f"{path.rstrip('/')}/checkpoint"
        self.key, self.order, self.value, self.begin, self.type = key, order, value, start, changes[key].dataType

    def updates(self, stream: DataFrame) -> DataFrame:
        """``k, view_count``: after each batch the counters of the keys it brought, as a stream."""
        rows = _ordered(stream, self.key, self.order, F.col(f"`{self.value}`").cast("long").alias("v"))
        out = T.StructType([T.StructField("k", self.type), T.StructField("view_count", T.LongType())])
        return rows.groupBy("g").transformWithState(_view_processor(_key(self.type), self.begin), out, "Update", "None")

    def start(self, stream: DataFrame) -> StreamingQuery:
        return _start(self.updates(stream), self.checkpoint, "update")

    def counts(self) -> DataFrame:
        rows = state_rows(self.spark, self.checkpoint, "view_count")
        return rows.select(F.col("key.k").alias(self.key), "value.view_count")


class KeptAggregate:
    """The groups of a streaming aggregate, read from the state it is kept in.

    For aggregates with one value each, such as max, min and count. Without a
    watermark every group stays; with one, those still open.
    """

    def __init__(self, aggregated: DataFrame, checkpoint: str, groups: int):
        """``aggregated`` has the grouping columns first, ``groups`` of them."""
        self.stream, self.checkpoint, self.groups = aggregated, checkpoint, groups

    def start(self, mode: str = "update", sink: str = "noop", **options: str) -> StreamingQuery:
        return _start(self.stream, self.checkpoint, mode, sink, **options)

    def read(self) -> DataFrame:
        fields = self.stream.schema.fields
        rows = state_rows(self.stream.sparkSession, self.checkpoint)
        keys, values = rows.schema["key"].dataType.names, rows.schema["value"].dataType.names
        if len(values) != len(fields) - self.groups:
            raise ValueError("an aggregate that keeps several values cannot be read from the state")
        columns = [F.col("key").getField(k) for k in keys] + [F.col("value").getField(v) for v in values]
        return rows.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(columns, fields, strict=True)])


class UpsertTable:
    """A base table and the newest row per key of a change stream over it.

    Of rows with one order value the greatest in all columns counts, whatever
    batches they come in.
    """

    def __init__(self, base: DataFrame, path: str, changes: T.StructType, key: tuple[str, ...], order: str):
        self.base, self.key, self.order, self.schema = base, key, order, changes
        self.checkpoint = f"{path.rstrip('/')}/checkpoint"

    def _newest(self, stream: DataFrame) -> KeptAggregate:
        row = F.struct(F.col(f"`{self.order}`").alias("at"), whole_row(self.schema.fields).alias("tie"), F.struct("*").alias("row"))
        keys = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(self.key)]
        return KeptAggregate(stream.groupBy(*keys).agg(F.max(row).alias("newest")), self.checkpoint, len(keys))

    def start(self, stream: DataFrame) -> StreamingQuery:
        self.newest = self._newest(stream)
        return self.newest.start()

    def read(self) -> DataFrame:
        """The base with the changes merged in; late changes lose to newer ones."""
        return upsert(self.base, self.newest.read().select("newest.row.*"), self.key)


def _ttl_processor(row_schema: T.StructType) -> StatefulProcessor:
    names = row_schema.names
    kept = T.StructType([T.StructField("micros", T.LongType()), T.StructField("tie", T.LongType()), *row_schema.fields])

    class Ttl(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.newest = handle.getValueState("newest", kept)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            known = self.newest.get()
            best = max(rows, key=lambda r: (r["__micros"], r["__tie"]))
            if not known or (best["__micros"], best["__tie"]) > (known[0], known[1]):
                self.newest.update((best["__micros"], best["__tie"], *[best[n] for n in names]))
                self.handle.registerTimer(best["__micros"] // 1000)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            known = self.newest.get()
            # a row that came later has a timer of its own
            if known and known[0] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                self.newest.clear()
                yield Row(**dict(zip(names, known[2:], strict=True)))

        def close(self) -> None:
            pass

    return Ttl()


class TtlTable:
    """The newest row per key of a stream, for as long as it is younger than ``keep``.

    Age is measured in event time, against the newest time that any batch has
    brought: the watermark stays ``keep`` behind that, and when it passes the
    time of a row, a timer takes the row out of the state and reports it. So the
    same stream gives the same result on any day. Rows that are past their end
    when they arrive are not taken, nor are those without a time. Ends are cut to
    milliseconds; of rows of one time the one with the greater digest counts.
    """

    def __init__(self, spark: SparkSession, path: str, rows: T.StructType, *, key: str, at: str, keep: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), rows
        self.key, self.at, self.keep = key, at, keep

    def expiring(self, stream: DataFrame) -> DataFrame:
        """The rows that leave, as a stream."""
        instant = F.col(f"`{self.at}`").cast("timestamp")
        if isinstance(self.schema[self.at].dataType, T.TimestampNTZType):  # a wall-clock time counts as UTC
            instant = F.concat(F.col(f"`{self.at}`").cast("string"), F.lit("+00:00")).cast("timestamp")
        rows = stream.select(
            *[F.col(f"`{n}`") for n in self.schema.names], F.col(f"`{self.key}`").alias("__key"), instant.alias("__instant"),
            row_digest(self.schema.fields).alias("__tie"),
        )
        timed = rows.where("__instant IS NOT NULL").withWatermark("__instant", self.keep)
        timed = timed.withColumn("__micros", F.unix_micros("__instant"))
        return timed.groupBy("__key").transformWithState(_ttl_processor(self.schema), self.schema, "Append", "EventTime")

    def start(self, stream: DataFrame) -> StreamingQuery:
        return _start(self.expiring(stream), f"{self.path}/checkpoint", "append", "parquet", path=f"{self.path}/expired")

    def live(self) -> DataFrame:
        """The rows that are still young."""
        rows = state_rows(self.spark, f"{self.path}/checkpoint", "newest")
        return rows.select(*[F.col("value").getField(n).alias(n) for n in self.schema.names])

    def expired(self) -> DataFrame:
        """The rows that have left."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/expired")
