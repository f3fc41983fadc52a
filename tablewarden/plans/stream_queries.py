"""Streaming forms, run to the end over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.plans.fold_queries import CREDITS_SQL, VIEWS_SQL
from tablewarden.plans.registry import hits_sql, query, tables
from tablewarden.runtime import cut_lineage, scratch_path
from tablewarden.streaming.search import latest_change, standing_search, windowed_hits
from tablewarden.streaming.state import CreditLedger, KeptAggregate, TtlTable, UpsertTable, ViewCounters

#: Micro-batches a table arrives in, and rows of one file.
BATCHES = 4
ROWS_PER_FILE = 1_000_000


def _stream(spark: SparkSession, sf_dir: str, table: str, *order: str) -> DataFrame:
    """A table as a stream of four micro-batches in the order of some columns, each of several files."""
    rows, path = tables(spark, sf_dir, table)[table], scratch_path(spark, f"arriving-{table}")
    files = max(2, -(-rows.count() // (BATCHES * ROWS_PER_FILE)))
    # as many ranges as files: no task takes a whole micro-batch
    ranges = rows.repartitionByRange(BATCHES * files, *order)
    parts = cut_lineage(ranges.withColumn("__part", F.floor(F.spark_partition_id() / files).cast("int")))
    for n in range(BATCHES):  # one after the other: a stream takes the oldest files first
        parts.where(F.col("__part") == n).drop("__part").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _run(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Write a stream to files until its source is exhausted, and read them."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_search", hits_sql("events", {
    "event_id": "event_id = 69", "ts": "contains(CAST(ts AS VARCHAR), '69')", "user_id": "user_id = 69",
    "event_type": "contains(event_type, '69')", "value": "value = 69", "props": "contains(props, '69')",
}))
def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standing search: hits are written as rows arrive."""
    stream = _stream(spark, sf_dir, "events", "ts", "event_id")
    hits = standing_search(stream, "events", "69", key=("event_id",), json_columns={"props"})
    out = _run(hits, scratch_path(spark, "stream-hits"))
    return out.select("table_name", "row_key", F.array_join("matching_columns", ";").alias("matching_columns"))


@query("stream_fold_credits", CREDITS_SQL)
def stream_fold_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, here = _stream(spark, sf_dir, "events", "ts", "event_id"), scratch_path(spark, "ledger")
    ledger = CreditLedger(
        spark, here, stream.schema, key="user_id", order=["ts", "event_id"], status="event_type",
        amount="value", user="user_id", done="purchase",
    )
    ledger.start(stream).awaitTermination()
    return ledger.balances().select("user_id", F.round("credits", 2).alias("credits"))


@query("stream_fold_credits_decimal", """
    WITH c AS (SELECT user_id, event_type, CAST(round(value, 2) AS DECIMAL(10, 2)) AS amount,
        lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, CAST(sum(amount) AS VARCHAR) AS credits FROM c
    WHERE event_type = 'purchase' AND (before IS NULL OR before <> 'purchase') GROUP BY user_id
""")
def stream_fold_credits_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money as decimals stays exact."""
    arriving = _stream(spark, sf_dir, "events", "ts", "event_id")
    stream = arriving.withColumn("amount", F.round("value", 2).cast("decimal(10,2)"))
    here = scratch_path(spark, "ledger")
    ledger = CreditLedger(
        spark, here, stream.schema, key="user_id", order=["ts", "event_id"], status="event_type",
        amount="amount", user="user_id", done="purchase",
    )
    ledger.start(stream).awaitTermination()
    return ledger.balances().select("user_id", F.col("credits").cast("string").alias("credits"))


@query("stream_fold_views", VIEWS_SQL)
def stream_fold_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View counters that go on from batch to batch."""
    value = F.when(~F.col("event_type").isin("view", "click"), F.floor("value").cast("bigint") % 4)
    stream = _stream(spark, sf_dir, "events", "ts", "event_id").withColumn("views", value)
    here = scratch_path(spark, "views")
    counters = ViewCounters(spark, here, stream.schema, key="user_id", order=["ts", "event_id"], value="views", start=2)
    counters.start(stream).awaitTermination()
    return counters.counts()


@query("stream_upsert", """
    WITH n AS (SELECT user_id % 100 AS s_suppkey, arg_max(value, (ts, event_id)) AS s_acctbal FROM events GROUP BY ALL)
    SELECT coalesce(n.s_suppkey, s.s_suppkey) AS s_suppkey, s.s_name, CASE WHEN n.s_suppkey IS NOT NULL THEN n.s_acctbal ELSE s.s_acctbal END AS s_acctbal
    FROM supplier s FULL JOIN n ON n.s_suppkey = s.s_suppkey
""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of suppliers as the last event of each leaves them."""
    here = scratch_path(spark, "upserts")
    changes = _stream(spark, sf_dir, "events", "event_id").select(
        (F.col("user_id") % 100).alias("s_suppkey"), F.col("value").alias("s_acctbal"), F.struct("ts", "event_id").alias("at")
    )
    target = UpsertTable(tables(spark, sf_dir, "supplier")["supplier"], here, changes.schema, ("s_suppkey",), "at")
    target.start(changes).awaitTermination()
    return target.read().select("s_suppkey", "s_name", "s_acctbal")


@query("stream_updated_at", "SELECT user_id, max(ts) AS updated_at, count(*) AS changes FROM events GROUP BY ALL")
def stream_updated_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch replaces the state of the users it touched."""
    counted = latest_change(_stream(spark, sf_dir, "events", "event_id"), "user_id", "ts")
    newest = KeptAggregate(counted, scratch_path(spark, "updated"), 1)
    newest.start().awaitTermination()
    return newest.read()


@query("stream_unexpired", """
    WITH u AS (SELECT user_id, max(date_trunc('milliseconds', ts)) AS seen, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id)
    SELECT user_id, event_id FROM u WHERE seen + INTERVAL 6 HOURS > (SELECT max(seen) FROM u)
""")
def stream_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their last event, as long as it is younger than six hours in the time of the events."""
    stream = _stream(spark, sf_dir, "events", "ts", "event_id").select("user_id", "event_id", "ts")
    seen = TtlTable(spark, scratch_path(spark, "seen"), stream.schema, key="user_id", at="ts", keep="6 hours")
    seen.start(stream).awaitTermination()
    return seen.live().select("user_id", "event_id")


@query("stream_windowed_hits", """
    SELECT date_trunc('day', ts)::TIMESTAMP AS day, 'event_type' AS column_name, count(*) AS hits
    FROM events WHERE event_type = 'purchase' GROUP BY 1, 2
""")
def stream_windowed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per day: closed days from the sink, those still open at the end from the state."""
    stream = _stream(spark, sf_dir, "events", "ts")
    counted = windowed_hits(stream, "events", "purchase", "ts", "1 day", "1 hour")
    here = scratch_path(spark, "windowed")
    windows = KeptAggregate(counted, f"{here}/checkpoint", 2)
    windows.start("append", "parquet", path=f"{here}/closed").awaitTermination()
    closed = spark.read.schema(counted.schema).parquet(f"{here}/closed")
    rows = closed.unionByName(windows.read()).select(F.col("window.start").alias("day"), "column_name", "hits")
    wall_clock = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("day").cast("timestamp_ntz"))
    return rows.withColumn("day", wall_clock)
