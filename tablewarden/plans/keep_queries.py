"""Snapshots, expiry, comparison and rehearsal over the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.operators import change as C
from tablewarden.operators import compare as X
from tablewarden.operators import snapshot as K
from tablewarden.plans.registry import query, tables
from tablewarden.runtime import scratch_path

NOW = datetime(2024, 2, 1, 12)

_EVENTS = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


def _round_trip(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    where = scratch_path(spark, "snapshot")
    key_file = how.get("key_file")
    if key_file:
        how["key_file"] = key_file = f"{where}.key"
        K.new_key(spark, key_file)
    K.snapshot(tables(spark, sf_dir, "events"), where, now=NOW, **how)
    return K.restore(spark, where, key_file)["events"]


@query("snapshot_roundtrip", _EVENTS)
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir)


@query("readable_roundtrip", _EVENTS)
def readable_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through gzip JSON lines, microseconds and all."""
    return _round_trip(spark, sf_dir, fmt="json")


@query("encrypted_roundtrip", _EVENTS)
def encrypted_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, key_file=True)


@query("encrypted_roundtrip_gcm", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def encrypted_roundtrip_gcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch_path(spark, "snapshot")
    K.new_key(spark, f"{where}.key")
    K.snapshot(tables(spark, sf_dir, "customer"), where, now=NOW, key_file=f"{where}.key", mode="GCM")
    return K.restore(spark, where, f"{where}.key")["customer"]


_KEPT = ("customer", "documents", "orders")


@query("verify_snapshot", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS expected_rows, count(*) AS rows, true AS ok FROM {t}" for t in _KEPT
))
def verify_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and checksums of what was written, against the manifest."""
    where = scratch_path(spark, "snapshot")
    K.snapshot(tables(spark, sf_dir, *_KEPT), where, now=NOW)
    return K.verify_snapshot(spark, where)


@query("list_snapshots", """
    SELECT 'second' AS snapshot, CAST(1 AS BIGINT) AS tables, (SELECT count(*) FROM supplier) AS rows, false AS restorable,
      CAST(3600 AS BIGINT) AS age_seconds, CAST(3 * 3600 AS BIGINT) AS left_seconds
    UNION ALL SELECT 'first', 2, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier), true, 7200, 30 * 86400 - 7200
""")
def list_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first; the one whose key is gone cannot be restored, the expired one is removed."""
    root = scratch_path(spark, "snapshots")
    ts = tables(spark, sf_dir, "part", "supplier")
    K.snapshot(ts, f"{root}/first", now=NOW - timedelta(hours=2))
    K.new_key(spark, f"{root}-lost.key")
    K.snapshot(ts.only("supplier"), f"{root}/second", now=NOW - timedelta(hours=1), keep=K.TEMPORARY, key_file=f"{root}-lost.key")
    K.snapshot(ts.only("supplier"), f"{root}/old", now=NOW - timedelta(hours=9), keep=K.TEMPORARY)
    K.expire_snapshots(spark, root, NOW)
    listed = K.list_snapshots(spark, root, NOW, key_of=lambda name: f"{root}/{name}.key")
    return listed.select("snapshot", "tables", "rows", "restorable", "age_seconds", "left_seconds")


@query("restore_merge", """
    SELECT s_suppkey, s_acctbal FROM supplier
    UNION ALL SELECT s_suppkey + 1000000, CAST(0 AS DOUBLE) FROM supplier WHERE s_nationkey = 1
""")
def restore_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot merged back by key: lost and changed rows return, new ones stay."""
    ts, where = tables(spark, sf_dir, "supplier"), scratch_path(spark, "snapshot")
    K.snapshot(ts, where, now=NOW)
    supplier = ts["supplier"]
    damaged = supplier.where("s_nationkey <> 2").withColumn("s_acctbal", F.lit(0.0))
    new = supplier.where("s_nationkey = 1").withColumns({"s_suppkey": F.col("s_suppkey") + 1000000, "s_acctbal": F.lit(0.0)})
    present = ts.with_table("supplier", damaged.unionByName(new))
    merged = K.restore_into(present, K.restore(spark, where), replace=False)
    return merged["supplier"].select("s_suppkey", "s_acctbal")


@query("expire_events", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def expire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables(spark, sf_dir, "events")["events"]
    return K.expire(events, "ts", timedelta(days=30), datetime(2024, 2, 14)).select("event_id", "ts")


def _changed(ts):
    """Some suppliers deleted, a column dropped, another table added."""
    ts = ts.with_table("supplier", C.delete(ts["supplier"], {"s_nationkey": 7}))
    ts = C.drop_column(ts, "supplier", "s_acctbal")
    ts = ts.with_table("rich", ts["customer"].where("c_acctbal > 9000")).without("part")
    return ts.with_table("customer", C.add_column(ts["customer"], "phone", "VARCHAR(20)"))


_FINDINGS = """
    SELECT 'supplier' AS table_name, CAST(NULL AS VARCHAR) AS column_name, 'rows lost' AS change, (SELECT count(*) FROM supplier) AS rows_before,
      (SELECT count(*) FROM supplier WHERE s_nationkey <> 7) AS rows_after, (SELECT count(*) FROM supplier WHERE s_nationkey = 7) AS rows_lost, false AS safe
      WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = 7)
    UNION ALL SELECT 'supplier', 's_acctbal', 'column removed', (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier WHERE s_nationkey <> 7), NULL, false
    UNION ALL SELECT 'rich', NULL, 'table added', NULL, (SELECT count(*) FROM customer WHERE c_acctbal > 9000), NULL, true
    UNION ALL SELECT 'part', NULL, 'table removed', (SELECT count(*) FROM part), NULL, NULL, false
    UNION ALL SELECT 'customer', 'phone', 'column added', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer), NULL, true
"""


@query("diff_states", _FINDINGS)
def diff_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "supplier", "customer", "part")
    return X.diff_states(X.capture_state(ts), X.capture_state(_changed(ts)))


@query("rehearse_delete", """
    SELECT count(*) = 0 AS safe, CASE WHEN count(*) > 0 THEN 'rows lost supplier: ' || count(*) ELSE '' END AS warnings
    FROM supplier WHERE s_nationkey = 7
""")
def rehearse_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "supplier", "nation")
    trial = X.rehearse(
        ts, lambda t: t.with_table("supplier", C.delete(t["supplier"], {"s_nationkey": 7})), "delete"
    )
    return X.verdict(trial.findings).select("safe", F.array_join("warnings", "; ").alias("warnings"))


@query("diff_rows", """
    SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'removed' ELSE 'changed' END AS change FROM part
    WHERE p_partkey % 10 = 0 OR (p_partkey % 10 <> 0 AND p_size > 40)
    UNION ALL SELECT p_partkey + 10000000, 'added' FROM part WHERE p_size = 1
""")
def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables(spark, sf_dir, "part")["part"]
    after = part.where("p_partkey % 10 <> 0").withColumn("p_type", F.when(F.col("p_size") <= 40, F.col("p_type")))
    after = after.unionByName(part.where("p_size = 1").withColumn("p_partkey", F.col("p_partkey") + 10000000))
    return X.diff_rows(part, after, ("p_partkey",))
