"""Snapshots of a set of tables: write, encrypt, verify, restore, list, expire."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tablewarden.functions.digests import row_digest
from tablewarden.functions.values import moment
from tablewarden.operators.change import upsert
from tablewarden.runtime import (
    delete_path, hadoop_path, list_dir, path_exists, run_together, write_small_file,
)
from tablewarden.sources.sinks import JSON_TIMES, to_json_lines
from tablewarden.sources.tables import TableSet

TEMPORARY = timedelta(hours=4)
SCHEDULED = timedelta(days=30)

_MANIFEST = "_manifest"
_MANIFEST_SCHEMA = (
    "table_name string, rows bigint, checksum string, schema_json string, path string, format string, "
    "encryption string, bytes bigint, created_at timestamp, expires_at timestamp"
)


def checksum(schema: T.StructType) -> Column:
    """An aggregate that is the same for the same rows in any order."""
    return F.coalesce(F.sum(row_digest(schema.fields).cast("decimal(38,0)")), F.lit(0)).cast("string")


def new_key(spark: SparkSession, key_file: str) -> None:
    """A random 32-byte key in a file of its own, which must not exist yet."""
    write_small_file(spark, key_file, os.urandom(32))


def _key(spark: SparkSession, key_file: str) -> Column:
    """The key as a subquery over its file, so that no plan or log shows it."""
    return spark.read.format("binaryFile").load(key_file).select("content").scalar()


def snapshot(
    ts: TableSet, directory: str, *, now: datetime, fmt: str = "parquet",
    keep: timedelta = SCHEDULED, key_file: str | None = None, mode: str = "CBC",
) -> DataFrame:
    """Write every table and a manifest, and return the manifest.

    ``parquet`` is compact, ``json`` is readable (gzip JSON lines). With a key
    file each row is encrypted on its own with AES-256 and a random IV; ``GCM``
    also authenticates. Rows and checksum are taken on the way out, and tables
    are written side by side.
    """
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unknown format {fmt}")
    spark = ts.spark

    def write(name: str) -> Callable[[], tuple]:
        def job() -> tuple:
            df, path = ts[name], f"{directory}/{name}"
            seen = Observation()
            watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), checksum(df.schema).alias("checksum"))
            if key_file:
                row = F.to_json(F.struct("*"), JSON_TIMES | {"ignoreNullFields": "false"})
                sealed = F.aes_encrypt(row, _key(spark, key_file), F.lit(mode))
                watched.select(sealed.alias("sealed")).write.parquet(path)
            elif fmt == "json":
                to_json_lines(watched, path, compression="gzip")
            else:
                watched.write.parquet(path)
            facts = seen.get
            fs, p = hadoop_path(spark, path)
            size = fs.getContentSummary(p).getLength()
            return (
                name, facts["rows"], facts["checksum"], df.schema.json(), path, fmt,
                mode if key_file else None, size, now, now + keep,
            )

        return job

    rows = run_together(spark, [write(n) for n in ts.names])
    manifest = spark.createDataFrame(rows, _MANIFEST_SCHEMA)
    # written last: a snapshot without a manifest is not one
    manifest.coalesce(1).write.parquet(f"{directory}/{_MANIFEST}")
    return spark.read.schema(_MANIFEST_SCHEMA).parquet(f"{directory}/{_MANIFEST}")


def manifest_of(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(_MANIFEST_SCHEMA).parquet(f"{directory}/{_MANIFEST}")


def _read_table(spark: SparkSession, entry: T.Row, key_file: str | None) -> DataFrame:


    schema = T.StructType.fromJson(json.loads(entry["schema_json"]))
    if entry["encryption"]:
        if not key_file:
            raise ValueError("the snapshot is encrypted: a key file is needed")
        sealed = spark.read.schema("sealed binary").parquet(entry["path"])
        opened = F.aes_decrypt("sealed", _key(spark, key_file), F.lit(entry["encryption"])).cast("string")
        return sealed.select(F.from_json(opened, schema, JSON_TIMES | {"mode": "FAILFAST"}).alias("r")).select("r.*")
    if entry["format"] == "json":
        return spark.read.schema(schema).options(mode="FAILFAST", **JSON_TIMES).json(entry["path"])
    return spark.read.schema(schema).parquet(entry["path"])


def restore(
    spark: SparkSession, directory: str, key_file: str | None = None, names: list[str] | None = None
) -> TableSet:
    """The tables of a snapshot, read lazily."""
    entries = [e for e in manifest_of(spark, directory).collect() if names is None or e["table_name"] in names]
    return TableSet.of(spark, {e["table_name"]: _read_table(spark, e, key_file) for e in entries})


def restore_into(ts: TableSet, restored: TableSet, replace: bool = True) -> TableSet:
    """Put restored tables in place of the present ones, or merge them by key."""
    out = ts
    for name in restored.names:
        if replace or name not in ts:
            out = out.with_table(name, restored[name])
        else:
            out = out.with_table(name, upsert(ts[name], restored[name], ts.key_of(name), replace_row=True))
    return out


def verify_snapshot(spark: SparkSession, directory: str, key_file: str | None = None) -> DataFrame:
    """Read everything back and compare rows and checksums with the manifest."""
    frames = []
    for entry in manifest_of(spark, directory).collect():
        df = _read_table(spark, entry, key_file)
        frames.append(df.agg(F.count(F.lit(1)).alias("rows"), checksum(df.schema).alias("checksum")).select(
            F.lit(entry["table_name"]).alias("table_name"),
            F.lit(entry["rows"]).alias("expected_rows"), "rows",
            ((F.col("rows") == entry["rows"]) & (F.col("checksum") == entry["checksum"])).alias("ok"),
        ))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _snapshots(spark: SparkSession, root: str) -> list[str]:
    return [n for n in list_dir(spark, root) if path_exists(spark, f"{root}/{n}/{_MANIFEST}")]


def list_snapshots(
    spark: SparkSession, root: str, now: datetime, key_of: Callable[[str], str] | None = None
) -> DataFrame:
    """Snapshots below a folder, newest first: size, age, time left, restorable.

    ``key_of`` names the key file of a snapshot; an encrypted one is restorable
    only if that exists.
    """
    frames = []
    for name in _snapshots(spark, root):
        has_key = bool(key_of) and path_exists(spark, key_of(name))
        frames.append(
            manifest_of(spark, f"{root}/{name}")
            .groupBy(F.lit(name).alias("snapshot"), "created_at", "expires_at")
            .agg(
                F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
                (F.max("encryption").isNull() | F.lit(has_key)).alias("restorable"),
            )
        )
    if not frames:
        shape = "snapshot string, created_at timestamp, expires_at timestamp, tables bigint, rows bigint, bytes bigint, restorable boolean, age_seconds bigint, left_seconds bigint"
        return spark.createDataFrame([], shape)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    at = F.unix_seconds(F.lit(now).cast("timestamp"))
    return out.select(
        "*", (at - F.unix_seconds("created_at")).alias("age_seconds"),
        F.greatest(F.lit(0), F.unix_seconds("expires_at") - at).alias("left_seconds"),
    ).orderBy(F.desc("created_at"), "snapshot")


def expire_snapshots(spark: SparkSession, root: str, now: datetime) -> list[str]:
    """Delete the snapshots whose time is up and return their names."""
    due = [
        r["snapshot"] for r in
        list_snapshots(spark, root, now).where(F.col("expires_at") <= F.lit(now)).select("snapshot").collect()
    ]
    for name in due:
        delete_path(spark, f"{root}/{name}")
    return due


def expire(df: DataFrame, column: str, keep: timedelta, now: datetime) -> DataFrame:
    """Rows younger than ``keep``; rows without a time never expire."""
    cutoff = moment(now - keep, df.schema[column].dataType)
    return df.where(F.col(column).isNull() | (F.col(column) > cutoff))
