"""Outputs: JSON lines, CSV of hits, table copies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T

from tablewarden.runtime import run_together
from tablewarden.sources.tables import TableSet


# JSON text would otherwise keep milliseconds only
JSON_TIMES = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def to_json_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.options(compression=compression, **JSON_TIMES).json(path)


def text_form(column: str, dtype: T.DataType):
    """A column as the text a report shows; objects and arrays become JSON."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(F.col(f"`{column}`"))
    if isinstance(dtype, T.BinaryType):
        return F.base64(F.col(f"`{column}`"))
    return F.col(f"`{column}`").cast("string")


def export_csv(wide_hits: DataFrame, path: str) -> None:
    """Write hits from tables of different shape under one header.

    The header is ``table, matching_columns`` and then the sorted union of all
    columns; quotes are doubled and NULL is empty.
    """
    rest = sorted(c for c in wide_hits.columns if c not in ("table", "matching_columns"))
    wide_hits.select("table", "matching_columns", *[F.col(f"`{c}`") for c in rest]).write.csv(
        path, header=True, escape='"', nullValue="", emptyValue='""'
    )


def copy_table(ts: TableSet, name: str, directory: str, stamp: datetime) -> str:
    """Copy one table to ``backup_<name>_<stamp>`` and return the path."""
    path = f"{directory}/backup_{name}_{stamp:%Y%m%dT%H%M%S}.parquet"
    ts[name].write.parquet(path)
    return path


def clone(ts: TableSet, directory: str) -> TableSet:
    """Copy every table below ``directory`` and return a set over the copies."""
    run_together(
        ts.spark,
        [lambda n=n: ts[n].write.parquet(f"{directory}/{n}.parquet") for n in ts.names],
    )
    return TableSet.from_parquet(
        ts.spark, directory, ts.names, keys=dict(ts.keys), uniques=dict(ts.uniques),
        references=list(ts.references), json_columns=dict(ts.json_columns),
    )
