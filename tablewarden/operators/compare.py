"""State capture, before/after differences, rehearsal of a change."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablewarden.functions.digests import row_digest
from tablewarden.operators.profile import count_all
from tablewarden.sources.tables import TableSet

SAFE, CAUTION, WARNING, DANGER = "safe", "caution", "warning", "danger"

# How risky each kind of change is.
RISK = {
    "search": SAFE,
    "count": SAFE,
    "check": SAFE,
    "snapshot": SAFE,
    "add_column": CAUTION,
    "add_required_column": WARNING,
    "cluster": CAUTION,
    "seed": CAUTION,
    "rename_column": WARNING,
    "rename_field": WARNING,
    "migrate": WARNING,
    "update": WARNING,
    "insert": WARNING,
    "upsert": WARNING,
    "drop_table": DANGER,
    "drop_column": DANGER,
    "remove_field": DANGER,
    "restore": DANGER,
    "delete": DANGER,
    "delete_cascade": DANGER,
}


def capture_state(ts: TableSet) -> DataFrame:
    """Every column of every table, with the row count of its table."""
    columns = [
        (t, i, f.name, f.dataType.simpleString())
        for t in ts.open().names for i, f in enumerate(ts[t].schema.fields)
    ]
    listed = ts.spark.createDataFrame(
        columns, "table_name string, position int, column_name string, data_type string"
    )
    # one row per table
    return listed.join(F.broadcast(count_all(ts, total=False)), "table_name")


def diff_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables and columns added or removed and rows lost, one row per finding.

    Anything removed or lost is not ``safe``. Two equal states give no rows.
    """
    def tables(state: DataFrame, side: str) -> DataFrame:
        return state.groupBy("table_name").agg(F.max("rows").alias(f"rows_{side}"))

    per_table = tables(before, "before").join(tables(after, "after"), "table_name", "full")
    change = (
        F.when(F.col("rows_before").isNull(), "table added")
        .when(F.col("rows_after").isNull(), "table removed")
        .when(F.col("rows_after") < F.col("rows_before"), "rows lost")
    )
    table_findings = per_table.select(
        "table_name", F.lit(None).cast("string").alias("column_name"), change.alias("change"),
        "rows_before", "rows_after",
    ).where(F.col("change").isNotNull())

    def columns(state: DataFrame, mark: str) -> DataFrame:
        return state.select("table_name", "column_name", F.lit(True).alias(mark))

    # only columns of tables that are on both sides
    kept = per_table.where(F.col("rows_before").isNotNull() & F.col("rows_after").isNotNull())
    per_column = (
        columns(before, "was").join(columns(after, "is"), ["table_name", "column_name"], "full")
        .where(F.col("was").isNull() | F.col("is").isNull())
        .join(kept, "table_name")
        .select(
            "table_name", "column_name",
            F.when(F.col("was").isNull(), "column added").otherwise("column removed").alias("change"),
            "rows_before", "rows_after",
        )
    )
    return table_findings.unionByName(per_column).select(
        "*",
        F.when(F.col("change") == "rows lost", F.col("rows_before") - F.col("rows_after")).alias("rows_lost"),
        F.col("change").isin("table added", "column added").alias("safe"),
    )


def verdict(findings: DataFrame) -> DataFrame:
    """One row: whether everything is safe, and the warnings if not."""
    subject = F.concat_ws(".", "table_name", "column_name")
    loss = F.when(F.col("rows_lost").isNotNull(), F.concat(F.lit(": "), F.col("rows_lost").cast("string")))
    warning = F.concat(F.col("change"), F.lit(" "), subject, F.coalesce(loss, F.lit("")))
    return findings.agg(
        F.coalesce(F.min("safe"), F.lit(True)).alias("safe"),
        F.sort_array(F.collect_list(F.when(~F.col("safe"), warning))).alias("warnings"),
    )


@dataclass(frozen=True)
class Rehearsal:
    before: TableSet
    after: TableSet
    findings: DataFrame

    def result(self) -> TableSet:
        """The changed set, if nothing was lost; else an error with the warnings."""
        row = verdict(self.findings).first()
        if not row["safe"]:
            raise ValueError("; ".join(row["warnings"]))
        return self.after


def rehearse(
    ts: TableSet, change: Callable[[TableSet], TableSet], operation: str | None = None,
    snapshot_first: Callable[[TableSet], object] | None = None,
) -> Rehearsal:
    """Apply a change to the frames and compare both states; nothing is copied.

    Only operations that rank as warning or danger are compared; before a
    dangerous one ``snapshot_first`` is called. An unnamed one is dangerous.
    """
    risk = RISK.get(operation, DANGER) if operation else DANGER
    if risk == DANGER and snapshot_first:
        snapshot_first(ts)
    after = change(ts)
    if risk in (SAFE, CAUTION):
        none = "table_name string, column_name string, change string, rows_before bigint, rows_after bigint, rows_lost bigint, safe boolean"
        return Rehearsal(ts, after, ts.spark.createDataFrame([], none))
    return Rehearsal(ts, after, diff_states(capture_state(ts), capture_state(after)))


def diff_rows(before: DataFrame, after: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that were added, removed or changed between two versions.

    Both versions are reduced to key and digest, put together and grouped once;
    that moves less than a join and copes with repeated keys, which count as
    changed when their rows differ as a whole.
    """
    shared = [f for f in before.schema.fields if f.name in after.columns]

    def side(df: DataFrame, is_after: int) -> DataFrame:
        fields = [df.schema[f.name] for f in shared]
        return df.select(
            *[F.col(f"`{k}`") for k in key], row_digest(fields).alias("__digest"), F.lit(is_after).alias("__after")
        )

    def of(which: int, col: Column) -> Column:
        return F.when(F.col("__after") == which, col)

    wide = F.col("__digest").cast("decimal(38,0)")
    both = side(before, 0).unionByName(side(after, 1)).groupBy(*[F.col(f"`{k}`") for k in key]).agg(
        F.count(of(0, F.lit(1))).alias("n0"), F.count(of(1, F.lit(1))).alias("n1"),
        F.sum(of(0, wide)).alias("d0"), F.sum(of(1, wide)).alias("d1"),
    )
    change = (
        F.when(F.col("n0") == 0, "added")
        .when(F.col("n1") == 0, "removed")
        .when((F.col("n0") != F.col("n1")) | (F.col("d0") != F.col("d1")), "changed")
    )
    return both.select(*[F.col(f"`{k}`") for k in key], change.alias("change")).where(F.col("change").isNotNull())
