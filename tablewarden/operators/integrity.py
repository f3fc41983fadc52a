"""Schema, key, reference and rule checks.

Every check returns its findings as rows with a severity, so that checks of
several tables or environments can be put together with ``unionByName``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewarden.functions.digests import value_key
from tablewarden.sources.tables import Reference, TableSet

ERROR, WARNING = "error", "warning"

# Declared type name -> canonical type name.
_CANONICAL = {
    "SERIAL": "INTEGER",
    "INT": "INTEGER",
    "BIGSERIAL": "BIGINT",
    "VARCHAR": "CHARACTER VARYING",
    "DECIMAL": "NUMERIC",
    "TEXT[]": "ARRAY",
    "TIMESTAMPTZ": "TIMESTAMP WITH TIME ZONE",
    "BOOL": "BOOLEAN",
    "TIME WITHOUT TIME ZONE": "TIME",
}

# Canonical type name -> Spark type name.
_SPARK_TYPES = {
    "SMALLINT": "smallint",
    "INTEGER": "int",
    "BIGINT": "bigint",
    "NUMERIC": "decimal",
    "REAL": "float",
    "DOUBLE PRECISION": "double",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "TIMESTAMP WITH TIME ZONE": "timestamp",
    "CHARACTER VARYING": "string",
    "CHAR": "string",
    "TEXT": "string",
    "UUID": "string",
    "INET": "string",
    "JSON": "string",
    "JSONB": "string",
    "BYTEA": "binary",
    "ARRAY": "array",
    # a time of day is kept as text, hh:mm:ss
    "TIME": "string",
    "INTERVAL": "interval",
}


@dataclass(frozen=True)
class ExpectedColumn:
    """What a declared column definition asks for."""

    name: str
    definition: str

    @property
    def canonical_type(self) -> str:
        """The type without constraints, length or precision."""
        text = re.split(
            r"\s+(?:NOT\s+NULL|NULL|DEFAULT|CHECK|UNIQUE|PRIMARY\s+KEY|REFERENCES)\b",
            self.definition.strip(), maxsplit=1, flags=re.I,
        )[0]
        bare = re.sub(r"\s*\([^)]*\)", "", " ".join(text.upper().split()))
        return _CANONICAL.get(bare, bare)

    @property
    def spark_type(self) -> str:
        return _SPARK_TYPES.get(self.canonical_type, self.canonical_type.lower())

    @property
    def required(self) -> bool:
        return bool(re.search(r"\bNOT\s+NULL\b|\bPRIMARY\s+KEY\b", self.definition, re.I))

    @property
    def unique(self) -> bool:
        return bool(re.search(r"\bUNIQUE\b|\bPRIMARY\s+KEY\b", self.definition, re.I))

    @property
    def max_length(self) -> int | None:
        found = re.match(r"\s*(?:VARCHAR|CHARACTER VARYING|CHAR)\s*\(\s*(\d+)\s*\)", self.definition, re.I)
        return int(found.group(1)) if found else None

    @property
    def check(self) -> str | None:
        """The condition between the bracket after CHECK and the one that closes it."""
        found = re.search(r"\bCHECK\s*\(", self.definition, re.I)
        if not found:
            return None
        depth, quoted = 1, False
        for at in range(found.end(), len(self.definition)):
            c = self.definition[at]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            if not depth:
                return self.definition[found.end() : at]
        raise ValueError(f"column {self.name}: the CHECK condition does not end")


Expected = Mapping[str, Mapping[str, str]]


def expected_columns(expected: Expected, table: str) -> list[ExpectedColumn]:
    return [ExpectedColumn(n, d) for n, d in expected[table].items()]


def _same_type(dtype: T.DataType, wanted: str) -> bool:
    if wanted == "interval":
        # months and days are types of their own in Spark
        return isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType))
    return dtype.simpleString().split("(")[0].split("<")[0] == wanted


_ISSUE = "table_name string, column_name string, issue string, severity string, expected string, found string"


def schema_drift(ts: TableSet, expected: Expected, allow_extra: bool = False) -> DataFrame:
    """Missing and extra tables and columns, and types that differ.

    Missing things and wrong types are errors, extra things warnings. ``rows``
    tells how many rows of an existing table are concerned. Only schemas are
    compared on the driver; the counting is one aggregate per affected table.
    """
    issues: list[tuple] = []
    for table in sorted(set(expected) | set(ts.names)):
        if table not in ts:
            issues.append((table, None, "missing table", ERROR, None, None))
        elif table not in expected:
            if not allow_extra:
                issues.append((table, None, "extra table", WARNING, None, None))
        else:
            issues += _column_drift(ts[table].schema, table, expected)
    listed = ts.spark.createDataFrame(issues, _ISSUE)
    counted = [
        ts[t].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows")
        for t in sorted({i[0] for i in issues if i[0] in ts})
    ]
    if not counted:
        return listed.withColumn("rows", F.lit(None).cast("bigint"))
    # one row per table name
    return listed.join(F.broadcast(reduce(DataFrame.unionByName, counted)), "table_name", "left")


def _column_drift(schema: T.StructType, table: str, expected: Expected) -> list[tuple]:
    wanted = {c.name: c for c in expected_columns(expected, table)}
    found = {f.name: f for f in schema.fields}
    out = []
    for name in sorted(set(wanted) | set(found)):
        if name not in found:
            out.append((table, name, "missing column", ERROR, wanted[name].canonical_type, None))
        elif name not in wanted:
            out.append((table, name, "extra column", WARNING, None, found[name].dataType.simpleString()))
        elif not _same_type(found[name].dataType, wanted[name].spark_type):
            out.append((
                table, name, "type mismatch", ERROR,
                wanted[name].spark_type, found[name].dataType.simpleString(),
            ))
    return out


def check_rules(ts: TableSet, rules: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Count the rows that break each rule, in one pass per table.

    ``rules`` maps a table to ``{rule name: SQL condition}``. A condition that
    is NULL passes, as a CHECK constraint does.
    """
    return _count_broken(ts, {t: {n: F.expr(e) for n, e in r.items()} for t, r in rules.items()})


def _count_broken(ts: TableSet, rules: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    frames = []
    for table, conditions in rules.items():
        counts = F.array(*[
            F.struct(
                F.lit(name).alias("rule"),
                F.count(F.when(~F.coalesce(holds, F.lit(True)), 1)).alias("broken"),
            )
            for name, holds in conditions.items()
        ])
        frames.append(
            ts[table].agg(counts.alias("c"), F.count(F.lit(1)).alias("rows"))
            .select(F.lit(table).alias("table_name"), "rows", F.inline("c"))
            .select("table_name", "rule", "broken", "rows")
        )
    return reduce(DataFrame.unionByName, frames).withColumn(
        "severity", F.when(F.col("broken") > 0, ERROR).otherwise("ok")
    )


def declared_rules(expected: Expected, table: str) -> dict[str, Column]:
    """Rules that follow from column definitions: NOT NULL, lengths, CHECK."""
    rules: dict[str, Column] = {}
    for c in expected_columns(expected, table):
        col = F.col(f"`{c.name}`")
        if c.required:
            rules[f"{c.name} not null"] = col.isNotNull()
        if c.max_length is not None:
            rules[f"{c.name} length <= {c.max_length}"] = F.length(col) <= c.max_length
        if c.check:
            rules[f"{c.name} check"] = F.expr(c.check)
    return rules


def check_declared(ts: TableSet, expected: Expected) -> DataFrame:
    rules = {t: declared_rules(expected, t) for t in expected if t in ts}
    return _count_broken(ts, {t: r for t, r in rules.items() if r})


def check_not_null(ts: TableSet, required: Mapping[str, list[str]]) -> DataFrame:
    """NULLs in columns that must not have any."""
    return _count_broken(
        ts, {t: {f"{c} not null": F.col(f"`{c}`").isNotNull() for c in cs} for t, cs in required.items()}
    )


def orphans(ts: TableSet, ref: Reference) -> DataFrame:
    """Child rows whose reference finds no parent; NULL references are none."""
    child = ts[ref.child].where(F.col(ref.column).isNotNull())
    parent = ts[ref.parent].select(F.col(ref.parent_column).alias("__parent"))
    return child.join(parent, child[ref.column] == parent["__parent"], "left_anti")


def check_references(ts: TableSet, references: list[Reference] | None = None) -> DataFrame:
    """Orphaned values and rows per reference.

    Child rows are counted per referenced value before the anti join, so a
    value that most rows point at is one row in it.
    """
    frames = []
    for ref in references if references is not None else ts.references:
        counts = (
            ts[ref.child].where(F.col(ref.column).isNotNull())
            .groupBy(F.col(ref.column).alias("__value"))
            .agg(F.count(F.lit(1)).alias("__rows"))
        )
        parent = ts[ref.parent].select(F.col(ref.parent_column).alias("__parent"))
        lost = counts.join(parent, counts["__value"] == parent["__parent"], "left_anti")
        frames.append(
            lost.agg(
                F.count(F.lit(1)).alias("orphan_values"),
                F.coalesce(F.sum("__rows"), F.lit(0)).alias("orphan_rows"),
            ).select(F.lit(ref.name).alias("reference"), "orphan_values", "orphan_rows")
        )
    return reduce(DataFrame.unionByName, frames).withColumn(
        "severity", F.when(F.col("orphan_rows") > 0, ERROR).otherwise("ok")
    )


def unmatched_parents(ts: TableSet, ref: Reference) -> DataFrame:
    """Parent rows no child points at."""
    child = ts[ref.child].select(F.col(ref.column).alias("__child")).distinct()
    parent = ts[ref.parent]
    return parent.join(child, parent[ref.parent_column] == child["__child"], "left_anti")


def dependents(ts: TableSet, ref: Reference, parents: DataFrame) -> DataFrame:
    """Child rows that point at any of the given parent rows."""
    keys = parents.select(F.col(ref.parent_column).alias("__parent")).distinct()
    child = ts[ref.child]
    return child.join(keys, child[ref.column] == keys["__parent"], "left_semi")


def duplicates(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Key values that occur more than once; NULL parts never collide."""
    whole = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in key])
    return (
        df.where(whole).groupBy(*[F.col(f"`{k}`") for k in key])
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def check_unique(ts: TableSet, keys: Mapping[str, list[tuple[str, ...]]] | None = None) -> DataFrame:
    """Per key: how many values are repeated and how many rows are too many."""
    wanted = keys or {t: ts.unique_keys(t) for t in ts.names if ts.unique_keys(t)}
    frames = []
    for table, each in wanted.items():
        for key in each:
            # only counts are asked for: long texts need not move
            short = [
                value_key(F.col(f"`{k}`")).alias(k)
                if isinstance(ts[table].schema[k].dataType, T.StringType) else F.col(f"`{k}`")
                for k in key
            ]
            frames.append(
                duplicates(ts[table].select(*short), key).agg(
                    F.count(F.lit(1)).alias("repeated_values"),
                    F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus_rows"),
                ).select(
                    F.lit(table).alias("table_name"), F.lit(", ".join(key)).alias("key"),
                    "repeated_values", "surplus_rows",
                )
            )
    return reduce(DataFrame.unionByName, frames).withColumn(
        "severity", F.when(F.col("repeated_values") > 0, ERROR).otherwise("ok")
    )


def check_nonempty(ts: TableSet, specs: Mapping[str, str | None]) -> DataFrame:
    """Whether each table has rows, or rows that meet a condition.

    A table that is missing is an error, an empty one a warning.
    """
    frames = []
    for table, condition in specs.items():
        if table not in ts:
            frames.append(ts.spark.range(1).select(
                F.lit(table).alias("table_name"), F.lit(None).cast("bigint").alias("rows"),
                F.lit(ERROR).alias("severity"),
            ))
            continue
        rows = ts[table].where(condition) if condition else ts[table]
        frames.append(rows.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(table).alias("table_name"), "rows",
            F.when(F.col("rows") > 0, "ok").otherwise(WARNING).alias("severity"),
        ))
    return reduce(DataFrame.unionByName, frames)


def verify_environments(environments: Mapping[str, TableSet], expected: Expected) -> DataFrame:
    """The schema check over several sets of tables, one ``env`` column ahead."""
    frames = [
        schema_drift(ts, expected).select(F.lit(env).alias("env"), "*") for env, ts in environments.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def environment_rows(environments: Mapping[str, TableSet]) -> DataFrame:
    """How many rows the tables of each environment hold together."""
    frames = [
        ts[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(env).alias("env"), "rows")
        for env, ts in environments.items() for name in ts.names
    ]
    return reduce(DataFrame.unionByName, frames).groupBy("env").agg(F.sum("rows").alias("rows"))


def verdicts(report: DataFrame, environments: list[str]) -> DataFrame:
    """Errors, warnings and an overall verdict per environment."""
    counted = report.groupBy("env").agg(
        F.count(F.when(F.col("severity") == ERROR, 1)).alias("errors"),
        F.count(F.when(F.col("severity") == WARNING, 1)).alias("warnings"),
    )
    spark: SparkSession = report.sparkSession
    names = spark.createDataFrame([(e,) for e in environments], "env string")
    return names.join(F.broadcast(counted), "env", "left").select(
        "env", F.coalesce("errors", F.lit(0)).alias("errors"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
        (F.coalesce("errors", F.lit(0)) == 0).alias("passed"),
    )


def summary(report: DataFrame) -> DataFrame:
    """Findings per severity."""
    return report.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
