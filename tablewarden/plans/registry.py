"""The catalogue of ready-made queries and what they should return, as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewarden.sources.tables import CASCADE, Reference, TableSet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "labels": ("doc_id",),
    "benchmark": ("item_id",),
    "pages": ("page_id",),
    "conversations": ("conv_id", "turn"),
    "embeddings": ("vec_id",),
}

REFERENCES = [
    Reference("nation", "n_regionkey", "region", "r_regionkey"),
    Reference("customer", "c_nationkey", "nation", "n_nationkey"),
    Reference("supplier", "s_nationkey", "nation", "n_nationkey"),
    Reference("orders", "o_custkey", "customer", "c_custkey", CASCADE),
    Reference("lineitem", "l_orderkey", "orders", "o_orderkey", CASCADE),
    Reference("lineitem", "l_partkey", "part", "p_partkey"),
    Reference("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Reference("labels", "doc_id", "documents", "doc_id", CASCADE),
]

TABLES = list(KEYS)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> TableSet:
    """The given tables, or all, with their keys, references and JSON columns."""
    wanted = set(names or TABLES)
    return TableSet.from_parquet(
        spark, sf_dir, [n for n in TABLES if n in wanted],
        keys={n: k for n, k in KEYS.items() if n in wanted},
        references=[r for r in REFERENCES if r.child in wanted and r.parent in wanted],
        json_columns={"events": {"props"}} if "events" in wanted else {},
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def key_sql(table: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in KEYS[table]) + ")"


def hits_sql(table: str, conditions: dict[str, str], source: str | None = None) -> str:
    """Hits of one table: any condition holds, and the names of those that do."""
    named = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in conditions.items())
    return (
        f"SELECT '{table}' AS table_name, {key_sql(table)} AS row_key, "
        f"concat_ws(';', {named}) AS matching_columns FROM {source or table} "
        f"WHERE {' OR '.join(conditions.values())}"
    )
