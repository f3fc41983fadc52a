"""References and keys found in the given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.operators.discovery import discover_keys, discover_references
from tablewarden.plans.registry import REFERENCES, query, tables

# name and family of the columns that can refer to another
_COLUMNS = {
    "region": "r_regionkey:whole r_name:text", "nation": "n_nationkey:whole n_name:text n_regionkey:whole",
    "customer": "c_custkey:whole c_name:text c_nationkey:whole c_mktsegment:text",
    "supplier": "s_suppkey:whole s_name:text s_nationkey:whole",
    "part": "p_partkey:whole p_name:text p_brand:text p_type:text p_size:whole",
    "orders": "o_orderkey:whole o_custkey:whole o_orderstatus:text o_orderdate:time o_orderpriority:text",
    "lineitem": "l_orderkey:whole l_partkey:whole l_suppkey:whole l_linenumber:whole l_returnflag:text l_linestatus:text l_shipdate:time",
    "documents": "doc_id:whole text:text lang:text source:text n_chars:whole",
    "labels": "doc_id:whole quality:whole toxic:whole",
}


def _references_sql() -> str:
    every = [(t, *c.split(":")) for t, cs in _COLUMNS.items() for c in cs.split()]
    values = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, '{f}' AS f, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} GROUP BY {c}" for t, c, f in every)
    declared = ", ".join(f"('{r.child}', '{r.column}', '{r.parent}', '{r.parent_column}')" for r in REFERENCES)
    return f"""
        WITH x AS ({values}),
        facts AS (SELECT t, c, count(v) AS vals, max(n) AS most, count(*) - count(v) AS nulls FROM x GROUP BY t, c),
        pairs AS (SELECT a.t, a.c, b.t AS pt, b.c AS pc, count(*) AS covered FROM x a JOIN x b ON a.f = b.f AND a.v = b.v AND (a.t <> b.t OR a.c <> b.c) GROUP BY ALL)
        SELECT p.t AS child_table, p.c AS child_column, p.pt AS parent_table, p.pc AS parent_column, k.vals AS child_values, u.vals AS parent_values, p.covered,
            (p.t, p.c, p.pt, p.pc) IN ({declared}) AS declared
        FROM pairs p JOIN facts k ON k.t = p.t AND k.c = p.c JOIN facts u ON u.t = p.pt AND u.c = p.pc
        WHERE p.covered = k.vals AND u.most = 1 AND u.nulls = 0
    """


@query("discover_references", _references_sql())
def references_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column whose values all are in a unique column, declared or not."""
    return discover_references(tables(spark, sf_dir, *_COLUMNS))


_PARTS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]


def _keys_sql() -> str:
    sets = [s for k in (1, 2, 3) for s in combinations(_PARTS, k)]
    counted = " UNION ALL ".join(
        f"SELECT [{', '.join(repr(c) for c in s)}] AS cols, count(*) AS n, (SELECT count(DISTINCT ({', '.join(s)},)) FROM lineitem) AS d FROM lineitem" for s in sets
    )
    return f"""
        WITH c AS ({counted})
        SELECT array_to_string(cols, ',') AS columns, n AS rows FROM c
        WHERE n = d AND NOT EXISTS (SELECT 1 FROM c k WHERE k.n = k.d AND len(k.cols) < len(c.cols) AND list_has_all(c.cols, k.cols))
    """


@query("discover_keys", _keys_sql())
def keys_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest sets of up to three columns that tell all lines of orders apart."""
    found = discover_keys(tables(spark, sf_dir, "lineitem")["lineitem"], _PARTS)
    return found.where("unique").select(F.array_join("columns", ",").alias("columns"), "rows")
