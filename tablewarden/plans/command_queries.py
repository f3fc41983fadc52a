"""Whole document commands over schema-less forms of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.operators.commands import run_command
from tablewarden.plans.registry import query, tables
from tablewarden.sources.tables import TableSet


def _loose(df: DataFrame, key: str) -> DataFrame:
    """Rows as documents, the key as ``_id``."""
    fields = [F.col(key).alias("_id"), *[F.col(c) for c in df.columns if c != key]]
    return df.select(F.try_parse_json(F.to_json(F.struct(*fields))).alias("doc"))


def _shop(spark: SparkSession, sf_dir: str) -> TableSet:
    ts = tables(spark, sf_dir, "orders", "customer")
    return TableSet.of(spark, {"orders": _loose(ts["orders"], "o_orderkey"), "customer": _loose(ts["customer"], "c_custkey")})


@query("command_lookup", """
    SELECT c_custkey, count(*) AS large_orders, max(o_totalprice) AS largest FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_totalprice >= 200000 AND c_acctbal > 0 GROUP BY ALL
""")
def command_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit, joined with their large orders and grouped again."""
    rows = run_command(_shop(spark, sf_dir), {"aggregate": "customer", "pipeline": [
        {"$lookup": {"from": "orders", "localField": "_id", "foreignField": "o_custkey", "as": "bought"}},
        {"$match": {"c_acctbal": {"$gt": 0}}},
        {"$unwind": "$bought"},
        {"$match": {"bought.o_totalprice": {"$gte": 200000}}},
        {"$group": {"_id": "$_id", "large_orders": {"$sum": 1}, "largest": {"$max": "$bought.o_totalprice"}}},
    ]}).rows
    return rows.select(
        F.try_variant_get("_id", "$", "bigint").alias("c_custkey"), "large_orders",
        F.try_variant_get("largest", "$", "double").alias("largest"),
    )


@query("command_upsert", """
    SELECT 'known' AS step, 1 AS n, (SELECT count(*) FROM customer) AS total, 1 AS named
    UNION ALL SELECT 'absent', 1, (SELECT count(*) + 1 FROM customer), 1
    UNION ALL SELECT 'not asked for', 0, (SELECT count(*) FROM customer), 0
""")
def command_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update of one document that may have to be added first."""
    shop = _shop(spark, sf_dir)
    steps = {"known": (1, True), "absent": (-5, True), "not asked for": (-5, False)}
    out = []
    for step, (number, upsert) in steps.items():
        one = {"q": {"_id": number}, "u": {"$set": {"c_name": "renamed"}}, "upsert": upsert}
        answer = run_command(shop, {"update": "customer", "updates": [one]})
        after = answer.tables["customer"]
        named = run_command(answer.tables, {"count": "customer", "query": {"c_name": "renamed"}}).rows
        out.append(answer.rows.select(
            F.lit(step).alias("step"), F.col("n").cast("int").alias("n"), after.agg(F.count(F.lit(1))).scalar().alias("total"),
            named.select(F.col("n").cast("int")).scalar().alias("named"),
        ))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("command_skip", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 25
""")
def command_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a sorted report."""
    rows = run_command(_shop(spark, sf_dir), {
        "find": "orders", "filter": {"o_orderstatus": "O"}, "sort": {"o_totalprice": -1, "_id": 1}, "skip": 25, "limit": 40,
        "projection": {"o_totalprice": 1},
    }).rows
    return rows.select(
        F.try_variant_get("_id", "$", "bigint").alias("o_orderkey"), F.try_variant_get("o_totalprice", "$", "double").alias("o_totalprice"),
    )


@query("command_group", """
    SELECT o_orderstatus AS status, count(*) AS count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL
""")
def command_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_command(_shop(spark, sf_dir), {"aggregate": "orders", "pipeline": [
        {"$group": {"_id": "$o_orderstatus", "count": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}}},
    ]}).rows
    return rows.select(F.try_variant_get("_id", "$", "string").alias("status"), "count", F.round("total", 2).alias("total"))


@query("command_update_delete", """
    SELECT 'updated' AS step, count(*) FILTER (WHERE c_acctbal < 0) AS n FROM customer
    UNION ALL SELECT 'deleted', count(*) FILTER (WHERE c_mktsegment = 'BUILDING') FROM customer
    UNION ALL SELECT 'poor left', count(*) FILTER (WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING') FROM customer
""")
def command_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = _shop(spark, sf_dir)
    updated = run_command(shop, {"update": "customer", "updates": [
        {"q": {"c_acctbal": {"$lt": 0}}, "u": {"$set": {"state": "poor"}}, "multi": True},
    ]})
    deleted = run_command(updated.tables, {"delete": "customer", "deletes": [{"q": {"c_mktsegment": "BUILDING"}, "limit": 0}]})
    left = run_command(deleted.tables, {"count": "customer", "query": {"state": "poor"}})
    steps = {"updated": updated, "deleted": deleted, "poor left": left}
    frames = [a.rows.select(F.lit(name).alias("step"), "n") for name, a in steps.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
