"""Changes of columns, fields and rows of the given tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.functions.values import is_numeric, parse_text
from tablewarden.operators import change as C
from tablewarden.operators import migrate as M
from tablewarden.plans.registry import query, tables
from tablewarden.runtime import scratch_path

NOW = datetime(2024, 2, 1)


@query("add_column_default", """
    SELECT p_partkey, '+1-555-0000' AS phone, CAST(NULL AS INT) AS stock, CAST(9.5 AS DOUBLE) AS factor FROM part
""")
def add_column_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables(spark, sf_dir, "part")["part"]
    out = C.add_column(part, "phone", "VARCHAR(20)", "+1-555-0000", not_null=True)
    out = C.add_column(C.add_column(out, "stock", "INTEGER"), "factor", "DOUBLE PRECISION", 9.5)
    return out.select("p_partkey", "phone", "stock", "factor")


@query("rename_drop", "SELECT s_suppkey, s_name AS supplier_name, s_nationkey FROM supplier")
def rename_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "supplier", "nation")
    ts = C.rename_column(ts, "supplier", "s_name", "supplier_name")
    return C.drop_column(ts, "supplier", "s_acctbal")["supplier"]


@query("document_fields", """
    SELECT event_id, event_type AS new_kind, CAST(0 AS DOUBLE) AS score, '[]' AS marks, 'x' AS origin, false AS leftovers FROM events
""")
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of schema-less documents added, set deep down, renamed and removed."""
    events = tables(spark, sf_dir, "events")["events"]
    docs = events.select(F.try_parse_json(F.to_json(F.struct("event_id", "event_type", "user_id"))).alias("doc"))
    edits = C.DocumentEdits(NOW).add("score", "number", required=True).add("marks", "array", "not json")
    docs = edits.set("meta.origin", F.lit("x")).rename("event_type", "new_kind").remove("user_id").apply(docs)
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    return docs.select(
        get("$.event_id", "bigint").alias("event_id"), get("$.new_kind", "string").alias("new_kind"),
        get("$.score", "double").alias("score"), F.to_json(get("$.marks", "variant")).alias("marks"),
        get("$.meta.origin", "string").alias("origin"),
        (get("$.user_id", "variant").isNotNull() | get("$.event_type", "variant").isNotNull()).alias("leftovers"),
    )


@query("parse_values", """
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS as_number,
      lower(event_type) = 'true' AS as_boolean, '[]' AS as_array,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS inside_object, TRY_CAST(event_type AS DOUBLE) IS NOT NULL AS numeric FROM events
""")
def parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to values, with the fallbacks of each type."""
    events = tables(spark, sf_dir, "events")["events"]
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return events.select(
        "event_id", parse_text(k, "number").alias("as_number"),
        parse_text(F.col("event_type"), "boolean").alias("as_boolean"),
        F.to_json(parse_text(F.col("event_type"), "array")).alias("as_array"),
        F.try_variant_get(parse_text(F.col("props"), "object"), "$.k", "bigint").alias("inside_object"),
        is_numeric(F.col("event_type")).alias("numeric"),
    )


@query("set_update", """
    SELECT s_suppkey, CASE WHEN s_nationkey = 3 AND s_acctbal < 5000 THEN 0 ELSE s_acctbal END AS s_acctbal,
      CASE WHEN s_nationkey = 3 AND s_acctbal < 5000 THEN NULL ELSE s_name END AS s_name FROM supplier
""")
def set_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = tables(spark, sf_dir, "supplier")["supplier"]
    out = C.update(
        supplier, {"s_nationkey": 3, "s_acctbal": {"$lt": 5000}},
        {"$set": {"s_acctbal": 0}, "$unset": {"s_name": ""}}, multi=True,
    )
    return out.select("s_suppkey", "s_acctbal", "s_name")


@query("update_first", """
    SELECT p_partkey, CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part WHERE p_type = 'PROMO') THEN 'first' ELSE p_type END AS p_type FROM part
""")
def update_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without ``multi`` only the match with the smallest key changes."""
    part = tables(spark, sf_dir, "part")["part"]
    return C.update(part, {"p_type": "PROMO"}, {"$set": {"p_type": "first"}}, key=("p_partkey",)).select("p_partkey", "p_type")


_TWICE = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)"


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which each is there twice, under a key that repeats besides."""
    lineitem = tables(spark, sf_dir, "lineitem")["lineitem"]
    return lineitem.unionAll(lineitem)


@query("update_one_repeated", f"""
    WITH first AS (SELECT min((l_orderkey, l_linenumber)) AS k FROM lineitem WHERE l_returnflag = 'R')
    SELECT l_orderkey, l_linenumber, count(*) AS rows, CAST(CASE WHEN (l_orderkey, l_linenumber) = (SELECT k FROM first) THEN 1 ELSE 0 END AS BIGINT) AS changed
    FROM {_TWICE} GROUP BY ALL
""")
def update_one_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row changes, though its key and its exact copy match as well."""
    out = C.update(_twice(spark, sf_dir), {"l_returnflag": "R"}, {"$set": {"l_linestatus": "one"}}, key=("l_orderkey", "l_linenumber"))
    return out.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("l_linestatus") == "one", 1)).alias("changed")
    )


@query("delete_one_repeated", f"""
    WITH first AS (SELECT min((l_orderkey, l_linenumber)) AS k FROM lineitem WHERE l_returnflag = 'N')
    SELECT l_orderkey, l_linenumber, count(*) - CASE WHEN (l_orderkey, l_linenumber) = (SELECT k FROM first) THEN 1 ELSE 0 END AS rows
    FROM {_TWICE} GROUP BY l_orderkey, l_linenumber
""")
def delete_one_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = C.delete(_twice(spark, sf_dir), {"l_returnflag": "N"}, many=False, key=("l_orderkey", "l_linenumber"))
    return left.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("rows"))


@query("update_rename", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
      CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS former_segment FROM customer
""")
def update_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field renamed in the matching documents only."""
    customer = tables(spark, sf_dir, "customer")["customer"]
    docs = customer.select(F.try_parse_json(F.to_json(F.struct("*"))).alias("doc"))
    out = C.update(docs, {"c_acctbal": {"$lt": 0}}, {"$rename": {"c_mktsegment": "former_segment"}}, multi=True)
    return out.select(
        F.try_variant_get("doc", "$.c_custkey", "bigint").alias("c_custkey"),
        F.try_variant_get("doc", "$.c_mktsegment", "string").alias("c_mktsegment"),
        F.try_variant_get("doc", "$.former_segment", "string").alias("former_segment"),
    )


@query("affected_rows", "SELECT count(*) AS affected FROM orders WHERE o_orderstatus = 'F'")
def affected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count rides on the action that carries out the change."""
    orders = tables(spark, sf_dir, "orders")["orders"]
    watched, seen = C.affected(orders, {"o_orderstatus": "F"})
    C.delete(watched, {"o_orderstatus": "F"}).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["affected"],)], "affected bigint")


_SOURCE = """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'new ' || p_name END AS p_name, p_size + 1 AS p_size
    FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey + 10000000, p_name, p_size FROM part WHERE p_partkey % 5 = 0
"""


def _source(part: DataFrame) -> DataFrame:
    changed = part.where("p_partkey % 2 = 0").select(
        "p_partkey", F.expr("CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'new ' || p_name END").alias("p_name"),
        (F.col("p_size") + 1).alias("p_size"),
    )
    added = part.where("p_partkey % 5 = 0").select((F.col("p_partkey") + 10000000).alias("p_partkey"), "p_name", "p_size")
    return changed.unionByName(added)


@query("upsert_part", f"""
    WITH s AS ({_SOURCE})
    SELECT coalesce(s.p_partkey, p.p_partkey) AS p_partkey, CASE WHEN s.p_partkey IS NOT NULL THEN s.p_name ELSE p.p_name END AS p_name,
      CASE WHEN s.p_partkey IS NOT NULL THEN s.p_size ELSE p.p_size END AS p_size, p.p_brand
    FROM part p FULL JOIN s ON p.p_partkey = s.p_partkey
""")
def upsert_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables(spark, sf_dir, "part")["part"]
    return C.upsert(part, _source(part), ("p_partkey",)).select("p_partkey", "p_name", "p_size", "p_brand")


@query("replace_part", f"""
    WITH s AS ({_SOURCE})
    SELECT coalesce(s.p_partkey, p.p_partkey) AS p_partkey, CASE WHEN s.p_partkey IS NOT NULL THEN s.p_name ELSE p.p_name END AS p_name,
      CASE WHEN s.p_partkey IS NOT NULL THEN NULL ELSE p.p_brand END AS p_brand
    FROM part p FULL JOIN s ON p.p_partkey = s.p_partkey
""")
def replace_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows: what the source lacks becomes NULL."""
    part = tables(spark, sf_dir, "part")["part"]
    return C.upsert(part, _source(part), ("p_partkey",), replace_row=True).select("p_partkey", "p_name", "p_brand")


@query("insert_rows", """
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CAST(NULL AS VARCHAR) AS note FROM supplier
    UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, NULL, 'customer' FROM customer
""")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "supplier", "customer")
    rows = ts["customer"].select(
        (F.col("c_custkey") + 1000000).alias("s_suppkey"), F.col("c_name").alias("s_name"),
        F.col("c_nationkey").alias("s_nationkey"), F.lit("customer").alias("note"),
    )
    return C.insert(ts["supplier"], rows)


@query("delete_many", """
    SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.quality = 1, false)
""")
def delete_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition that is NULL deletes nothing."""
    ts = tables(spark, sf_dir, "documents", "labels")
    both = ts["documents"].select("doc_id").join(ts["labels"].select("doc_id", "quality"), "doc_id", "left")
    return C.delete(both, {"quality": 1})


@query("delete_first", "SELECT o_orderkey FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')")
def delete_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables(spark, sf_dir, "orders")["orders"]
    return C.delete(orders, {"o_orderstatus": "P"}, many=False, key=("o_orderkey",)).select("o_orderkey")


@query("soft_delete", "SELECT p_partkey FROM part WHERE p_brand <> 'Brand#1'")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables(spark, sf_dir, "part")["part"]
    part = C.add_column(part, "deleted_at", "TIMESTAMPTZ")
    return C.live(C.soft_delete(part, {"p_brand": "Brand#1"}, NOW)).select("p_partkey")


_SEED = """
    SELECT s_suppkey * 2 AS id, s_name AS name FROM supplier
    UNION ALL SELECT s_suppkey * 2, s_name || ' again' FROM supplier WHERE s_suppkey % 3 = 0
"""


@query("seed_conflict", f"""
    WITH s AS (SELECT id, min(name) AS name FROM ({_SEED}) WHERE id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY id)
    SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT id, name FROM s
""")
def seed_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is taken, in the table or earlier in the seed, stay out."""
    supplier = tables(spark, sf_dir, "supplier")["supplier"]
    target = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return C.seed(target, _seed(supplier), [("id",)])[0]


def _seed(supplier: DataFrame) -> DataFrame:
    first = supplier.select((F.col("s_suppkey") * 2).alias("id"), F.col("s_name").alias("name"))
    again = supplier.where("s_suppkey % 3 = 0").select(
        (F.col("s_suppkey") * 2).alias("id"), F.concat("s_name", F.lit(" again")).alias("name")
    )
    return first.unionByName(again)


@query("seed_report", f"""
    WITH s AS ({_SEED}), n AS (SELECT count(DISTINCT id) AS inserted FROM s WHERE id NOT IN (SELECT s_suppkey FROM supplier))
    SELECT (SELECT count(*) FROM s) AS supplied, inserted, (SELECT count(*) FROM supplier) + inserted AS total FROM n
""")
def seed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = tables(spark, sf_dir, "supplier")["supplier"]
    target = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return C.seed(target, _seed(supplier), [("id",)])[1]


@query("seed_two_keys", """
    SELECT s_suppkey AS id, s_name AS name FROM supplier
    UNION ALL SELECT id, name FROM (
      SELECT c_custkey + 1000000 AS id, c_mktsegment || c_nationkey AS name,
        row_number() OVER (PARTITION BY c_mktsegment || c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1
""")
def seed_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two unique keys: the first customer of a name goes in."""
    ts = tables(spark, sf_dir, "supplier", "customer")
    target = ts["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    rows = ts["customer"].select(
        (F.col("c_custkey") + 1000000).alias("id"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name")
    )
    return C.seed(target, rows, [("id",), ("name",)], order=F.col("id"))[0]


@query("drop_with_copy", "SELECT s_suppkey, s_name, false AS still_there FROM supplier")
def drop_with_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dropped table is gone from the set and found again in its copy."""
    after, path = C.drop_table(tables(spark, sf_dir, "supplier", "nation"), "supplier", scratch_path(spark, "dropped"), NOW)
    return spark.read.parquet(path).select("s_suppkey", "s_name", F.lit("supplier" in after).alias("still_there"))


@query("migration_ledger", """
    SELECT '001_upper' AS name, TIMESTAMP '2024-06-01 12:00:00' AS applied_at, 'part := SELECT p_partkey, upper(p_name) AS p_name FROM part' AS sql_content,
      (SELECT count(DISTINCT upper(p_name)) FROM part) AS names
    UNION ALL SELECT '002_count', TIMESTAMP '2024-06-01 12:00:00', 'totals := SELECT count(*) AS parts FROM part', (SELECT count(DISTINCT upper(p_name)) FROM part)
""")
def migration_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ledger says was applied, beside a figure of the table that came of it."""
    store = M.VersionedStore(spark, scratch_path(spark, "versions"))
    store.publish({"part": tables(spark, sf_dir, "part")["part"]})
    steps = [
        M.Migration("002_count", (("totals", "SELECT count(*) AS parts FROM part"),)),
        M.Migration("001_upper", (("part", "SELECT p_partkey, upper(p_name) AS p_name FROM part"),)),
    ]
    M.apply_migrations(store, steps, datetime(2024, 6, 1, 12, tzinfo=timezone.utc))
    after = store.open()
    names = after["part"].agg(F.count_distinct("p_name")).scalar()
    return M.ledger(after).select(
        "name", F.to_timestamp_ntz(F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss")).alias("applied_at"), "sql_content", names.alias("names")
    )


@query("migrate_twice", """
    SELECT p_partkey, upper(p_name) AS p_name, p_retailprice * 2 AS doubled,
      (SELECT count(*) FROM supplier WHERE s_acctbal >= 0) AS solvent FROM part
""")
def migrate_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps run in name order and once, however often they are applied."""
    store = M.VersionedStore(spark, scratch_path(spark, "versions"))
    ts = tables(spark, sf_dir, "part", "supplier")
    store.publish({n: ts[n] for n in ts.names})
    steps = [
        M.Migration("002_double", (("part", "SELECT *, p_retailprice * 2 AS doubled FROM part"),)),
        M.Migration("001_upper", (
            ("part", "SELECT p_partkey, upper(p_name) AS p_name, p_retailprice FROM part"),
            ("supplier", "SELECT * FROM supplier WHERE s_acctbal >= 0"),
        )),
    ]
    M.apply_migrations(store, steps, NOW)
    M.apply_migrations(store, steps, NOW)
    final = store.open()
    solvent = final["supplier"].agg(F.count(F.lit(1))).scalar()
    return final["part"].select("p_partkey", "p_name", "doubled", solvent.alias("solvent"))
