"""Schema, key, reference and rule checks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.operators import change as C
from tablewarden.operators import integrity as I
from tablewarden.plans.registry import KEYS, REFERENCES, query, tables
from tablewarden.sources.tables import CASCADE, SET_NULL, Reference, TableSet

# What someone might have declared: some of it does not hold.
EXPECTED = {
    "customer": {
        "c_custkey": "BIGSERIAL PRIMARY KEY", "c_name": "VARCHAR(10) NOT NULL", "c_nationkey": "BIGINT NOT NULL",
        "c_acctbal": "DOUBLE PRECISION CHECK (c_acctbal >= 0)", "c_phone": "VARCHAR(20)",
    },
    "orders": {
        "o_orderkey": "BIGINT PRIMARY KEY", "o_custkey": "BIGINT NOT NULL REFERENCES customer(c_custkey)",
        "o_orderstatus": "CHAR(1)", "o_totalprice": "DOUBLE PRECISION DEFAULT 0 CHECK (o_totalprice > 1000)",
        "o_orderdate": "TIMESTAMP NOT NULL", "o_orderpriority": "VARCHAR(15)",
    },
    "invoices": {"id": "SERIAL PRIMARY KEY"},
}

_DRIFT = """
    SELECT 'customer' AS table_name, 'c_nationkey' AS column_name, 'type mismatch' AS issue, 'error' AS severity,
      'bigint' AS expected, 'int' AS found, (SELECT count(*) FROM customer) AS rows
    UNION ALL SELECT 'customer', 'c_phone', 'missing column', 'error', 'CHARACTER VARYING', NULL, (SELECT count(*) FROM customer)
    UNION ALL SELECT 'customer', 'c_mktsegment', 'extra column', 'warning', NULL, 'string', (SELECT count(*) FROM customer)
    UNION ALL SELECT 'invoices', NULL, 'missing table', 'error', NULL, NULL, NULL
    UNION ALL SELECT 'part', NULL, 'extra table', 'warning', NULL, NULL, (SELECT count(*) FROM part)
"""


@query("schema_drift", _DRIFT)
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.schema_drift(tables(spark, sf_dir, "customer", "orders", "part"), EXPECTED)


@query("drift_summary", f"SELECT severity, count(*) AS findings FROM ({_DRIFT}) GROUP BY ALL")
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.summary(I.schema_drift(tables(spark, sf_dir, "customer", "orders", "part"), EXPECTED))


@query("verify_environments", """
    WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o)
    SELECT 'staging' AS env, CAST(3 AS BIGINT) AS errors, CAST(1 AS BIGINT) AS warnings, false AS passed, CAST(c + o AS BIGINT) AS rows FROM n
    UNION ALL SELECT 'fixed', 0, 0, true, CAST(c + 2 * o AS BIGINT) FROM n
""")
def verify_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of tables against one declaration, with a verdict and the rows each holds."""
    ts = tables(spark, sf_dir, "customer", "orders")
    mended = (
        ts["customer"].drop("c_mktsegment").withColumn("c_phone", F.lit("none"))
        .withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))
    )
    fixed = ts.with_table("customer", mended).with_table("invoices", ts["orders"].select(F.col("o_orderkey").cast("int").alias("id")))
    environments = {"staging": ts, "fixed": fixed}
    verdicts = I.verdicts(I.verify_environments(environments, EXPECTED), list(environments))
    return verdicts.join(I.environment_rows(environments), "env")


@query("check_declared", """
    WITH c AS (SELECT count(*) AS rows FROM customer), o AS (SELECT count(*) AS rows FROM orders), r AS (
    SELECT 'customer' AS table_name, 'c_custkey not null' AS rule, count(*) FILTER (WHERE c_custkey IS NULL) AS broken, count(*) AS rows FROM customer
    UNION ALL SELECT 'customer', 'c_name not null', count(*) FILTER (WHERE c_name IS NULL), count(*) FROM customer
    UNION ALL SELECT 'customer', 'c_name length <= 10', count(*) FILTER (WHERE length(c_name) > 10), count(*) FROM customer
    UNION ALL SELECT 'customer', 'c_nationkey not null', count(*) FILTER (WHERE c_nationkey IS NULL), count(*) FROM customer
    UNION ALL SELECT 'customer', 'c_acctbal check', count(*) FILTER (WHERE c_acctbal < 0), count(*) FROM customer
    UNION ALL SELECT 'orders', 'o_orderkey not null', count(*) FILTER (WHERE o_orderkey IS NULL), count(*) FROM orders
    UNION ALL SELECT 'orders', 'o_custkey not null', count(*) FILTER (WHERE o_custkey IS NULL), count(*) FROM orders
    UNION ALL SELECT 'orders', 'o_orderstatus length <= 1', count(*) FILTER (WHERE length(o_orderstatus) > 1), count(*) FROM orders
    UNION ALL SELECT 'orders', 'o_totalprice check', count(*) FILTER (WHERE o_totalprice <= 1000), count(*) FROM orders
    UNION ALL SELECT 'orders', 'o_orderdate not null', count(*) FILTER (WHERE o_orderdate IS NULL), count(*) FROM orders
    UNION ALL SELECT 'orders', 'o_orderpriority length <= 15', count(*) FILTER (WHERE length(o_orderpriority) > 15), count(*) FROM orders)
    SELECT *, CASE WHEN broken > 0 THEN 'error' ELSE 'ok' END AS severity FROM r
""")
def check_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that follow from column declarations, one pass per table."""
    expected = {t: {c: d for c, d in EXPECTED[t].items() if c != "c_phone"} for t in ("customer", "orders")}
    return I.check_declared(tables(spark, sf_dir, "customer", "orders"), expected)


@query("check_rules", """
    SELECT *, CASE WHEN broken > 0 THEN 'error' ELSE 'ok' END AS severity FROM (
      SELECT 'part' AS table_name, 'positive price' AS rule, count(*) FILTER (WHERE NOT p_retailprice > 0) AS broken, count(*) AS rows FROM part
      UNION ALL SELECT 'part', 'small', count(*) FILTER (WHERE NOT p_size <= 25), count(*) FROM part
      UNION ALL SELECT 'lineitem', 'discount below tax', count(*) FILTER (WHERE NOT l_discount <= l_tax), count(*) FROM lineitem)
""")
def check_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.check_rules(tables(spark, sf_dir, "part", "lineitem"), {
        "part": {"positive price": "p_retailprice > 0", "small": "p_size <= 25"},
        "lineitem": {"discount below tax": "l_discount <= l_tax"},
    })


@query("check_not_null", """
    SELECT *, CASE WHEN broken > 0 THEN 'error' ELSE 'ok' END AS severity FROM (
      SELECT 'documents' AS table_name, 'quality not null' AS rule, count(*) FILTER (WHERE l.doc_id IS NULL) AS broken, count(*) AS rows
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
      UNION ALL SELECT 'documents', 'text not null', count(*) FILTER (WHERE text IS NULL), count(*) FROM documents)
""")
def check_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "documents", "labels")
    labelled = ts.with_table("documents", ts["documents"].join(ts["labels"], "doc_id", "left"))
    return I.check_not_null(labelled, {"documents": ["quality", "text"]})


def _reference_sql(ref: Reference, child: str | None = None) -> str:
    return (
        f"SELECT '{ref.name}' AS reference, count(DISTINCT c.{ref.column}) AS orphan_values, count(*) AS orphan_rows "
        f"FROM {child or ref.child} c WHERE c.{ref.column} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {ref.parent} p WHERE p.{ref.parent_column} = c.{ref.column})"
    )


_BROKEN = Reference("lineitem", "l_partkey", "orders", "o_custkey")


@query("check_references", "SELECT *, CASE WHEN orphan_rows > 0 THEN 'error' ELSE 'ok' END AS severity FROM ("
       + " UNION ALL ".join(_reference_sql(r) for r in [*REFERENCES, _BROKEN]) + ")")
def check_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declared references, and one that does not hold."""
    return I.check_references(tables(spark, sf_dir), [*REFERENCES, _BROKEN])


@query("orphans", "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "part", "nation")
    return I.orphans(ts, Reference("part", "p_size", "nation", "n_nationkey")).select("p_partkey", "p_size")


@query("unmatched_parents", """
    SELECT 'orders' AS table_name, count(*) AS unmatched FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def unmatched_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "orders", "lineitem", "documents", "labels")
    frames = [
        I.unmatched_parents(ts, r).agg(F.count(F.lit(1)).alias("unmatched")).select(F.lit(r.parent).alias("table_name"), "unmatched")
        for r in ts.references
    ]
    return frames[0].unionByName(frames[1])


def _unique_sql(table: str, key: tuple[str, ...]) -> str:
    k = ", ".join(key)
    return (
        f"SELECT '{table}' AS table_name, '{k}' AS key, count(*) AS repeated_values, "
        f"CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM "
        f"(SELECT {k}, count(*) AS n FROM {table} GROUP BY {k} HAVING count(*) > 1)"
    )


@query("check_unique", "SELECT *, CASE WHEN repeated_values > 0 THEN 'error' ELSE 'ok' END AS severity FROM ("
       + " UNION ALL ".join([_unique_sql(t, k) for t, k in sorted(KEYS.items())] + [_unique_sql("documents", ("text",))]) + ")")
def check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declared keys, and whether texts repeat."""
    ts = tables(spark, sf_dir)
    return I.check_unique(ts, {t: ts.unique_keys(t) + ([("text",)] if t == "documents" else []) for t in ts.names})


@query("check_nonempty", """
    SELECT 'labels' AS table_name, count(*) AS rows, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'warning' END AS severity FROM labels
    UNION ALL SELECT 'events', count(*), CASE WHEN count(*) > 0 THEN 'ok' ELSE 'warning' END FROM events WHERE event_type = 'refund'
    UNION ALL SELECT 'orders', count(*), CASE WHEN count(*) > 0 THEN 'ok' ELSE 'warning' END FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'invoices', NULL, 'error'
""")
def check_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.check_nonempty(tables(spark, sf_dir, "labels", "events", "orders"), {
        "labels": None, "events": "event_type = 'refund'", "orders": "o_orderstatus = 'P'", "invoices": None,
    })


_POOR = "c_acctbal < 0 AND c_mktsegment = 'BUILDING'"


@query("impact_customer", f"""
    WITH c AS (SELECT c_custkey FROM customer WHERE {_POOR}),
      o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
    SELECT 'customer' AS table_name, CAST(NULL AS VARCHAR) AS reference, CAST(NULL AS VARCHAR) AS on_delete, (SELECT count(*) FROM c) AS rows
    UNION ALL SELECT 'orders', 'orders.o_custkey->customer.c_custkey', 'CASCADE', (SELECT count(*) FROM o)
    UNION ALL SELECT 'lineitem', 'lineitem.l_orderkey->orders.o_orderkey', 'CASCADE',
      (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
""")
def impact_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.impact(tables(spark, sf_dir, "customer", "orders", "lineitem"), "customer", _POOR)


@query("dependent_rows", f"""
    SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE {_POOR})
""")
def dependent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "customer", "orders")
    return C.dependent_rows(ts, ts.references[0], _POOR).select("o_orderkey")


@query("delete_cascade_counts", f"""
    WITH c AS (SELECT * FROM customer WHERE NOT ({_POOR})), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
    SELECT 'customer' AS table_name, count(*) AS rows FROM c
    UNION ALL SELECT 'orders', count(*) FROM o
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)
""")
def delete_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = C.delete_cascade(tables(spark, sf_dir, "customer", "orders", "lineitem"), "customer", _POOR)
    frames = [after[t].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows")
              for t in ("customer", "orders", "lineitem")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("delete_set_null", """
    SELECT s_suppkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE s_nationkey END AS s_nationkey
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def delete_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of deleted nations stay, without a nation."""
    ts = tables(spark, sf_dir, "nation", "supplier")
    linked = TableSet.of(
        spark, {n: ts[n] for n in ts.names}, keys=ts.keys,
        references=[Reference("supplier", "s_nationkey", "nation", "n_nationkey", SET_NULL)],
    )
    return C.delete_cascade(linked, "nation", "n_regionkey = 2")["supplier"].select("s_suppkey", "s_nationkey")


@query("delete_self_reference", """
    WITH RECURSIVE parent AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS up FROM part),
      gone AS (SELECT id FROM parent WHERE id IN (5, 7) UNION SELECT p.id FROM parent p JOIN gone g ON p.up = g.id)
    SELECT id, up FROM parent WHERE id NOT IN (SELECT id FROM gone)
""")
def delete_self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree in one table: two branches go with all that hangs on them."""
    part = tables(spark, sf_dir, "part")["part"]
    tree = part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).cast("bigint").alias("up"),
    )
    ts = TableSet.of(spark, {"tree": tree}, keys={"tree": ("id",)}, references=[Reference("tree", "up", "tree", "id", CASCADE)])
    return C.delete_cascade(ts, "tree", "id IN (5, 7)")["tree"]
