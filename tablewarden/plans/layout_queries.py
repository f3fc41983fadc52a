"""Layouts, versions, sketches and ranked text over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.operators import layout as N, profile as P
from tablewarden.operators.ranges import diff_versions, write_version
from tablewarden.operators.sketches import add_part, merged_profile
from tablewarden.plans.registry import query, tables
from tablewarden.runtime import scratch_path


@query("curve_lookup", "SELECT event_id, user_id, value FROM events WHERE value >= 50 AND value < 60")
def curve_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events along a curve over user and value: a filter on the value alone skips files, as one on the user does."""
    path = scratch_path(spark, "curve")
    N.cluster_curve(tables(spark, sf_dir, "events")["events"], ["user_id", "value"]).write.parquet(path)
    return spark.read.parquet(path).where("value >= 50 AND value < 60").select("event_id", "user_id", "value")


@query("hash_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_partkey = 77")
def hash_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part in rows of any order, through Bloom filters."""
    path = scratch_path(spark, "hashed")
    N.write_hash_index(tables(spark, sf_dir, "lineitem")["lineitem"], path, ["l_partkey"])
    return spark.read.parquet(path).where("l_partkey = 77").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("bucket_join", """
    SELECT o_orderpriority, count(*) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS numbers
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority
""")
def bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines in buckets of the order: the join needs no shuffle."""
    ts, run = tables(spark, sf_dir, "orders", "lineitem"), uuid.uuid4().hex
    buckets = max(4, N.files_for(ts["lineitem"]))
    orders = N.write_buckets(ts["orders"].select("o_orderkey", "o_orderpriority"), f"orders_{run}", scratch_path(spark, "buckets"), ["o_orderkey"], buckets)
    lines = N.write_buckets(ts["lineitem"].select("l_orderkey", "l_linenumber"), f"lines_{run}", scratch_path(spark, "buckets"), ["l_orderkey"], buckets)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_linenumber").alias("numbers"))


@query("diff_versions", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 1 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 1000 IN (1, 2)
    UNION ALL SELECT o_orderkey + 100000000, 'added' FROM orders WHERE o_orderkey % 1000 = 3
""")
def versions_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two written versions of the orders; ranges of the key's hash with equal digests are not read."""
    orders, here = tables(spark, sf_dir, "orders")["orders"], scratch_path(spark, "versions")
    rest = F.col("o_orderkey") % 1000
    after = orders.where(rest != 1).withColumn("o_orderpriority", F.when(rest != 2, F.col("o_orderpriority")))
    after = after.unionByName(orders.where(rest == 3).withColumn("o_orderkey", F.col("o_orderkey") + 100000000))
    write_version(orders, f"{here}/before", ("o_orderkey",))
    write_version(after, f"{here}/after", ("o_orderkey",))
    return diff_versions(spark, f"{here}/before", f"{here}/after", ("o_orderkey",))


_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]


@query("profile_sketched", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, "
    "true AS distinct_close, true AS median_close FROM lineitem" for c in _NUMBERS
))
def profile_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines sketched in four parts, as they would be added, and merged; close means within 3 % of the exact count, or of the rank."""
    lines, path = tables(spark, sf_dir, "lineitem")["lineitem"].select(*_NUMBERS), scratch_path(spark, "sketches")
    for n in range(4):
        add_part(lines.where(F.col("l_orderkey") % 4 == n), path, str(n))
    exact = P.distinct_counts(lines).select(F.col("column_name").alias("column"), "unique_values")
    merged = merged_profile(spark, path, (0.47, 0.53))
    medians = P.exact_medians(lines).withColumnRenamed("column_name", "column")
    # one row per column on every side; a column without values has no median
    joined = merged.join(exact, "column").join(medians, "column", "left")
    close = F.abs(F.col("distinct") - F.col("unique_values")) <= 0.03 * F.col("unique_values")
    within = F.col("median").between(F.col("quantiles")[0], F.col("quantiles")[1])
    return joined.select(F.col("column").alias("column_name"), "rows", "nulls", "low", "high", close.alias("distinct_close"), within.alias("median_close"))


_WORDS = r"SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents"


def _positions(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "positions")
    N.write_positions(tables(spark, sf_dir, "documents")["documents"], path, "doc_id", ["text"])
    return path


@query("text_phrase", f"""
    SELECT * FROM (SELECT doc_id AS key, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS occurrences FROM ({_WORDS}))
    WHERE occurrences > 0
""")
def text_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two words one after the other, through an index with positions."""
    return N.phrase_lookup(spark, _positions(spark, sf_dir), "Of the")


@query("text_ranked", f"""
    WITH d AS ({_WORDS}), t AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d),
    tf AS (SELECT doc_id, length, term, count(*) AS tf FROM t WHERE term IN ('license', 'token', 'the') GROUP BY ALL),
    n AS (SELECT term, count(*) AS n FROM tf GROUP BY term), s AS (SELECT count(*) AS docs, avg(len(w)) AS usual FROM d)
    SELECT doc_id AS key, count(*) AS terms, round(sum(ln(1 + (docs - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / usual))), 6) AS score
    FROM tf JOIN n USING (term), s GROUP BY doc_id
""")
def text_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any of some words, with a score that knows rare words and long documents."""
    found = N.ranked_lookup(spark, _positions(spark, sf_dir), ["license", "token", "the"])
    return found.withColumn("score", F.round("score", 6))


@query("observed_references", """
    WITH v AS (SELECT 'l_orderkey' AS c, l_orderkey AS v FROM lineitem UNION SELECT 'l_partkey', l_partkey FROM lineitem
        UNION SELECT 'l_suppkey', l_suppkey FROM lineitem UNION SELECT 'l_linenumber', l_linenumber FROM lineitem),
    p AS (SELECT 'orders.o_orderkey' AS p, o_orderkey AS v FROM orders UNION ALL SELECT 'part.p_partkey', p_partkey FROM part UNION ALL SELECT 'supplier.s_suppkey', s_suppkey FROM supplier),
    k AS (SELECT c, count(*) AS n FROM v GROUP BY c),
    f AS (SELECT c, p FROM v JOIN p USING (v) GROUP BY c, p HAVING count(*) = (SELECT n FROM k WHERE k.c = v.c))
    SELECT c AS column_name, string_agg(p, ';' ORDER BY p) AS "references" FROM f GROUP BY c
""")
def observed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the columns of the lines can refer to by what they hold."""
    seen = P.observed_columns(tables(spark, sf_dir, "lineitem", "orders", "part", "supplier"), "lineitem", discover=True)
    return seen.where("references IS NOT NULL").select("column_name", "references")
