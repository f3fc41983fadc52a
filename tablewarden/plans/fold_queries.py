"""Change folds, text index and clustered layout over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.operators import folds as L
from tablewarden.operators import layout as N
from tablewarden.plans.registry import query, tables
from tablewarden.runtime import scratch_path

CREDITS_SQL = """
    WITH c AS (SELECT user_id, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, round(sum(value), 2) AS credits FROM c
    WHERE event_type = 'purchase' AND (before IS NULL OR before <> 'purchase') GROUP BY user_id
"""


@query("fold_credits", CREDITS_SQL)
def fold_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: a change into purchase adds its value."""
    events = tables(spark, sf_dir, "events")["events"]
    out = L.fold_credits(events, "user_id", ["ts", "event_id"], "event_type", "value", "user_id", done="purchase")
    return out.select("user_id", F.round("credits", 2).alias("credits"))


@query("fold_referrals", """
    WITH r AS (SELECT event_id AS id, user_id AS referred_id, ts AS created_at,
        CASE WHEN event_id % 10 = 0 THEN 'completed' ELSE 'pending' END AS status, event_id % 7 = 0 AS bonus_awarded
        FROM events WHERE event_type = 'signup'),
      b AS (SELECT * FROM events WHERE event_type = 'purchase' AND value > 20),
      m AS (SELECT r.id, min((b.ts, b.event_id)) AS buy FROM r JOIN b ON b.user_id = r.referred_id AND b.ts >= r.created_at
        WHERE r.status = 'pending' AND NOT r.bonus_awarded GROUP BY r.id)
    SELECT r.id, r.referred_id, CASE WHEN m.id IS NOT NULL THEN 'completed' ELSE r.status END AS status,
      CASE WHEN m.id IS NOT NULL THEN true ELSE r.bonus_awarded END AS bonus_awarded, m.buy[1] AS date_activated, m.buy[2] AS first_purchase_id
    FROM r LEFT JOIN m ON r.id = m.id
""")
def fold_referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as referrals, purchases as the changes that close them."""
    events = tables(spark, sf_dir, "events")["events"]
    referrals = events.where("event_type = 'signup'").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("referred_id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 10 == 0, "completed").otherwise("pending").alias("status"),
        (F.col("event_id") % 7 == 0).alias("bonus_awarded"),
        F.lit(None).cast("timestamp_ntz").alias("date_activated"), F.lit(None).cast("bigint").alias("first_purchase_id"),
    )
    changes = events.select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("transaction_at"), F.lit("completed").alias("status"),
        F.col("event_type").alias("type"), (F.col("value") - 20).alias("credits"),
    )
    return L.fold_referrals(referrals, changes).drop("created_at")


@query("fold_views", "SELECT user_id, count(*) AS view_count FROM events GROUP BY ALL")
def fold_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No update brings a value, so each adds one."""
    events = tables(spark, sf_dir, "events")["events"].withColumn("views", F.lit(None).cast("bigint"))
    return L.fold_views(events, "user_id", ["ts", "event_id"], "views")


VIEWS_SQL = """
    WITH RECURSIVE e AS (SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE CAST(floor(value) AS BIGINT) % 4 END AS v,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(2 AS BIGINT) AS c FROM e
        UNION ALL SELECT s.user_id, e.rn, CASE WHEN e.v IS NULL OR e.v = s.c THEN s.c + 1 ELSE e.v END
        FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
    SELECT user_id, arg_max(c, rn) AS view_count FROM s GROUP BY user_id
"""


@query("fold_views_mixed", VIEWS_SQL)
def fold_views_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some updates bring a value, which may be the one that is stored."""
    events = tables(spark, sf_dir, "events")["events"]
    value = F.when(~F.col("event_type").isin("view", "click"), F.floor("value").cast("bigint") % 4)
    return L.fold_views(events.withColumn("views", value), "user_id", ["ts", "event_id"], "views", start=2)


@query("fold_credits_daily", """
    WITH c AS (SELECT user_id, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) AS before FROM events)
    SELECT user_id, round(sum(value), 2) AS credits FROM c
    WHERE event_type = 'purchase' AND (before IS NULL OR before <> 'purchase') GROUP BY user_id
""")
def fold_credits_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that knows the day only: within a day the number of the event decides, and cuts the day."""
    events = tables(spark, sf_dir, "events")["events"].withColumn("day", F.to_date("ts"))
    out = L.fold_credits(events, "user_id", ["day", "event_id"], "event_type", "value", "user_id", done="purchase", segments=64)
    return out.select("user_id", F.round("credits", 2).alias("credits"))


@query("fold_updated_at", "SELECT user_id, max(ts) AS updated_at FROM events GROUP BY ALL")
def fold_updated_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fold_updated_at(tables(spark, sf_dir, "events")["events"], "user_id", "ts")


@query("unique_index", """
    SELECT 'orders' AS table_name, 'o_orderkey' AS key, count(*) = count(DISTINCT o_orderkey) AS possible FROM orders
    UNION ALL SELECT 'orders', 'o_custkey', count(*) = count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'events', 'event_id', count(*) = count(DISTINCT event_id) FROM events
""")
def unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a unique index could be put on a key."""
    ts = tables(spark, sf_dir, "orders", "events")
    asked = [("orders", "o_orderkey"), ("orders", "o_custkey"), ("events", "event_id")]
    return spark.createDataFrame(
        [(t, k, N.unique_index_ok(ts[t], (k,))) for t, k in asked], "table_name string, key string, possible boolean"
    )


_TERMS = "(SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents)"


@query("text_index", f"SELECT term, doc_id AS key, count(*) AS tf FROM {_TERMS} WHERE term <> '' GROUP BY ALL")
def text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.build_text_index(tables(spark, sf_dir, "documents")["documents"], "doc_id", ["text"])


@query("text_index_topterms", f"""
    SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM {_TERMS} WHERE term <> ''
    GROUP BY term ORDER BY occurrences DESC, term LIMIT 50
""")
def text_index_topterms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report over the index."""
    index = N.build_text_index(tables(spark, sf_dir, "documents")["documents"], "doc_id", ["text"])
    return index.groupBy("term").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences")
    ).orderBy(F.desc("occurrences"), "term").limit(50)


@query("text_lookup", f"""
    SELECT doc_id AS key, count(DISTINCT term) AS terms, count(*) AS score FROM {_TERMS} WHERE term IN ('the', 'and', 'on')
    GROUP BY doc_id HAVING count(DISTINCT term) = 3
""")
def text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a stored index, of which only files with the terms are read."""
    path = scratch_path(spark, "text-index")
    documents = tables(spark, sf_dir, "documents")["documents"]
    N.write_text_index(N.build_text_index(documents, "doc_id", ["text"]), path)
    return N.text_lookup(spark.read.parquet(path), ["The", "and", "on"], every=True)


@query("clustered_lookup", """
    SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-02-01' AND l_discount > 0.02
""")
def clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial, clustered copy; the filter on the date then skips files."""
    path = scratch_path(spark, "clustered")
    lineitem = tables(spark, sf_dir, "lineitem")["lineitem"]
    N.cluster(lineitem, ["l_shipdate"], where="l_discount > 0.02").write.parquet(path)
    january = spark.read.parquet(path).where("l_shipdate >= '1998-01-01' AND l_shipdate < '1998-02-01'")
    return january.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
