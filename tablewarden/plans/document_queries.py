"""Document-style find, group, lookup, and SQL, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.operators import documents as D
from tablewarden.plans.registry import query, tables


@query("find_orders", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice >= 100000 AND o_totalprice < 300000 AND o_orderstatus IN ('F', 'P')
      AND (o_orderpriority = '1-URGENT' OR o_custkey > 500) AND o_orderstatus <> 'O'
""")
def find_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.find(
        tables(spark, sf_dir, "orders")["orders"],
        {
            "o_totalprice": {"$gte": 100000, "$lt": 300000}, "o_orderstatus": {"$in": ["F", "P"], "$ne": "O"},
            "$or": [{"o_orderpriority": "1-URGENT"}, {"o_custkey": {"$gt": 500}}],
        },
        projection={"o_orderkey": 1, "o_totalprice": 1},
    )


@query("find_top", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def find_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: sort and limit become one operator."""
    return D.find(
        tables(spark, sf_dir, "orders")["orders"], {"o_orderstatus": "F"},
        projection={"o_orderkey": 1, "o_custkey": 1, "o_totalprice": 1},
        sort={"o_totalprice": -1, "o_orderkey": 1}, limit=100,
    )


@query("find_regex_exists", """
    SELECT doc_id, lang FROM (SELECT d.*, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    WHERE regexp_matches(lang, '^(EN|FR)', 'i') AND quality IS NOT NULL
    UNION ALL
    SELECT doc_id, 'unlabelled' FROM (SELECT d.*, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    WHERE quality IS NULL
""")
def find_regex_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "documents", "labels")
    both = ts["documents"].join(ts["labels"], "doc_id", "left")
    seen = D.find(
        both, {"lang": {"$regex": "^(EN|FR)", "$options": "i"}, "quality": {"$exists": True}},
        projection={"doc_id": 1, "lang": 1},
    )
    unseen = D.find(both, {"quality": None}, projection={"doc_id": 1, "lang": {"$ifNull": [None, "unlabelled"]}})
    return seen.unionByName(unseen)


@query("find_documents", """
    SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events
    WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90 GROUP BY ALL
""")
def find_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter documents over schema-less JSON."""
    docs = tables(spark, sf_dir, "events")["events"].select(F.try_parse_json("props").alias("doc"))
    found = D.find(docs, {"k": {"$gte": 90}})
    return found.groupBy(F.try_variant_get("doc", "$.k", "bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("project_nested", "SELECT c_custkey AS _id, c_name AS title, c_mktsegment AS segment FROM customer")
def project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = tables(spark, sf_dir, "customer")["customer"].select(
        F.col("c_custkey").alias("_id"), F.struct("c_name", F.struct("c_mktsegment").alias("market")).alias("customer")
    )
    return D.project(nested, {"title": "$customer.c_name", "segment": "$customer.market.c_mktsegment"})


@query("group_count", "SELECT o_orderstatus AS _id, count(*) AS count FROM orders GROUP BY ALL")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.group(tables(spark, sf_dir, "orders")["orders"], "$o_orderstatus", {"count": {"$sum": 1}})


@query("group_sum_sorted", """
    SELECT o_custkey AS _id, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY ALL
""")
def group_sum_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.pipeline(tables(spark, sf_dir, "orders"), "orders", [
        {"$match": {"o_orderdate": {"$gte": "1996-01-01"}}},
        {"$group": {"_id": "$o_custkey", "total": {"$sum": "$o_totalprice"}}},
        {"$sort": {"total": -1}},
    ])
    return out.withColumn("total", F.round("total", 2))


@query("group_global_avg", """
    SELECT CAST(NULL AS VARCHAR) AS _id, round(avg(l_extendedprice), 4) AS avg_amount,
      round(sum(l_extendedprice), 2) AS total_amount, count(*) AS line_count,
      min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem
""")
def group_global_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.group(tables(spark, sf_dir, "lineitem")["lineitem"], None, {
        "avg_amount": {"$avg": "$l_extendedprice"}, "total_amount": {"$sum": "$l_extendedprice"},
        "line_count": {"$sum": 1}, "least": {"$min": "$l_quantity"}, "most": {"$max": "$l_quantity"},
    })
    return out.withColumns({"avg_amount": F.round("avg_amount", 4), "total_amount": F.round("total_amount", 2)})


@query("group_composite_key", """
    SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity * 2), 2) AS doubled FROM lineitem GROUP BY ALL
""")
def group_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.pipeline(tables(spark, sf_dir, "lineitem"), "lineitem", [
        {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"},
                    "doubled": {"$sum": {"$multiply": ["$l_quantity", 2]}}}},
        {"$project": {"_id": 0, "flag": "$_id.flag", "status": "$_id.status", "doubled": 1}},
    ])
    return out.withColumn("doubled", F.round("doubled", 2))


@query("lookup_unwind", """
    SELECT o_orderkey, o_totalprice, c_mktsegment AS segment, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey
""")
def lookup_unwind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup and unwind in sequence: a plain join, no arrays."""
    return D.pipeline(tables(spark, sf_dir, "orders", "customer"), "orders", [
        {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "buyer"}},
        {"$unwind": "$buyer"},
        {"$project": {"o_orderkey": 1, "o_totalprice": 1, "segment": "$buyer.c_mktsegment", "balance": "$buyer.c_acctbal"}},
    ])


@query("lookup_array_size", """
    SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL
""")
def lookup_array_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the size is asked for: matches are counted before the join."""
    return D.pipeline(tables(spark, sf_dir, "orders", "customer"), "customer", [
        {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "found"}},
        {"$project": {"c_custkey": 1, "orders": {"$size": "$found"}}},
    ])


@query("lookup_array", """
    SELECT o_orderkey, count(l_orderkey) AS lines, coalesce(round(sum(l_quantity), 2), 0) AS quantity
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
""")
def lookup_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines, one row per match, and orders without any."""
    ts = tables(spark, sf_dir, "orders", "lineitem")
    matches = D.lookup_rows(ts["orders"], ts["lineitem"], "o_orderkey", "l_orderkey", "line", keep_empty=True)
    return matches.groupBy("o_orderkey").agg(
        F.count("line").alias("lines"), F.coalesce(F.round(F.sum("line.l_quantity"), 2), F.lit(0.0)).alias("quantity")
    )


@query("lookup_count", """
    SELECT (SELECT count(*) FROM region) AS all_regions, (SELECT count(*) FROM region r WHERE EXISTS (
      SELECT 1 FROM lineitem WHERE CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 7 END = r_regionkey AND l_quantity > 49)) AS busy_regions
""")
def lookup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the lines belong to one region: what is counted are regions, however many matches each has."""
    ts = tables(spark, sf_dir, "region", "lineitem")
    place = F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_orderkey") % 7).cast("int")
    ts = ts.with_table("lineitem", ts["lineitem"].withColumn("region", place))
    look = {"$lookup": {"from": "lineitem", "localField": "r_regionkey", "foreignField": "region", "as": "sold"}}
    every = D.pipeline(ts, "region", [look, {"$count": "all_regions"}])
    busy = D.pipeline(ts, "region", [look, {"$match": {"sold.l_quantity": {"$gt": 49}}}, {"$count": "busy_regions"}])
    return every.select("all_regions", busy.select("busy_regions").scalar().alias("busy_regions"))


@query("unwind_words", """
    SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL
""")
def unwind_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables(spark, sf_dir, "part")["part"].select(F.split("p_name", " ").alias("word"))
    return D.unwind(part, "$word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_TOP = """
    SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS spent
    FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
    GROUP BY c.c_custkey, c.c_name ORDER BY orders DESC, c.c_custkey LIMIT 10
"""


@query("sql_join_topk", _TOP)
def sql_join_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "customer", "orders").sql(_TOP)


_RICH = """
    SELECT n_regionkey, n_name, count(*) AS rich FROM nation JOIN customer ON n_nationkey = c_nationkey
    WHERE c_acctbal > 9000 GROUP BY n_regionkey, n_name
"""


@query("sql_ordered_strings", f"""
    SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations, CAST(sum(rich) AS BIGINT) AS customers
    FROM ({_RICH}) GROUP BY n_regionkey
""")
def sql_ordered_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered string aggregate in SQL, over one row per nation."""
    return tables(spark, sf_dir, "nation", "customer").sql(f"""
        SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations, sum(rich) AS customers
        FROM ({_RICH}) GROUP BY n_regionkey
    """)
