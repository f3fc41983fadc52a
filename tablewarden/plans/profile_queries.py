"""Counts, profiles and inferred schemas of the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.operators import profile as P
from tablewarden.plans.registry import TABLES, query, tables
from tablewarden.runtime import folder_bytes, scratch_path
from tablewarden.sources.documents import read_documents, read_seed_lines, write_seed_lines
from tablewarden.sources.sinks import clone, copy_table, to_json_lines


@query("count_all", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES
) + " UNION ALL SELECT 'TOTAL', " + " + ".join(f"(SELECT count(*) FROM {t})" for t in TABLES))
def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.count_all(tables(spark, sf_dir))


@query("count_where", """
    SELECT 'sql' AS form, count(*) AS rows FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'
    UNION ALL
    SELECT 'document', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def count_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables(spark, sf_dir, "orders")["orders"]
    by_sql = P.count(orders, "o_totalprice > 100000 AND o_orderstatus = 'F'")
    by_document = P.count(
        orders, {"o_orderdate": {"$gte": "1997-01-01"}, "o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}
    )
    return by_sql.select(F.lit("sql").alias("form"), "rows").unionByName(
        by_document.select(F.lit("document").alias("form"), "rows")
    )


_STRING, _NUMBER, _DATE, _OTHER = "string", "number", "date", "other"
_SPARK = {"BIGINT": "bigint", "INT": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    rows = []
    for name, dtype in columns.items():
        kind = {"VARCHAR": _STRING, "TIMESTAMP": _DATE}.get(dtype, _NUMBER)
        length = f"length({name})" if kind == _STRING else "CAST(NULL AS INT)"
        ranged = f"CAST(%s({name}) AS VARCHAR)" if kind in (_NUMBER, _DATE) else "CAST(%s(NULL) AS VARCHAR)"
        averaged = name if kind == _NUMBER else "CAST(NULL AS DOUBLE)"
        rows.append(
            f"SELECT '{name}' AS column_name, '{_SPARK[dtype]}' AS data_type, '{kind}' AS base_type, "
            f"count(DISTINCT {name}) AS unique_values, count(*) FILTER (WHERE {name} IS NULL) AS null_count, "
            f"CAST(min({length}) AS INT) AS min_length, CAST(max({length}) AS INT) AS max_length, "
            f"round(avg({length}), 4) AS avg_length, {ranged % 'min'} AS min_value, {ranged % 'max'} AS max_value, "
            f"round(avg({averaged}), 4) AS avg_value FROM {table}"
        )
    return " UNION ALL ".join(rows)


def _rounded(profile: DataFrame) -> DataFrame:
    return profile.withColumns({c: F.round(c, 4) for c in ("avg_length", "avg_value")})


_COLUMNS = {
    "customer": {"c_custkey": "BIGINT", "c_name": "VARCHAR", "c_nationkey": "INT", "c_acctbal": "DOUBLE", "c_mktsegment": "VARCHAR"},
    "orders": {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR", "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP", "o_orderpriority": "VARCHAR"},
    "lineitem": {
        "l_orderkey": "BIGINT", "l_partkey": "BIGINT", "l_suppkey": "BIGINT", "l_linenumber": "INT",
        "l_quantity": "DOUBLE", "l_extendedprice": "DOUBLE", "l_discount": "DOUBLE", "l_tax": "DOUBLE",
        "l_returnflag": "VARCHAR", "l_linestatus": "VARCHAR", "l_shipdate": "TIMESTAMP",
    },
    "events": {"event_id": "BIGINT", "ts": "TIMESTAMP", "user_id": "BIGINT", "event_type": "VARCHAR", "value": "DOUBLE", "props": "VARCHAR"},
    "documents": {"doc_id": "BIGINT", "text": "VARCHAR", "lang": "VARCHAR", "source": "VARCHAR", "n_chars": "BIGINT"},
}


def _register_profiles() -> None:
    for table, columns in _COLUMNS.items():
        @query(f"profile_{table}", _profile_sql(table, columns))
        def run(spark: SparkSession, sf_dir: str, table: str = table) -> DataFrame:
            return _rounded(P.profile(tables(spark, sf_dir, table)[table]))


_register_profiles()


@query("profile_labelled", _profile_sql(
    "(SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    {"doc_id": "BIGINT", "quality": "INT", "toxic": "INT"},
))
def profile_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame with NULLs, since the given tables have none."""
    ts = tables(spark, sf_dir, "documents", "labels")
    return _rounded(P.profile(ts["documents"].select("doc_id").join(ts["labels"], "doc_id", "left")))


@query("profile_approximate", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{_SPARK[t]}' AS data_type, count(*) FILTER (WHERE {c} IS NULL) AS null_count, true AS near FROM lineitem"
    for c, t in _COLUMNS["lineitem"].items()
))
def profile_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched distinct counts, one pass and almost no shuffle, and whether they are near the exact ones.

    The sketch's relative standard deviation is 5 %; near is within four of them.
    """
    lineitem = tables(spark, sf_dir, "lineitem")["lineitem"]
    exact = P.profile(lineitem).select(F.col("column_name").alias("name"), F.col("unique_values").alias("exact"))
    sketched = P.profile(lineitem, exact=False).join(exact, F.col("column_name") == F.col("name"))
    near = F.abs(F.col("unique_values") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.2 * F.col("exact"))
    return sketched.select("column_name", "data_type", "null_count", near.alias("near"))


def event_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested schema-less documents; some fields are not in all of them."""
    events = tables(spark, sf_dir, "events")["events"]
    purchase = F.col("event_type") == "purchase"
    text = F.to_json(F.struct(
        F.col("event_id").alias("_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"),
        F.when(purchase, F.struct(F.array(F.struct(F.col("value").alias("price"), F.col("event_type").alias("sku"))).alias("lines"))).alias("cart"),
        F.array("event_type", F.lit("x")).alias("tags"),
    ))
    return events.select(F.try_parse_json(text).alias("doc"))


_N = "(SELECT count(*) FROM events)"


@query("profile_collection", f"""
    WITH e AS (SELECT * FROM events), p AS (SELECT * FROM events WHERE event_type = 'purchase')
    SELECT 'kind' AS field, 'string' AS common_type, 'string' AS types, count(*) AS present, 100.0::DOUBLE AS presence_pct,
      count(DISTINCT event_type) AS unique_values, CAST(0 AS BIGINT) AS null_count,
      CAST(min(length(event_type)) AS INT) AS min_length, CAST(max(length(event_type)) AS INT) AS max_length,
      round(avg(length(event_type)), 4) AS avg_length, CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value,
      CAST(NULL AS DOUBLE) AS avg_value, CAST(NULL AS INT) AS min_items, CAST(NULL AS INT) AS max_items, CAST(NULL AS DOUBLE) AS avg_items FROM e
    UNION ALL SELECT 'user', 'number', 'number', count(*), 100.0, count(DISTINCT user_id), 0, NULL, NULL, NULL,
      CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE), round(avg(user_id), 4), NULL, NULL, NULL FROM e
    UNION ALL SELECT 'cart', 'object', 'object', count(*), round(count(*) * 100.0 / {_N}, 2), count(DISTINCT value), 0,
      NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p
    UNION ALL SELECT 'tags', 'array', 'array', count(*), 100.0, count(DISTINCT event_type), 0,
      NULL, NULL, NULL, NULL, NULL, NULL, 2, 2, 2.0 FROM e
""")
def profile_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.profile_documents(event_collection(spark, sf_dir)).drop("min_date", "max_date")
    return out.withColumns({c: F.round(c, 4) for c in ("avg_length", "avg_value", "avg_items")})


@query("profile_documents_props", f"""
    SELECT 'k' AS field, 'number' AS common_type, 'number' AS types, count(*) AS present,
      100.0::DOUBLE AS presence_pct, count(DISTINCT json_extract_string(props, '$.k')) AS unique_values,
      min(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS min_value,
      max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS max_value,
      round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS avg_value
    FROM events
""")
def profile_documents_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "events")["events"].select(F.try_parse_json("props").alias("doc"))
    return P.profile_documents(docs).select(
        "field", "common_type", "types", "present", "presence_pct", "unique_values",
        "min_value", "max_value", F.round("avg_value", 4).alias("avg_value"),
    )


@query("infer_fields_nested", f"""
    WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events)
    SELECT '_id' AS path, 'number' AS types, n AS documents, 100.0::DOUBLE AS presence_pct FROM n
    UNION ALL SELECT 'kind', 'string', n, 100.0 FROM n
    UNION ALL SELECT 'user', 'number', n, 100.0 FROM n
    UNION ALL SELECT 'tags', 'array(string)', n, 100.0 FROM n
    UNION ALL SELECT 'cart', 'object', p, round(p * 100.0 / n, 0) FROM n
    UNION ALL SELECT 'cart.lines', 'array(object)', p, round(p * 100.0 / n, 0) FROM n
    UNION ALL SELECT 'cart.lines[*].price', 'number', p, round(p * 100.0 / n, 0) FROM n
    UNION ALL SELECT 'cart.lines[*].sku', 'string', p, round(p * 100.0 / n, 0) FROM n
""")
def infer_fields_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.infer_fields(event_collection(spark, sf_dir))


@query("infer_fields_props", """
    SELECT 'k' AS path, 'number' AS types, count(*) AS documents, 100.0::DOUBLE AS presence_pct FROM events
""")
def infer_fields_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "events")["events"].select(F.try_parse_json("props").alias("doc"))
    return P.infer_fields(docs)


@query("infer_fields_long_arrays", """
    SELECT 'user' AS path, 'number' AS types, count(DISTINCT user_id) AS documents FROM events
    UNION ALL SELECT 'seen', 'array(number), array(object)', count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'seen[*].' || event_type, 'number', count(DISTINCT user_id) FROM events GROUP BY event_type
""")
def infer_fields_long_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per user with all their events: fields that only late elements of an array have."""
    events = tables(spark, sf_dir, "events")["events"]
    seen = F.to_json(F.create_map("event_type", "event_id"))
    per_user = events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(seen)), ",").alias("all"))
    text = F.concat(F.lit('{"user":'), F.col("user_id"), F.lit(',"seen":[7,'), F.col("all"), F.lit("]}"))
    return P.infer_fields(per_user.select(F.try_parse_json(text).alias("doc"))).select("path", "types", "documents")


@query("infer_fields_id_keys", """
    SELECT 'seen' AS path, 'object' AS types, count(*) AS documents FROM events
    UNION ALL SELECT 'seen.{*}', 'number, object', count(*) FROM events
    UNION ALL SELECT 'seen.{*}.' || event_type, 'number', count(*) FROM events GROUP BY event_type
""")
def infer_fields_id_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose keys are the ids of users and times: one path, not one for each id."""
    events = tables(spark, sf_dir, "events")["events"]
    inner = F.to_json(F.create_map("event_type", "event_id"))
    text = F.concat(
        F.lit('{"seen":{"'), F.col("user_id"), F.lit('":'), inner,
        F.lit(',"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('":'), F.col("event_id"), F.lit("}}"),
    )
    return P.infer_fields(events.select(F.try_parse_json(text).alias("doc"))).select("path", "types", "documents")


@query("infer_fields_wide_objects", """
    SELECT 'by' AS path, 'object' AS types, count(*) AS documents FROM customer
    UNION ALL SELECT 'by.{*}', 'object', count(*) FROM customer
    UNION ALL SELECT 'by.{*}.' || lower(c_mktsegment), 'number', count(*) FROM customer GROUP BY c_mktsegment
""")
def infer_fields_wide_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose keys are names of customers, which only their number gives away."""
    customers = tables(spark, sf_dir, "customer")["customer"]
    inner = F.to_json(F.create_map(F.lower("c_mktsegment"), "c_acctbal"))
    text = F.concat(F.lit('{"by":{"'), F.col("c_name"), F.lit('":'), inner, F.lit("}}"))
    docs = customers.select(F.try_parse_json(text).alias("doc"))
    return P.infer_fields(docs, most_names=50).select("path", "types", "documents")


@query("first_document_fields", """
    SELECT 'user' AS path, 'number' AS types, CAST(1 AS BIGINT) AS documents FROM events WHERE event_id = (SELECT min(event_id) FROM events)
    UNION ALL SELECT 'kind', 'string', 1 FROM events WHERE event_id = (SELECT min(event_id) FROM events)
    UNION ALL SELECT '_id', 'number', 1 FROM events WHERE event_id = (SELECT min(event_id) FROM events)
""")
def first_document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first document has, of a collection in which all are alike."""
    events = tables(spark, sf_dir, "events")["events"]
    text = F.to_json(F.struct(F.col("event_id").alias("_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    docs = events.orderBy("event_id").select(F.try_parse_json(text).alias("doc"))
    return P.first_document_fields(docs).select("path", "types", "documents")


@query("inventory_bytes", """
    SELECT 'orders' AS table_name, count(*) AS rows, true AS sizes_agree FROM orders
    UNION ALL SELECT 'events', count(*), true FROM events
""")
def inventory_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the files behind a table, against what the file system says."""
    ts = tables(spark, sf_dir, "orders", "events")
    sizes = [(n, folder_bytes(spark, f"{sf_dir}/{n}.parquet")) for n in ts.names]
    on_disk = spark.createDataFrame(sizes, "name string, size bigint")
    listed = P.inventory(ts).join(on_disk, F.col("table_name") == F.col("name"))
    agree = (F.col("bytes") == F.col("size")) & (F.round(F.col("size") / F.col("rows"), 2) == F.col("avg_row_bytes"))
    return listed.select("table_name", "rows", agree.alias("sizes_agree"))


@query("inventory", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({w} AS INT) AS columns, count(*) AS rows FROM {t}"
    for t, w in {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
                 "events": 6, "documents": 5, "labels": 3, "benchmark": 2, "pages": 3, "conversations": 4,
                 "embeddings": 3}.items()
))
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.inventory(tables(spark, sf_dir)).select("table_name", "columns", "rows")


@query("collection_stats", """
    SELECT count(*) AS documents, CAST(sum(length(replace(props, ' ', ''))) AS BIGINT) AS total_size,
      round(avg(length(replace(props, ' ', ''))), 4) AS avg_size FROM events
""")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "events")["events"].select(F.try_parse_json("props").alias("doc"))
    return P.collection_stats(docs).withColumn("avg_size", F.round("avg_size", 4))


@query("observed_columns", " UNION ALL ".join(
    f"SELECT CAST({i + 1} AS INT) AS position, '{c}' AS column_name, '{_SPARK[t]}' AS data_type, "
    + {"l_orderkey": "'orders.o_orderkey'", "l_partkey": "'part.p_partkey'", "l_suppkey": "'supplier.s_suppkey'"}.get(c, "CAST(NULL AS VARCHAR)")
    + f' AS "references", count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) FILTER (WHERE {c} IS NULL) > 0 AS nullable, '
    f"count(DISTINCT {c}) AS unique_values, (count(*) FILTER (WHERE {c} IS NULL) = 0 AND count(DISTINCT {c}) = count(*)) AS key_candidate FROM lineitem"
    for i, (c, t) in enumerate(_COLUMNS["lineitem"].items())
))
def observed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.observed_columns(tables(spark, sf_dir, "lineitem", "orders", "part", "supplier"), "lineitem")


@query("table_copies", """
    SELECT 'copy' AS kind, 'part' AS table_name, count(*) AS rows FROM part
    UNION ALL SELECT 'clone', 'supplier', count(*) FROM supplier
    UNION ALL SELECT 'clone', 'customer', count(*) FROM customer
""")
def table_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated copy of one table and a clone of others, counted again."""


    ts, here = tables(spark, sf_dir, "part", "supplier", "customer"), scratch_path(spark, "copies")
    path = copy_table(ts, "part", here, datetime(2024, 1, 1))
    copied = P.count(spark.read.parquet(path)).select(F.lit("copy").alias("kind"), F.lit("part").alias("table_name"), "rows")
    cloned = P.count_all(clone(ts.only("supplier", "customer"), f"{here}/clone"), total=False)
    return copied.unionByName(cloned.select(F.lit("clone").alias("kind"), "table_name", "rows"))


@query("seed_file", "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def seed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as a seed, one JSON object a line, and read back."""
    path = scratch_path(spark, "seed")
    supplier = tables(spark, sf_dir, "supplier")["supplier"].select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))
    write_seed_lines(supplier, path)
    return read_seed_lines(spark, path, supplier.schema)


@query("json_documents", """
    SELECT doc_id, lang, n_chars, length(text) AS text_length FROM documents
""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines and read back as schema-less documents."""
    path = scratch_path(spark, "json-lines")
    to_json_lines(tables(spark, sf_dir, "documents")["documents"], path)
    doc = read_documents(spark, path)
    return doc.select(
        F.try_variant_get("doc", "$.doc_id", "bigint").alias("doc_id"),
        F.try_variant_get("doc", "$.lang", "string").alias("lang"),
        F.try_variant_get("doc", "$.n_chars", "bigint").alias("n_chars"),
        F.length(F.try_variant_get("doc", "$.text", "string")).alias("text_length"),
    )
