"""Value search over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.operators import search as S
from tablewarden.operators.trigrams import indexed_search, write_trigram_index
from tablewarden.plans.registry import hits_sql, key_sql, query, tables
from tablewarden.runtime import scratch_path
from tablewarden.sources.sinks import export_csv
from tablewarden.sources.tables import TableSet


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("table_name", "row_key", F.array_join("matching_columns", ";").alias("matching_columns"))


def _text(column: str, value: str) -> str:
    return f"contains(lower({column}), '{value}')"


def _date(column: str, value: str) -> str:
    return f"contains(CAST({column} AS VARCHAR), '{value}')"


def _number(columns: str, value: str) -> dict[str, str]:
    return {c: f"{c} = {value}" for c in columns.split()}


def _substring_sql(value: str) -> str:
    """Every table, every searchable column, in the order of the columns."""
    t = lambda *cs: {c: _text(c, value) for c in cs}
    n = lambda cs: _number(cs, value)
    per_table = {
        "region": n("r_regionkey") | t("r_name"),
        "nation": n("n_nationkey") | t("n_name") | n("n_regionkey"),
        "customer": n("c_custkey") | t("c_name") | n("c_nationkey c_acctbal") | t("c_mktsegment"),
        "supplier": n("s_suppkey") | t("s_name") | n("s_nationkey s_acctbal"),
        "part": n("p_partkey") | t("p_name", "p_brand", "p_type") | n("p_size p_retailprice"),
        "orders": n("o_orderkey o_custkey") | t("o_orderstatus") | n("o_totalprice")
        | {"o_orderdate": _date("o_orderdate", value)} | t("o_orderpriority"),
        "lineitem": n("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax")
        | t("l_returnflag", "l_linestatus") | {"l_shipdate": _date("l_shipdate", value)},
        "events": n("event_id") | {"ts": _date("ts", value)} | n("user_id") | t("event_type") | n("value")
        | t("props"),
        "documents": n("doc_id") | t("text", "lang", "source") | n("n_chars"),
        "labels": n("doc_id quality toxic"),
        "benchmark": n("item_id") | t("text"),
        "pages": n("page_id") | t("url", "html"),
        "conversations": n("conv_id turn") | t("role", "text"),
        "embeddings": n("vec_id")
        | {"embedding": f"list_contains(embedding, CAST({value} AS FLOAT))"} | n("label"),
    }
    return " UNION ALL ".join(hits_sql(name, c) for name, c in per_table.items())


@query("search_all_substring", _substring_sql("99"))
def search_all_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit of a value in every column of every table."""
    return _shown(S.search(tables(spark, sf_dir), "99", limit=None))


@query("search_limited", f"""
    SELECT * FROM (SELECT * FROM ({hits_sql("orders", _number("o_orderkey o_custkey", "99") | {"o_orderstatus": _text("o_orderstatus", "99")} | _number("o_totalprice", "99") | {"o_orderdate": _date("o_orderdate", "99"), "o_orderpriority": _text("o_orderpriority", "99")})})
      ORDER BY CAST(row_key AS BIGINT) LIMIT 1000)
    UNION ALL
    SELECT * FROM (SELECT * FROM ({hits_sql("customer", _number("c_custkey", "99") | {"c_name": _text("c_name", "99")} | _number("c_nationkey c_acctbal", "99") | {"c_mktsegment": _text("c_mktsegment", "99")})})
      ORDER BY CAST(row_key AS BIGINT) LIMIT 1000)
""")
def search_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report form: the first 1000 hits of each table in key order."""
    return _shown(S.search(tables(spark, sf_dir, "customer", "orders"), "99", limit=1000))


@query("search_exact_ci", " UNION ALL ".join([
    hits_sql("customer", {c: f"lower({c}) = 'economy'" for c in ("c_name", "c_mktsegment")}),
    hits_sql("part", {c: f"lower({c}) = 'economy'" for c in ("p_name", "p_brand", "p_type")}),
]))
def search_exact_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.search(tables(spark, sf_dir, "customer", "part"), "Economy", exact=True, limit=None))


@query("search_exact_cs", " UNION ALL ".join([
    hits_sql("customer", {c: f"{c} = 'MACHINERY'" for c in ("c_name", "c_mktsegment")}),
    hits_sql("part", {c: f"{c} = 'MACHINERY'" for c in ("p_name", "p_brand", "p_type")}),
]))
def search_exact_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "customer", "part")
    return _shown(S.search(ts, "MACHINERY", exact=True, case_sensitive=True, limit=None))


@query("search_case_sensitive", hits_sql("documents", {
    c: f"contains({c}, 'The')" for c in ("text", "lang", "source")
}))
def search_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.search(tables(spark, sf_dir, "documents"), "The", case_sensitive=True, limit=None))


@query("search_regex_ci", hits_sql("pages", {
    c: f"regexp_matches({c}, 'PAGE=[0-9]+&ref', 'i')" for c in ("url", "html")
}))
def search_regex_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.search(tables(spark, sf_dir, "pages"), "PAGE=[0-9]+&ref", regex=True, limit=None))


@query("search_regex_cs", hits_sql("part", {
    c: f"regexp_matches({c}, '^Brand#1[0-9]$|^red ')" for c in ("p_name", "p_brand", "p_type")
}))
def search_regex_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "part")
    return _shown(S.search(ts, "^Brand#1[0-9]$|^red ", regex=True, case_sensitive=True, limit=None))


@query("search_column", hits_sql("customer", {"c_name": _text("c_name", "42")}))
def search_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.search(tables(spark, sf_dir, "customer"), "42", "customer", "c_name", limit=None))


@query("search_number", " UNION ALL ".join([
    hits_sql("lineitem", _number("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax", "7.0")
             | {c: _text(c, "7.0") for c in ("l_returnflag", "l_linestatus")} | {"l_shipdate": _date("l_shipdate", "7.0")}),
    hits_sql("labels", _number("doc_id quality toxic", "7.0")),
]))
def search_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7.0 finds the integer 7 and the double 7.0."""
    return _shown(S.search(tables(spark, sf_dir, "lineitem", "labels"), "7.0", limit=None))


@query("search_number_text_form", hits_sql("lineitem", {
    c: f"CAST({c} AS VARCHAR) = '7.0'"
    for c in "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
} | {c: _text(c, "7.0") for c in ("l_returnflag", "l_linestatus")} | {"l_shipdate": _date("l_shipdate", "7.0")}))
def search_number_text_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By text the integer 7 is not 7.0."""
    return _shown(S.search(tables(spark, sf_dir, "lineitem"), "7.0", text_form=True, limit=None))


@query("search_date", " UNION ALL ".join([
    hits_sql("orders", {c: _text(c, "1998-10-03") for c in ("o_orderstatus",)}
             | {"o_orderdate": _date("o_orderdate", "1998-10-03")} | {"o_orderpriority": _text("o_orderpriority", "1998-10-03")}),
    hits_sql("lineitem", {c: _text(c, "1998-10-03") for c in ("l_returnflag", "l_linestatus")}
             | {"l_shipdate": _date("l_shipdate", "1998-10-03")}),
]))
def search_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.search(tables(spark, sf_dir, "orders", "lineitem"), "1998-10-03", limit=None))


@query("search_boolean", """
    SELECT 'flags' AS table_name, CAST(doc_id AS VARCHAR) AS row_key,
      concat_ws(';', CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'bad' END) AS matching_columns
    FROM labels WHERE quality = 1 OR toxic = 1
""")
def search_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes is one of the words for true; the number column is skipped."""
    flags = tables(spark, sf_dir, "labels")["labels"].select(
        "doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad")
    )
    return _shown(S.search(TableSet.of(spark, {"flags": flags}, keys={"flags": ("doc_id",)}), "Yes", limit=None))


@query("search_interval", """
    SELECT 'ages' AS table_name, CAST(o_orderkey AS VARCHAR) AS row_key, 'age' AS matching_columns
    FROM orders WHERE date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) = 400
""")
def search_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals have no comparison of their own: a part of their text is found, here the days."""
    age = (F.col("o_orderdate") - F.lit("1995-01-01").cast("timestamp_ntz")).alias("age")
    ages = tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", age)
    return _shown(S.search(TableSet.of(spark, {"ages": ages}, keys={"ages": ("o_orderkey",)}), "'400 00:", limit=None))


_LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("search_null", hits_sql("documents", {
    c: f"{c} IS NULL" for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
}, _LABELLED))
def search_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = tables(spark, sf_dir, "documents", "labels")
    labelled = ts["documents"].join(ts["labels"], "doc_id", "left")
    return _shown(S.search(ts.with_table("documents", labelled).only("documents"), "null", limit=None))


@query("search_json_text", hits_sql("events", {"props": _text("props", "69")}))
def search_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.search(tables(spark, sf_dir, "events"), "69", "events", "props", limit=None))


def event_documents(spark: SparkSession, sf_dir: str) -> TableSet:
    """Events with a nested JSON text made from their columns."""
    events = tables(spark, sf_dir, "events")["events"]
    nested = F.to_json(F.struct(
        F.col("event_type").alias("kind"),
        F.struct(F.col("user_id").alias("user"), F.array("event_type", F.lit("seen")).alias("tags")).alias("actor"),
    ))
    return TableSet.of(
        spark, {"events": events.select("event_id", nested.alias("doc_text"))},
        keys={"events": ("event_id",)}, json_columns={"events": {"doc_text"}},
    )


def _event_hits(condition: str) -> str:
    return (
        "SELECT 'events' AS table_name, CAST(event_id AS VARCHAR) AS row_key, 'doc_text' AS matching_columns "
        f"FROM events WHERE {condition}"
    )


@query("search_json_kv", _event_hits("event_type = 'purchase'"))
def search_json_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.search(event_documents(spark, sf_dir), "kind:purchase", limit=None))


@query("search_json_path", _event_hits("event_type = 'click'"))
def search_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any element of the array at the path may be equal."""
    return _shown(S.search(event_documents(spark, sf_dir), "actor->tags->click", recursive=True, limit=None))


@query("search_json_path_index", _event_hits("event_type = 'error'"))
def search_json_path_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.search(event_documents(spark, sf_dir), "actor->tags->0->error", recursive=True, limit=None))


@query("search_json_leaf", """
    SELECT 'events' AS table_name, CAST(event_id AS VARCHAR) AS row_key,
      concat_ws(';', CASE WHEN event_id = 42 THEN 'event_id' END, CASE WHEN user_id = 42 THEN 'doc_text' END) AS matching_columns
    FROM events WHERE event_id = 42 OR user_id = 42
""")
def search_json_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any value at any depth; keys and parts of numbers do not count."""
    return _shown(S.search(event_documents(spark, sf_dir), "42", recursive=True, limit=None))


@query("search_documents", """
    SELECT 'events' AS table_name, CAST(event_id AS VARCHAR) AS row_key,
      concat_ws(';', CASE WHEN user_id = 42 THEN 'actor' END, CASE WHEN event_id = 42 THEN 'number' END) AS matching_columns
    FROM events WHERE event_id = 42 OR user_id = 42
""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema-less documents: matching top-level fields, ``_id`` left out."""
    events = tables(spark, sf_dir, "events")["events"]
    doc = F.try_parse_json(F.to_json(F.struct(
        F.col("event_id").alias("_id"), F.col("event_id").alias("number"),
        F.struct(F.struct(F.col("user_id").alias("user")).alias("by"), F.col("event_type").alias("kind")).alias("actor"),
    )))
    ts = TableSet.of(spark, {"events": events.select(doc.alias("doc"))})
    return _shown(S.search(ts, "42", recursive=True, limit=None))


@query("search_struct", """
    SELECT 'customer' AS table_name, CAST(c_custkey AS VARCHAR) AS row_key, 'profile' AS matching_columns
    FROM customer WHERE contains(lower(c_mktsegment), 'house')
""")
def search_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed nested columns, any leaf."""
    customer = tables(spark, sf_dir, "customer")["customer"].select(
        "c_custkey", F.struct("c_acctbal", F.struct("c_mktsegment").alias("market")).alias("profile")
    )
    ts = TableSet.of(spark, {"customer": customer}, keys={"customer": ("c_custkey",)})
    return _shown(S.search(ts, "HOUSE", recursive=True, limit=None))


@query("search_array_elements", """
    SELECT 'part' AS table_name, CAST(p_partkey AS VARCHAR) AS row_key, 'words' AS matching_columns
    FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')
""")
def search_array_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables(spark, sf_dir, "part")["part"].select("p_partkey", F.split("p_name", " ").alias("words"))
    ts = TableSet.of(spark, {"part": part}, keys={"part": ("p_partkey",)})
    return _shown(S.search(ts, "ring", exact=True, case_sensitive=True, limit=None))


@query("search_highlight", """
    SELECT doc_id, regexp_replace(text, '(the)', '<<\\1>>', 'gi') AS marked FROM documents
    WHERE contains(lower(text), 'the')
""")
def search_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = tables(spark, sf_dir, "documents")["documents"]
    found = documents.where(S.match_text(F.col("text"), S.SearchValue("the")))
    return found.select("doc_id", S.highlight(F.col("text"), "the").alias("marked"))


@query("search_hit_counts", """
    SELECT table_name, column_name, count(*) AS hits FROM (
      SELECT 'part' AS table_name, 'p_name' AS column_name FROM part WHERE contains(lower(p_name), 're')
      UNION ALL SELECT 'part', 'p_brand' FROM part WHERE contains(lower(p_brand), 're')
      UNION ALL SELECT 'part', 'p_type' FROM part WHERE contains(lower(p_type), 're')
      UNION ALL SELECT 'documents', 'text' FROM documents WHERE contains(lower(text), 're')
      UNION ALL SELECT 'documents', 'lang' FROM documents WHERE contains(lower(lang), 're')
      UNION ALL SELECT 'documents', 'source' FROM documents WHERE contains(lower(source), 're')
    ) GROUP BY ALL
""")
def search_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hit_counts(S.search(tables(spark, sf_dir, "part", "documents"), "re", limit=None))


@query("hits_compact", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {key_sql(t)} AS row_key, '{c}' AS column_name, {c} AS value "
    f"FROM {t} WHERE contains(lower({c}), 'ing')"
    for t, cs in {"part": ("p_name", "p_brand", "p_type"), "customer": ("c_name", "c_mktsegment")}.items()
    for c in cs
))
def hits_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.search(tables(spark, sf_dir, "part", "customer"), "ing", limit=None, with_data=True)
    return S.hits_compact(hits).select("table_name", "row_key", F.explode("data").alias("column_name", "value"))


_NO = "CAST(NULL AS VARCHAR)"


@query("search_csv_export", f"""
    SELECT 'part' AS "table", concat_ws(';', CASE WHEN p_partkey = 42 THEN 'p_partkey' END,
        CASE WHEN contains(p_name, '42') THEN 'p_name' END, CASE WHEN contains(p_brand, '42') THEN 'p_brand' END,
        CASE WHEN contains(p_type, '42') THEN 'p_type' END, CASE WHEN p_size = 42 THEN 'p_size' END,
        CASE WHEN p_retailprice = 42 THEN 'p_retailprice' END) AS matching_columns,
      p_brand, p_name, CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_retailprice AS VARCHAR) AS p_retailprice,
      CAST(p_size AS VARCHAR) AS p_size, p_type, {_NO} AS s_acctbal, {_NO} AS s_name, {_NO} AS s_nationkey, {_NO} AS s_suppkey
    FROM part WHERE p_partkey = 42 OR contains(p_name, '42') OR contains(p_brand, '42') OR contains(p_type, '42')
      OR p_size = 42 OR p_retailprice = 42
    UNION ALL
    SELECT 'supplier', concat_ws(';', CASE WHEN s_suppkey = 42 THEN 's_suppkey' END,
        CASE WHEN contains(s_name, '42') THEN 's_name' END, CASE WHEN s_nationkey = 42 THEN 's_nationkey' END,
        CASE WHEN s_acctbal = 42 THEN 's_acctbal' END),
      {_NO}, {_NO}, {_NO}, {_NO}, {_NO}, {_NO}, CAST(s_acctbal AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR),
      CAST(s_suppkey AS VARCHAR)
    FROM supplier WHERE s_suppkey = 42 OR contains(s_name, '42') OR s_nationkey = 42 OR s_acctbal = 42
""")
def search_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two tables written as one CSV and read back."""
    path = scratch_path(spark, "hits-csv")
    export_csv(S.hits_wide(tables(spark, sf_dir, "part", "supplier"), "42", limit=None), path)
    return spark.read.csv(path, header=True, escape='"')


def _through_index(spark: SparkSession, sf_dir: str, value: str, **how: bool) -> DataFrame:
    """Hits in the texts of documents, of which only granules are read that hold the trigrams of the value."""
    path = scratch_path(spark, "trigrams")
    write_trigram_index(tables(spark, sf_dir, "documents")["documents"], path, ["text", "source"], granule_rows=64)
    return _shown(indexed_search(spark, path, "documents", value, ["text", "source"], key=("doc_id",), **how))


@query("search_index_substring", hits_sql("documents", {"text": _text("text", "apache license"), "source": _text("source", "apache license")}))
def search_index_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_index(spark, sf_dir, "Apache License")


@query("search_index_regex", hits_sql("documents", {
    c: f"regexp_matches({c}, 'AKIA[A-Z0-9]{{16}}|token *[:=] *[A-Za-z]+')" for c in ("text", "source")
}))
def search_index_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_index(spark, sf_dir, "AKIA[A-Z0-9]{16}|token *[:=] *[A-Za-z]+", regex=True, case_sensitive=True)
