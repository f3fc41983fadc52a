import random

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import profile as P
from tablewarden.sources.tables import TableSet


def test_profile_with_and_without_nulls(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.5, True, None), (2, "a", None, None, None), (None, "x" * 100, 1.5, False, None), (2, None, float("nan"), True, None)],
        "i int, s string, d double, b boolean, n string",
    ).withColumn("t", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn("a", F.array("i"))
    by = {r.column_name: r for r in P.profile(df).collect()}
    assert sorted(by) == sorted(df.columns)
    assert (by["i"].unique_values, by["i"].null_count, by["i"].min_value, by["i"].max_value) == (2, 1, "1", "2")
    assert abs(by["i"].avg_value - 5 / 3) < 1e-9
    assert (by["s"].unique_values, by["s"].null_count, by["s"].min_length, by["s"].max_length, by["s"].avg_length) == (2, 1, 1, 100, 34.0)
    assert (by["b"].unique_values, by["b"].null_count, by["b"].base_type) == (2, 1, "boolean")
    assert (by["n"].unique_values, by["n"].null_count, by["n"].min_length) == (0, 4, None)
    assert (by["t"].unique_values, by["t"].min_value) == (1, "2024-01-01 00:00:00")
    assert (by["a"].unique_values, by["a"].base_type) == (3, "other")


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "i int, s string")
    rows = {r.column_name: (r.unique_values, r.null_count, r.min_value) for r in P.profile(df).collect()}
    assert rows == {"i": (0, 0, None), "s": (0, 0, None)}


def test_exact_and_sketched_agree_on_small_data(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("s"), (F.col("id") / 3).alias("d"))
    exact = {r.column_name: r.asDict() for r in P.profile(df).collect()}
    rough = {r.column_name: r.asDict() for r in P.profile(df, exact=False).collect()}
    for name, row in exact.items():
        other = rough[name]
        assert abs(other.pop("unique_values") - row.pop("unique_values")) <= 50
        for k in ("avg_length", "avg_value"):
            a, b = row.pop(k), other.pop(k)
            assert a == b or abs(a - b) < 1e-9
        assert row == other


def test_long_texts_that_differ_at_the_end_are_distinct(spark):
    df = spark.range(30).select(F.concat(F.lit("x" * 5000), (F.col("id") % 10).cast("string")).alias("t"))
    assert P.profile(df).first().unique_values == 10


def test_counts(spark):
    ts = TableSet.of(spark, {"a": spark.range(3), "b": spark.range(0)})
    assert {r.table_name: r.rows for r in P.count_all(ts).collect()} == {"a": 3, "b": 0, "TOTAL": 3}
    assert P.count(ts["a"], "id > 0").first().rows == 2
    assert P.count(ts["a"], {"id": {"$gt": 0}}).first().rows == 2


DOCS = [
    '{"_id": 1, "a": "xy", "b": 5, "c": null, "d": [1, 2], "e": {"f": 1}}',
    '{"_id": 2, "a": "xy", "b": "5", "d": []}',
    '{"_id": 3, "a": null, "b": true}',
]


def test_document_fields(docs):
    by = {r.field: r for r in P.profile_documents(docs(*DOCS)).collect()}
    assert set(by) == set("abcde")
    assert (by["a"].common_type, by["a"].types, by["a"].present, by["a"].null_count, by["a"].unique_values) == ("string", "null, string", 3, 1, 2)
    assert (by["a"].min_length, by["a"].max_length, by["a"].avg_length) == (2, 2, 2.0)
    assert (by["b"].common_type, by["b"].unique_values, by["b"].min_value) == ("string", 3, None)
    assert (by["c"].common_type, by["c"].presence_pct) == ("null", 33.33)
    assert (by["d"].common_type, by["d"].min_items, by["d"].max_items, by["d"].avg_items) == ("array", 0, 2, 1.0)
    assert by["e"].common_type == "object"


def _walk(doc, prefix, out):
    """What a reader of one document sees, written down plainly."""
    for key, value in doc.items():
        path = f"{prefix}.{key}" if prefix else key
        kind = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", dict: "object"}.get(type(value))
        if isinstance(value, list):
            names = {bool: "boolean", int: "number", float: "number", str: "string"}
            out.setdefault(path, set()).update({f"array({names.get(type(x), 'object')})" for x in value} or {"array"})
            for element in value:
                if isinstance(element, dict):
                    _walk(element, f"{path}[*]", out)
            continue
        if isinstance(value, dict):
            _walk(value, path, out)
        out.setdefault(path, set()).add(kind)


def test_nested_fields_against_a_plain_walk(docs):
    import json

    rng = random.Random(3)

    def value(depth):
        r = rng.random()
        if depth and r < 0.25:
            return {rng.choice("pqr"): value(depth - 1) for _ in range(rng.randrange(3))}
        if depth and r < 0.5:
            return [value(depth - 1) for _ in range(rng.randrange(5))]
        return rng.choice([None, 1, 2.5, "s", True])

    made = [{rng.choice("abc"): value(6) for _ in range(3)} for _ in range(60)]
    types, seen = {}, {}
    for doc in made:
        one = {}
        _walk(doc, "", one)
        for path, kinds in one.items():
            types.setdefault(path, set()).update(kinds)
            seen[path] = seen.get(path, 0) + 1
    frame = docs(*[json.dumps(d) for d in made])
    for depth in (None, 20):
        got = P.infer_fields(frame, max_depth=depth).collect()
        assert {r.path: (r.types, r.documents) for r in got} == {p: (", ".join(sorted(types[p])), seen[p]) for p in types}


def test_all_elements_of_long_arrays(docs):
    import json

    for n in (3, 20_000):
        text = json.dumps({"_id": 1, "l": [{"a": 1}] * n + [{"z": 1}], "m": [1, {"y": 2}, "s"]})
        found = {r.path: r.types for r in P.infer_fields(docs(text)).collect()}
        assert found == {
            "_id": "number", "l": "array(object)", "l[*].a": "number", "l[*].z": "number",
            "m": "array(number), array(object), array(string)", "m[*].y": "number",
        }


def test_keys_that_are_data_share_one_path(docs):
    texts = (
        '{"u": {"17": {"n": 1}, "-4": {"n": "a"}}, "h": {"0123456789abcdef": 1}}',
        '{"u": {"99": {"n": 1, "m": {"2024-05-06T07:08:09Z": true}}}, "h": {"123e4567-e89b-12d3-a456-426614174000": null}}',
        '{"u": {"name": 5}, "h": {}, "v2": 1, "l": [{"7": 1}, {"8": {"x": 1}}]}',
    )
    found = {r.path: (r.types, r.documents) for r in P.infer_fields(docs(*texts)).collect()}
    assert found == {
        "u": ("object", 3), "u.{*}": ("object", 2), "u.{*}.n": ("number, string", 2), "u.{*}.m": ("object", 1),
        "u.{*}.m.{*}": ("boolean", 1), "u.name": ("number", 1), "h": ("object", 3), "h.{*}": ("null, number", 2),
        "v2": ("number", 1), "l": ("array(object)", 1), "l[*].{*}": ("number, object", 1), "l[*].{*}.x": ("number", 1),
    }
    plain = {r.path for r in P.infer_fields(docs(*texts), data_key=None).collect()}
    assert {"u.17", "u.-4", "u.99", "h.0123456789abcdef", "l[*].7"} <= plain and not any("{*}" in p for p in plain)


def test_ids_as_keys_leave_the_skeletons(docs):
    from pyspark.sql import functions as F

    from tablewarden.functions.jsontext import DATA_KEY, skeleton

    made = docs(*[f'{{"u": {{"{i}": {{"n": {i}}}, "{i + 5000}": {{"n": 0}}}}}}' for i in range(1000, 1200)])
    counts = [made.select(skeleton(F.to_json("doc"), k)).distinct().count() for k in (None, DATA_KEY)]
    assert counts == [200, 1]


def test_objects_with_many_keys_are_found_by_their_number(docs):
    made = docs(*[f'{{"by": {{"n{i}": {{"k{i % 3}": 1, "to": {{"m{i}": 2}}}}}}, "l": [{{"x{i}": 3}}]}}' for i in range(40)])
    found = {r.path: r.documents for r in P.infer_fields(made, most_names=39).collect()}
    assert found == {
        "by": 40, "by.{*}": 40, "by.{*}.k0": 14, "by.{*}.k1": 13, "by.{*}.k2": 13, "by.{*}.to": 40, "by.{*}.to.{*}": 40,
        "l": 40, "l[*].{*}": 40,
    }
    assert P.infer_fields(made, most_names=40).where("path like 'by.n%'").count() > 40


def test_a_broken_table_does_not_spoil_the_count(spark, scratch):
    import os

    spark.range(3).write.parquet(f"{scratch}/good.parquet")
    ts = TableSet.from_parquet(spark, scratch)
    os.makedirs(f"{scratch}/empty.parquet")
    both = TableSet.from_parquet(spark, scratch)
    with pytest.warns(UserWarning, match="not counted"):
        rows = {r.table_name: r.rows for r in P.count_all(both).collect()}
    assert rows == {"good": 3, "empty": None, "TOTAL": 3} and P.count_all(ts).count() == 2


def test_observed_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id int, s string")
    rows = P.observed_columns(TableSet.of(spark, {"t": df}), "t").collect()
    assert [(r.column_name, r.nullable, r.key_candidate) for r in rows] == [("id", False, True), ("s", True, False)]


def test_inventory_counts_each_file_once(spark, scratch):
    spark.range(1000).repartition(4).write.parquet(f"{scratch}/t.parquet")
    import glob
    import os

    size = sum(os.path.getsize(p) for p in glob.glob(f"{scratch}/t.parquet/*.parquet"))
    row = P.inventory(TableSet.from_parquet(spark, scratch)).first()
    assert (row.table_name, row.columns, row.rows, row.bytes) == ("t", 1, 1000, size)


def test_medians_without_gathering_a_column(spark):
    """Exact for odd and even counts, repeats and NULLs; no aggregate holds the values of a column."""
    from tablewarden.operators.profile import exact_medians

    rows = [(i % 7, None, float(i * 37 % 1001) / 4, i if i < 3 else None, 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, none long, b double, few long, same int")
    want = df.agg(*[F.percentile(c, 0.5).alias(c) for c in df.columns]).first().asDict()
    got = exact_medians(df)
    assert {r.column_name: r.median for r in got.collect()} == {c: m for c, m in want.items() if m is not None}
    assert {r.column_name: r.median for r in exact_medians(df.limit(2).select("a", "b")).collect()} == {"a": 0.5, "b": 4.625}
    assert exact_medians(df.limit(0)).collect() == []


def test_sketched_profile_gathers_no_column(spark, monkeypatch):
    """The query's exact medians are counted, not gathered into one buffer."""
    from tablewarden.plans import layout_queries

    monkeypatch.setattr(F, "percentile", None)
    assert layout_queries.profile_sketched(spark, "/root/testdata/sf0.001").where("distinct_close AND median_close").count() == 6
