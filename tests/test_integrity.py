import pytest
from pyspark.sql import functions as F

from tablewarden.operators import integrity as I
from tablewarden.sources.tables import Reference, TableSet


@pytest.mark.parametrize("declared, canonical, spark_type", [
    ("SERIAL PRIMARY KEY", "INTEGER", "int"),
    ("bigserial", "BIGINT", "bigint"),
    ("VARCHAR(255) UNIQUE NOT NULL", "CHARACTER VARYING", "string"),
    ("DECIMAL(10, 2) DEFAULT 0", "NUMERIC", "decimal"),
    ("NUMERIC(10,2)", "NUMERIC", "decimal"),
    ("TEXT[] DEFAULT '{}'", "ARRAY", "array"),
    ("TIMESTAMP WITH TIME ZONE DEFAULT CURRENT_TIMESTAMP", "TIMESTAMP WITH TIME ZONE", "timestamp"),
    ("INTEGER REFERENCES users(id) ON DELETE CASCADE", "INTEGER", "int"),
    ("INTEGER NOT NULL CHECK (credits > 0)", "INTEGER", "int"),
    ("JSONB", "JSONB", "string"),
    ("BOOLEAN DEFAULT false", "BOOLEAN", "boolean"),
])
def test_declared_types(declared, canonical, spark_type):
    column = I.ExpectedColumn("c", declared)
    assert (column.canonical_type, column.spark_type) == (canonical, spark_type)


def test_declared_rules():
    c = I.ExpectedColumn("c", "VARCHAR(20) NOT NULL CHECK (length(c) > 2)")
    assert (c.required, c.unique, c.max_length, c.check) == (True, False, 20, "length(c) > 2")
    assert I.ExpectedColumn("c", "SERIAL PRIMARY KEY").required


@pytest.fixture
def family(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, name string")
    child = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, None), (5, 9)], "id int, parent_id int")
    return TableSet.of(
        spark, {"parent": parent, "child": child}, keys={"parent": ("id",), "child": ("id",)},
        uniques={"parent": [("name",)]}, references=[Reference("child", "parent_id", "parent", "id")],
    )


def test_references(family):
    ref = family.references[0]
    assert sorted(r.id for r in I.orphans(family, ref).collect()) == [3, 5]
    row = I.check_references(family).first()
    assert (row.orphan_values, row.orphan_rows, row.severity) == (1, 2, "error")
    assert sorted(r.id for r in I.unmatched_parents(family, ref).collect()) == [2, 3]
    some = family["parent"].where("id = 1")
    assert sorted(r.id for r in I.dependents(family, ref, some).collect()) == [1, 2]


def test_unique(family):
    rows = {(r.table_name, r.key): (r.repeated_values, r.surplus_rows) for r in I.check_unique(family).collect()}
    assert rows == {("parent", "id"): (0, 0), ("parent", "name"): (1, 1), ("child", "id"): (0, 0)}
    nulls = family["child"].select("parent_id").unionByName(family["child"].select("parent_id").where("parent_id is null"))
    assert I.duplicates(nulls.where("parent_id is null"), ("parent_id",)).count() == 0


def test_rules_count_what_is_broken_and_let_null_pass(family):
    report = I.check_rules(family, {"child": {"known": "parent_id < 5", "small": "id < 100"}})
    assert {r.rule: (r.broken, r.severity) for r in report.collect()} == {"known": (2, "error"), "small": (0, "ok")}
    report = I.check_not_null(family, {"child": ["parent_id", "id"]})
    assert {r.rule: r.broken for r in report.collect()} == {"parent_id not null": 1, "id not null": 0}


def test_declared(family):
    expected = {"parent": {"id": "SERIAL PRIMARY KEY", "name": "VARCHAR(0) CHECK (name <> 'a')"}, "gone": {"id": "INT"}}
    got = {r.rule: r.broken for r in I.check_declared(family, expected).collect()}
    assert got == {"id not null": 0, "name length <= 0": 3, "name check": 1}


def test_drift_and_verdicts(family):
    expected = {"parent": {"id": "BIGINT", "name": "TEXT", "extra": "TEXT"}, "gone": {"id": "INT"}}
    found = {(r.table_name, r.column_name, r.issue, r.severity, r.rows) for r in I.schema_drift(family, expected).collect()}
    assert found == {
        ("parent", "id", "type mismatch", "error", 3), ("parent", "extra", "missing column", "error", 3),
        ("gone", None, "missing table", "error", None), ("child", None, "extra table", "warning", 5),
    }
    good = {"parent": {"id": "SERIAL", "name": "VARCHAR(9)"}, "child": {"id": "INT", "parent_id": "INT REFERENCES parent(id)"}}
    assert I.schema_drift(family, good).count() == 0
    report = I.verify_environments({"x": family, "y": family.without("child")}, good)
    assert {r.env: (r.errors, r.passed) for r in I.verdicts(report, ["x", "y"]).collect()} == {"x": (0, True), "y": (1, False)}
    assert {r.severity: r.findings for r in I.summary(report).collect()} == {"error": 1}


def test_nonempty(family):
    got = {r.table_name: (r.rows, r.severity) for r in I.check_nonempty(family, {"parent": None, "child": "id > 9", "zzz": None}).collect()}
    assert got == {"parent": (3, "ok"), "child": (0, "warning"), "zzz": (None, "error")}


def test_orphan_check_counts_before_it_joins(spark):
    """One value holds most child rows; the join sees it once."""
    child = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("p"))
    ts = TableSet.of(spark, {"c": child, "p": spark.range(100)}, references=[Reference("c", "p", "p", "id")])
    row = I.check_references(ts).first()
    expected = [i for i in range(1, 5000, 2) if i >= 100]
    assert (row.orphan_values, row.orphan_rows) == (len(expected), len(expected))


def test_intervals_are_a_known_type(spark):
    df = spark.sql("SELECT INTERVAL '1' DAY AS d, INTERVAL '2' MONTH AS m, 'x' AS s")
    drift = I.schema_drift(TableSet.of(spark, {"t": df}), {"t": {"d": "INTERVAL", "m": "INTERVAL NOT NULL", "s": "INTERVAL"}}).collect()
    assert [(r.column_name, r.issue) for r in drift] == [("s", "type mismatch")]


def test_environments_count_their_rows(spark, tmp_path):
    """A verdict comes with the rows its tables hold, all of them, repeated and empty tables included."""
    from tablewarden.plans.integrity_queries import verify_environments

    customer = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    orders = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame([(1, "a", 1, 0.5, "x"), (1, "a", 1, 0.5, "x"), (None,) * 5], customer).write.parquet(f"{tmp_path}/customer.parquet")
    for n in (2, 0):
        spark.createDataFrame([(i, 1, "O", 1.0, None, "1") for i in range(n)], orders).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        got = {r.env: (r.errors, r.warnings, r.passed, r.rows) for r in verify_environments(spark, str(tmp_path)).collect()}
        assert got == {"staging": (3, 1, False, 3 + n), "fixed": (0, 0, True, 3 + 2 * n)}
