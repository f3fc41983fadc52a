import re

import pytest
from pyspark.sql import Row, functions as F

from tablewarden.operators import search as S
from tablewarden.sources.sinks import export_csv
from tablewarden.sources.tables import TableSet

AWKWARD = ["100%", "a_b", "axb", "it's", 'say "hi"', "back\\slash", "x.*y", "two\nlines", "", "Ärger", "ärger", "NULL", None]


@pytest.fixture
def awkward(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(AWKWARD)], "id int, t string")
    return TableSet.of(spark, {"w": df}, keys={"w": ("id",)})


def found(ts, value, **how):
    hits = S.search(ts, value, limit=None, **how).collect()
    return {(r.table_name, r.row_key): r.matching_columns for r in hits}


@pytest.mark.parametrize("value", ["%", "_", "'", '"', "\\", ".*", "\n", "a", "Ä", "ä"])
def test_contains_takes_every_character_as_it_is(awkward, value):
    expected = {("w", str(i)): ["t"] for i, t in enumerate(AWKWARD) if t is not None and value.lower() in t.lower()}
    assert found(awkward, value) == expected
    sensitive = {("w", str(i)): ["t"] for i, t in enumerate(AWKWARD) if t is not None and value in t}
    assert found(awkward, value, case_sensitive=True) == sensitive


@pytest.mark.parametrize("value", ["a_b", "ÄRGER", "it's", ""])
def test_exact(awkward, value):
    expected = {("w", str(i)): ["t"] for i, t in enumerate(AWKWARD) if t is not None and value.lower() == t.lower()}
    assert found(awkward, value, exact=True) == expected


@pytest.mark.parametrize("pattern", ["^a.b$", "x\\.\\*y", "^(it|say)", "Ä"])
def test_regex(awkward, pattern):
    both = {True: 0, False: re.I}
    for sensitive, flag in both.items():
        expected = {("w", str(i)): ["t"] for i, t in enumerate(AWKWARD) if t is not None and re.search(pattern, t, flag)}
        assert found(awkward, pattern, regex=True, case_sensitive=sensitive) == expected


def test_null_finds_null_not_the_word(awkward):
    assert found(awkward, "null") == {("w", str(len(AWKWARD) - 1)): ["t"]}


@pytest.fixture
def typed(spark):
    rows = [
        Row(id=1, i=1, l=10, d=1.0, f=1.5, b=True, s="1", ts="2024-01-01 10:00:00", dt="2024-01-01", dec="1.00"),
        Row(id=2, i=7, l=2**62, d=0.1, f=0.1, b=False, s="yes", ts="2024-05-01 00:00:00.25", dt="2024-05-01", dec="7.50"),
        Row(id=3, i=None, l=None, d=None, f=None, b=None, s=None, ts=None, dt=None, dec=None),
    ]
    df = spark.createDataFrame(rows, "id int, i int, l long, d double, f double, b boolean, s string, ts string, dt string, dec string")
    df = df.withColumns({
        "f": F.col("f").cast("float"), "ts": F.col("ts").cast("timestamp_ntz"), "dt": F.col("dt").cast("date"),
        "dec": F.col("dec").cast("decimal(10,2)"),
    })
    return TableSet.of(spark, {"t": df}, keys={"t": ("id",)})


@pytest.mark.parametrize("value, expected", [
    ("1", {"1": ["id", "i", "d", "b", "s", "ts", "dt", "dec"], "2": ["ts", "dt"]}),
    ("1.0", {"1": ["id", "i", "d", "dec"]}),
    (str(2**62), {"2": ["l"]}),
    ("0.1", {"2": ["d", "f"]}),
    ("7.5", {"2": ["dec"]}),
    ("yes", {"1": ["b"], "2": ["s"]}),
    ("F", {"2": ["b"]}),
    ("2024-05", {"2": ["ts", "dt"]}),
    ("00.25", {"2": ["ts"]}),
    ("inf", {}),
    ("nan", {}),
    ("1_0", {}),
])
def test_types_decide_how_to_compare(typed, value, expected):
    assert {k[1]: v for k, v in found(typed, value).items()} == expected


def test_text_form_of_numbers(typed):
    assert found(typed, "1.0", text_form=True) == {("t", "1"): ["d"]}


def test_null_search_lists_all_columns(typed):
    assert found(typed, "NULL") == {("t", "3"): ["i", "l", "d", "f", "b", "s", "ts", "dt", "dec"]}


def test_unknown_names_are_errors(typed):
    with pytest.raises(KeyError):
        S.search(typed, "x", "nope")
    with pytest.raises(KeyError):
        S.search(typed, "x", "t", "nope")


def test_one_column(typed):
    assert found(typed, "1", table="t", column="i") == {("t", "1"): ["i"]}


def test_limit_is_per_table_and_in_key_order(spark):
    df = spark.range(50).repartition(7).select("id", F.lit("same").alias("s"))
    ts = TableSet.of(spark, {"a": df, "b": df}, keys={"a": ("id",), "b": ("id",)})
    keys = [(r.table_name, int(r.row_key)) for r in S.search(ts, "same", limit=5).collect()]
    assert sorted(keys) == [(t, i) for t in "ab" for i in range(5)]


def test_filter_and_annotation_agree(spark):
    from tablewarden.plans.registry import tables
    from tests.conftest import SMALL

    ts = tables(spark, SMALL, "customer", "orders", "events", "part")
    hits = S.search(ts, "1", limit=None)
    assert hits.where(F.size("matching_columns") == 0).count() == 0
    per_table = {r.table_name: r.n for r in hits.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name in ts.names:
        predicates = S.column_predicates(ts, name, S.SearchValue("1"))
        flagged = ts[name].withColumn("m", S.matching_columns(predicates)).where(F.size("m") > 0)
        assert flagged.count() == per_table.get(name, 0)


JSON = [
    '{"k": "v", "n": 5, "users": [{"name": "John", "tags": ["a", "b"]}, {"name": "Ann"}]}',
    '{"k": "other:v", "n": "5", "users": []}',
    "not json v",
    '{"deep": {"er": {"x": "needle"}}, "needle": 1, "q": "say \\"hi: there\\""}',
    None,
]


@pytest.fixture
def json_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(JSON)], "id int, j string")
    return TableSet.of(spark, {"t": df}, keys={"t": ("id",)}, json_columns={"t": {"j"}})


@pytest.mark.parametrize("value, how, ids", [
    ("JOHN", {}, [0]),
    ("k:v", {}, [0]),
    ("n:5", {}, [1]),
    ("^not", {"regex": True}, [2]),
    ("users->0->name->John", {"recursive": True}, [0]),
    ("users->1->name->John", {"recursive": True}, []),
    ("users->0->tags->b", {"recursive": True}, [0]),
    ("deep->er->x->needle", {"recursive": True}, [3]),
    ("needle", {"recursive": True}, [3]),
    ("er", {"recursive": True, "exact": True}, []),
    ('"hi: there"', {"recursive": True}, [3]),
    ("5", {"recursive": True}, [0, 1]),
])
def test_json(json_table, value, how, ids):
    assert [int(k[1]) for k, v in found(json_table, value, **how).items() if "j" in v] == ids


def test_documents(spark, docs):
    ts = TableSet.of(spark, {"c": docs(
        '{"_id": "x1", "name": "Product 1", "price": 29.99, "tags": ["mobile", "x1"], "specs": {"color": "black"}}',
        '{"_id": "x2", "name": "x1", "price": 1, "flag": true, "gone": null}',
        '{"_id": "x3", "specs": {"size": {"w": "BLACK", "n": [1, 29.99]}}}',
    ), "system.views": docs('{"name": "x1"}')})
    assert found(ts, "x1") == {("c", "x1"): ["tags"], ("c", "x2"): ["name"]}
    assert found(ts, "29.99") == {("c", "x1"): ["price"], ("c", "x3"): ["specs"]}
    assert found(ts, "black") == {("c", "x1"): ["specs"], ("c", "x3"): ["specs"]}
    assert found(ts, "color->blac", recursive=True) == {("c", "x1"): ["specs"]}
    assert found(ts, "color->blac", recursive=True, exact=True) == {}
    assert found(ts, "color") == {("c", "x1"): ["specs"]}
    assert found(ts, "color", recursive=True) == {}
    assert found(ts, "true") == {("c", "x2"): ["flag"]}
    assert found(ts, "null") == {("c", "x2"): ["gone"]}
    assert found(ts, "x1", table="c", column="name") == {("c", "x2"): ["name"]}


def test_structs_and_arrays(spark):
    df = spark.createDataFrame(
        [(1, ("red", [1, 2], ("Big",)), ["x", "yes"], [True]), (2, None, None, None)],
        "id int, s struct<color: string, ns: array<int>, size: struct<name: string>>, a array<string>, bs array<boolean>",
    )
    ts = TableSet.of(spark, {"t": df}, keys={"t": ("id",)})
    assert found(ts, "yes") == {("t", "1"): ["a", "bs"]}
    assert found(ts, "big", recursive=True) == {("t", "1"): ["s"]}
    assert found(ts, "color") == {("t", "1"): ["s"]}
    assert found(ts, "color", recursive=True) == {}
    assert found(ts, "2", recursive=True) == {("t", "1"): ["s"], ("t", "2"): ["id"]}
    assert found(ts, "size->name->big", recursive=True) == {("t", "1"): ["s"]}


def test_highlight(spark):
    df = spark.createDataFrame([("a.b A.B axb $1",)], "t string")
    assert df.select(S.highlight(F.col("t"), "a.b")).first()[0] == "<<a.b>> <<A.B>> axb $1"
    assert df.select(S.highlight(F.col("t"), "a.b", regex=True)).first()[0] == "<<a.b>> <<A.B>> <<axb>> $1"
    assert df.select(S.highlight(F.col("t"), "$1", before="$", after="\\")).first()[0] == "a.b A.B axb $$1\\"


def test_compact_data(typed):
    hits = S.hits_compact(S.search(typed, "yes", with_data=True))
    assert {r.row_key: r.data for r in hits.collect()} == {"1": {"b": "true"}, "2": {"s": "yes"}}


def test_csv_of_different_tables(spark, awkward, scratch):
    other = spark.createDataFrame([(5, 'q"x', ["x", None])], "id int, name string, xs array<string>")
    ts = awkward.with_table("other", other)
    export_csv(S.hits_wide(ts, "x", limit=None), f"{scratch}/csv")
    text = "".join(r.value for r in spark.read.option("wholetext", True).text(f"{scratch}/csv").collect())
    assert "table,matching_columns,id,name,t,xs" in text
    assert 'other,name;xs,5,"q""x",,"[""x"",null]"' in text
    rows = spark.read.csv(f"{scratch}/csv", header=True, escape='"', multiLine=True).collect()
    assert {(r["table"], r["id"]) for r in rows} == {("w", "2"), ("w", "6"), ("other", "5")}


def test_broken_tables_are_skipped_and_named(spark, scratch):
    ts = TableSet.from_parquet(spark, scratch, ["missing"]).with_table("ok", spark.range(3))
    good, errors = S.check_tables(ts)
    assert good.names == ["ok"] and list(errors) == ["missing"]
    assert found(good, "2") == {("ok", None): ["id"]}
    with pytest.warns(UserWarning, match="missing"):
        assert found(ts, "2") == {("ok", None): ["id"]}


@pytest.mark.parametrize("value", ["1e3", "1000", "1000.0", "0", "0.50", "-7", "true", "NULL", "a.b", "é", "12345678", "x y", '"', "0.0001"])
def test_the_quick_text_test_loses_nothing(spark, value):
    """Against the same rules without the shortcut."""
    leaves = ["1e3", '"1e3"', "1000", "1000.00", "0", "0.0", "0.5", "5e-1", "-7", "-7.0", "true", '"TRUE"', "null", '"null"', '"A.B"', '"\\u0041.b"', '"\\u00e9"', '"É"', "12345678", "1.2345678e7", '"x y"', '"say \\"x\\""', "1e-4", "0.0001"]
    texts = [f'{{"v": {x}, "w": [{x}], "o": {{"p": {x}}}}}' for x in leaves]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    v = S.SearchValue(value, recursive=True)
    plain = S.any_leaf(F.col("j"), lambda kind, text: S._match_leaf(kind, text, v))
    rows = df.select("id", F.coalesce(S.match_json_text(F.col("j"), v), F.lit(False)), F.coalesce(plain, F.lit(False))).collect()
    assert [r[0] for r in rows if r[1] != r[2]] == []
    docs = df.select("id", F.try_parse_json("j").alias("doc"))
    entries = F.map_entries(F.try_variant_get("doc", "$", "map<string,variant>"))
    slow = F.transform(F.filter(entries, lambda e: F.coalesce(S.match_variant(e["value"], v), F.lit(False))), lambda e: e["key"])
    none = F.array().cast("array<string>")
    both = docs.select("id", F.coalesce(S.matching_fields(F.col("doc"), v), none), F.coalesce(slow, none)).collect()
    assert [r[0] for r in both if r[1] != r[2]] == []
