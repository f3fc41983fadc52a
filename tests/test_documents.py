import random

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import documents as D
from tablewarden.operators.predicates import compile_filter, fields_of
from tablewarden.sources.tables import TableSet

PEOPLE = [
    {"_id": 1, "name": "Ann", "age": 30, "tags": ["a", "b"], "home": {"city": "Rome"}},
    {"_id": 2, "name": "bob", "age": None, "tags": [], "home": {}},
    {"_id": 3, "name": "ANNA", "age": 41},
    {"_id": 4, "age": 5, "name": None, "tags": ["b"], "home": {"city": None}},
]


@pytest.fixture(scope="module")
def typed(spark):
    rows = [(p["_id"], p.get("name"), p.get("age"), p.get("tags"), (p.get("home", {}).get("city"),)) for p in PEOPLE]
    return spark.createDataFrame(rows, "_id long, name string, age long, tags array<string>, home struct<city: string>")


@pytest.fixture(scope="module")
def loose(docs):
    import json

    return docs(*[json.dumps(p) for p in PEOPLE])


FILTERS = [
    ({"name": "Ann"}, [1]),
    ({"age": {"$gte": 30}}, [1, 3]),
    ({"age": {"$gt": 30, "$lt": 100}}, [3]),
    ({"age": {"$ne": 30}}, [2, 3, 4]),
    ({"age": {"$in": [5, 41]}}, [3, 4]),
    ({"age": {"$nin": [5, 41]}}, [1, 2]),
    ({"age": {"$not": {"$gt": 10}}}, [2, 4]),
    ({"name": {"$regex": "^ann", "$options": "i"}}, [1, 3]),
    ({"name": {"$regex": "^ann"}}, []),
    ({"$or": [{"age": 5}, {"name": "bob"}]}, [2, 4]),
    ({"$and": [{"age": {"$lte": 41}}, {"age": {"$gte": 41}}]}, [3]),
    ({"$nor": [{"age": 5}, {"name": "bob"}]}, [1, 3]),
    ({"tags": "b"}, [1, 4]),
    ({"home.city": "Rome"}, [1]),
    ({"home.city": None}, [2, 3, 4]),
    ({"age": None}, [2]),
    ({"missing": None}, [1, 2, 3, 4]),
    ({"missing": 1}, []),
    ({}, [1, 2, 3, 4]),
]


@pytest.mark.parametrize("query, ids", FILTERS)
def test_filters_on_typed_and_loose_documents(typed, loose, query, ids):
    kept = typed.where(compile_filter(query, fields_of(typed)))
    assert sorted(r._id for r in kept.collect()) == ids
    kept = loose.where(compile_filter(query, fields_of(loose)))
    found = kept.select(F.try_variant_get("doc", "$._id", "long")).collect()
    assert sorted(r[0] for r in found) == ids


def test_loose_documents_tell_null_from_missing(loose):
    ids = lambda q: [r[0] for r in loose.where(compile_filter(q, fields_of(loose))).select(F.try_variant_get("doc", "$._id", "long")).collect()]
    assert ids({"name": {"$exists": True}}) == [1, 2, 3, 4]
    assert ids({"home.city": {"$exists": True}}) == [1, 4]
    assert ids({"tags": {"$exists": False}}) == [3]


def test_loose_values_of_another_type_are_not_equal(docs):
    frame = docs('{"v": "5"}', '{"v": 5}', '{"v": true}')
    count = lambda q: frame.where(compile_filter(q, fields_of(frame))).count()
    assert (count({"v": 5}), count({"v": "5"}), count({"v": True}), count({"v": {"$gte": 1}})) == (1, 1, 1, 1)


def test_unknown_operators_are_errors(typed):
    with pytest.raises(ValueError):
        compile_filter({"age": {"$near": 1}}, fields_of(typed))
    with pytest.raises(ValueError):
        D.pipeline(TableSet.of(typed.sparkSession, {"t": typed}), "t", [{"$facet": {}}])


def test_comparisons_reach_the_parquet_scan(spark, scratch):
    spark.range(100).write.parquet(f"{scratch}/t")
    df = D.find(spark.read.parquet(f"{scratch}/t"), {"id": {"$gte": 90}})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,90)" in plan


def test_projection(typed):
    assert D.project(typed, {"home.city": 1}).columns == ["_id", "city"]
    assert D.project(typed, {"_id": 0, "who": "$name"}).columns == ["who"]
    assert D.project(typed, {"age": 0, "tags": 0}).columns == ["_id", "name", "home"]
    assert D.find(typed, {}, {"name": 1}, {"age": -1}, 2).collect()[0].name == "ANNA"


@pytest.fixture(scope="module")
def shop(spark):
    """Most orders belong to one customer, and many are copies."""
    rng = random.Random(1)
    orders = [(i, 0 if rng.random() < 0.4 else rng.randrange(1, 30), rng.randrange(3)) for i in range(600)]
    orders += [(9999, 0, 1)] * 200 + [(5000, None, 1)]
    customers = [(c, f"c{c}") for c in range(40)]
    return TableSet.of(spark, {
        "orders": spark.createDataFrame(orders, "id int, cust int, n int"),
        "customers": spark.createDataFrame(customers, "id int, name string"),
    }), orders, customers


def test_lookup_rows_are_all_matches(shop):
    ts, orders, customers = shop
    got = {}
    for r in D.lookup_rows(ts["customers"], ts["orders"], "id", "cust", "found", keep_empty=True).collect():
        got.setdefault(r.id, []).extend([tuple(r.found)] if r.found else [])
    assert {k: sorted(v) for k, v in got.items()} == {
        c: sorted(o for o in orders if o[1] == c) for c, _ in customers
    }


@pytest.mark.parametrize("matches", [10, 20_000])
def test_answers_do_not_depend_on_how_many_match(spark, matches):
    ts = TableSet.of(spark, {
        "people": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string"),
        "visits": spark.range(matches).selectExpr("1 AS who", "id AS n").unionAll(spark.sql("SELECT 2 AS who, 0L AS n")),
    })
    look = {"$lookup": {"from": "visits", "localField": "id", "foreignField": "who", "as": "v"}}
    run = lambda *stages: sorted(tuple(r) for r in D.pipeline(ts, "people", [look, *stages]).collect())
    assert run({"$count": "n"}) == [(3,)]
    assert run({"$match": {"v.n": {"$gte": 0}}}, {"$count": "n"}) == [(2,)]
    assert run({"$match": {"v": []}}, {"$project": {"name": 1}}) == [("c",)]
    assert run({"$match": {"v": {"$ne": []}}}, {"$project": {"v": 0}}) == [(1, "a"), (2, "b")]
    assert run({"$group": {"_id": None, "n": {"$sum": 1}, "visits": {"$sum": {"$size": "$v"}}}}) == [(None, 3, matches + 1)]
    assert run({"$sort": {"id": -1}}, {"$limit": 2}, {"$project": {"name": 1, "n": {"$size": "$v"}}}) == [("b", 1), ("c", 0)]
    assert run({"$project": {"id": 1, "n": {"$size": "$v"}}}, {"$match": {"n": {"$gt": 1}}}) == [(1, matches)]
    assert run({"$match": {"id": 1}}, {"$unwind": "$v"}, {"$group": {"_id": "$id", "top": {"$max": "$v.n"}}}) == [(1, matches - 1)]
    assert len(run()) == matches + 2


def test_stages_that_need_the_array_are_errors(shop):
    ts, *_ = shop
    look = {"$lookup": {"from": "orders", "localField": "id", "foreignField": "cust", "as": "o"}}
    for stage in (
        {"$project": {"o": 1}}, {"$match": {"o": {"$size": 3}}}, {"$match": {"o.n": {"$ne": 1}}}, {"$sort": {"o.n": 1}},
        {"$match": {"$or": [{"o.n": 1}, {"id": 2}]}}, {"$group": {"_id": "$o.n", "k": {"$sum": 1}}}, {"$match": {"o.n": {"$gt": 1, "$lt": 3}}},
    ):
        with pytest.raises(ValueError, match="unwind it first"):
            D.pipeline(ts, "customers", [look, stage])


def test_lookup_then_unwind_size_or_neither(shop):
    ts, orders, customers = shop
    look = {"$lookup": {"from": "orders", "localField": "id", "foreignField": "cust", "as": "o"}}
    joined = D.pipeline(ts, "customers", [look, {"$unwind": "$o"}])
    assert joined.count() == sum(o[1] is not None for o in orders)
    kept = D.pipeline(ts, "customers", [look, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}])
    empty = len({c for c, _ in customers} - {o[1] for o in orders})
    assert kept.count() == joined.count() + empty
    sized = D.pipeline(ts, "customers", [look, {"$project": {"id": 1, "n": {"$size": "$o"}}}])
    assert {r.id: r.n for r in sized.collect()} == {c: sum(o[1] == c for o in orders) for c, _ in customers}
    apart = D.pipeline(ts, "customers", [look, {"$match": {"id": {"$lt": 3}}}, {"$unwind": "$o"}, {"$group": {"_id": "$id", "n": {"$sum": 1}}}])
    assert {r._id: r.n for r in apart.collect()} == {c: sum(o[1] == c for o in orders) for c in range(3)}
    for fused in (joined, sized):
        assert "collect_list" not in fused._jdf.queryExecution().optimizedPlan().toString()


def test_group_forms(shop):
    ts, orders, _ = shop
    out = D.pipeline(ts, "orders", [
        {"$match": {"cust": {"$ne": None}}},
        {"$group": {"_id": "$cust", "total": {"$sum": "$n"}, "avg": {"$avg": "$n"}, "rows": {"$count": {}}, "twice": {"$sum": 2}}},
        {"$sort": {"total": -1, "_id": 1}}, {"$limit": 3},
    ]).collect()
    sums = {}
    for _, c, n in orders:
        if c is not None:
            sums.setdefault(c, []).append(n)
    expected = sorted(sums.items(), key=lambda kv: (-sum(kv[1]), kv[0]))[:3]
    assert [(r._id, r.total, r.rows, r.twice) for r in out] == [(c, sum(v), len(v), 2 * len(v)) for c, v in expected]
    whole = D.group(ts["orders"], None, {"n": {"$sum": "$n"}}).first()
    assert (whole._id, whole.n) == (None, sum(o[2] for o in orders))


def test_unwind(typed):
    assert D.unwind(typed, "$tags").count() == 3
    assert D.unwind(typed, "tags", keep_empty=True).count() == 5
    assert D.unwind(typed, "$tags").columns == typed.columns


def test_lookup_of_rows_that_hold_maps(spark):
    other = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 1}), (1, {"b": 2}), (2, None)], "k int, m map<string,int>")
    rows = D.lookup_rows(spark.createDataFrame([(1,), (2,), (3,)], "id int"), other, "id", "k", "o", keep_empty=True).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).extend([r.o.m] if r.o else [])
    assert sorted(map(str, got[1])) == ["{'a': 1}", "{'a': 1}", "{'b': 2}"] and got[2] == [None] and got[3] == []


def test_skip(typed):
    rows = D.find(typed, sort={"_id": 1}, skip=1, limit=2).collect()
    assert [r._id for r in rows] == [2, 3]
    assert D.find(typed, skip=3).count() == 1
