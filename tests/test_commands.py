import pytest
from pyspark.sql import functions as F

from tablewarden.operators.commands import run_command
from tablewarden.sources.tables import TableSet


@pytest.fixture
def store(spark, docs):
    """A depot: typed machines, and schema-less repairs of them."""
    machines = spark.createDataFrame(
        [(1, "lathe", 4, "north"), (2, "press", 9, "south"), (3, "lathe", None, "south"), (3, "drill", 2, None)],
        "serial int, sort string, age int, hall string",
    )
    repairs = docs(
        '{"_id":"r1","machine":1,"hours":2.5,"parts":["belt"],"shop":{"city":"Graz"}}', '{"_id":"r2","machine":2.0,"hours":8}',
        '{"_id":"r3","machine":"1","hours":1}', '{"_id":"r4","hours":4}', '{"_id":"r5","machine":1,"hours":0.5}',
    )
    return TableSet.of(spark, {"machines": machines, "repairs": repairs}, keys={"machines": ("serial",)})


def rows(answer, *names):
    return sorted((tuple(r) for r in answer.rows.select(*names).collect()), key=repr)


def shown(answer):
    """All rows, schema-less values as text."""
    plain = [
        F.when(~F.is_variant_null(F.col(c)), F.col(c).try_cast("string")).alias(c) if t == "variant" else F.col(c)
        for c, t in answer.rows.dtypes
    ]
    return sorted((tuple(r) for r in answer.rows.select(*plain).collect()), key=repr)


def test_reading(store):
    assert rows(run_command(store, '{"find": "machines", "filter": {"age": {"$lt": 5}}, "projection": {"hall": 1}}'), "hall") == [("north",), (None,)]
    oldest = run_command(store, {"find": "machines", "sort": {"age": -1}, "limit": 1})
    assert rows(oldest, "serial") == [(2,)]
    assert run_command(store, {"count": "machines", "query": {"hall": "south"}}).rows.first().n == 2
    by_sort = run_command(store, {"aggregate": "machines", "pipeline": [{"$group": {"_id": "$sort", "oldest": {"$max": "$age"}}}]})
    assert rows(by_sort, "_id", "oldest") == [("drill", 2), ("lathe", 4), ("press", 9)]
    assert run_command(store, {"count": "repairs", "query": {"hours": {"$gte": 2.5}}}).rows.first().n == 3


def test_pages(store):
    page = run_command(store, {"find": "repairs", "sort": {"hours": 1}, "skip": 1, "limit": 2}).rows
    assert [r[0] for r in page.select(F.try_variant_get("doc", "$._id", "string")).collect()] == ["r3", "r1"]
    assert run_command(store, {"find": "machines", "skip": 3}).rows.count() == 1
    assert run_command(store, {"count": "machines", "query": {}, "skip": 1, "limit": 2}).rows.first().n == 2
    assert run_command(store, {"count": "machines", "skip": 9}).rows.first().n == 0
    wrapped = {"collection": "machines", "query": {}, "options": {"sort": {"serial": 1, "sort": 1}, "skip": 1, "limit": 1}}
    assert rows(run_command(store, wrapped), "serial") == [(2,)]


@pytest.mark.parametrize("command", [
    {"find": "machines", "filter": {}, "hint": "x"},
    {"find": "machines", "filters": {}},
    {"count": "machines", "collation": {}},
    {"aggregate": "machines", "pipeline": [], "explain": True},
    {"update": "machines", "updates": [{"q": {}, "u": {"$set": {"age": 1}}, "arrayFilters": []}]},
    {"delete": "machines", "deletes": [{"q": {}, "limit": 1, "hint": "x"}]},
    {"collection": "machines", "type": "delete", "query": {}, "options": {"deleteAll": True}},
    {"collection": "machines", "type": "update", "query": {}, "options": {"update": {"$set": {"age": 1}}, "many": True}},
    {"collection": "machines", "query": {}, "projection": {}},
    {"renameCollection": "machines"},
])
def test_what_is_not_understood_is_refused(store, command):
    with pytest.raises(ValueError):
        run_command(store, command)


def test_upsert(store):
    one = {"q": {"serial": 8, "hall": {"$eq": "west"}, "age": {"$gt": 1}}, "u": {"$set": {"sort": "saw"}}, "upsert": True}
    added = run_command(store, {"update": "machines", "updates": [one]})
    assert added.rows.first().n == 1 and added.tables["machines"].count() == 5
    assert [tuple(r) for r in added.tables["machines"].where("serial = 8").collect()] == [(8, "saw", None, "west")]
    # absent for the first update, there for the second
    known = {"q": {"serial": 8}, "u": {"$set": {"age": 1}}, "upsert": True, "multi": True}
    both = run_command(store, {"update": "machines", "updates": [one, known]})
    assert both.rows.first().n == 2
    assert [tuple(r) for r in both.tables["machines"].where("serial = 8").collect()] == [(8, "saw", 1, "west")]
    assert run_command(store, {"update": "machines", "updates": [one | {"upsert": False}]}).rows.first().n == 0
    loose = {"collection": "repairs", "type": "update", "query": {"_id": "new", "shop.city": "Linz"}, "options": {"update": {"$set": {"hours": 3}}, "upsert": True}}
    after = run_command(store, loose).tables
    assert run_command(after, {"count": "repairs", "query": {"shop.city": "Linz", "hours": 3}}).rows.first().n == 1


def test_the_wrapped_form_keeps_its_options(store):
    changed = run_command(store, {"collection": "machines", "type": "update", "query": {"sort": "lathe"}, "options": {"update": {"$set": {"age": 0}}}})
    assert changed.rows.first().n == 1
    assert [r.serial for r in changed.tables["machines"].where("age = 0").collect()] == [1]
    gone = run_command(store, {"collection": "machines", "type": "delete", "query": {"hall": "south"}, "options": {"deleteMany": True}})
    assert (gone.rows.first().n, gone.tables["machines"].count()) == (2, 2)
    with pytest.raises(ValueError):
        run_command(store, {"collection": "machines", "type": "update", "query": {}})


def test_one_is_one_where_the_key_repeats(store):
    twice = store.with_table("machines", store["machines"].unionAll(store["machines"]))
    updated = run_command(twice, {"update": "machines", "updates": [{"q": {"serial": 3}, "u": {"$set": {"hall": "moved"}}}]})
    assert updated.rows.first().n == 1 and updated.tables["machines"].where("hall = 'moved'").count() == 1
    deleted = run_command(twice, {"delete": "machines", "deletes": [{"q": {"serial": 3}, "limit": 1}]})
    assert deleted.rows.first().n == 1 and deleted.tables["machines"].count() == 7
    loose = store.with_table("repairs", store["repairs"].unionAll(store["repairs"]))
    left = run_command(loose, {"delete": "repairs", "deletes": [{"q": {"hours": 8}, "limit": 1}]})
    assert left.rows.first().n == 1 and left.tables["repairs"].count() == 9
    none = run_command(twice, {"delete": "machines", "deletes": [{"q": {"serial": 77}, "limit": 1}]})
    assert none.rows.first().n == 0 and none.tables["machines"].count() == 8


def test_writing(store):
    more = run_command(store, {"insert": "machines", "documents": [{"serial": 5, "sort": "mill"}, {"serial": 6}]})
    assert more.rows.first().n == 2 and more.tables["machines"].count() == 6
    loose = run_command(store, {"insert": "repairs", "documents": [{"_id": "r9", "notes": ["late"]}]}).tables
    assert run_command(loose, {"count": "repairs", "query": {"notes": "late"}}).rows.first().n == 1
    both = run_command(store, {"update": "machines", "updates": [
        {"q": {"hall": "south"}, "u": {"$set": {"sort": "idle"}}, "multi": True}, {"q": {"sort": "idle"}, "u": {"$set": {"age": 1}}},
    ]})
    assert both.rows.first().n == 3
    assert rows(run_command(both.tables, {"find": "machines", "filter": {"sort": "idle"}}), "serial", "age") == [(2, 1), (3, None)]
    seen = run_command(store, {"update": "repairs", "updates": [{"q": {}, "u": {"$set": {"seen": True}}}]}).tables
    assert run_command(seen, {"count": "repairs", "query": {"seen": True, "_id": "r1"}}).rows.first().n == 1
    assert run_command(seen, {"count": "repairs", "query": {"seen": True}}).rows.first().n == 1


def test_stages_over_loose_documents(store):
    run = lambda *stages: run_command(store, {"aggregate": "repairs", "pipeline": list(stages)})
    total = run({"$match": {"hours": {"$gt": 1}}}, {"$group": {"_id": None, "hours": {"$sum": "$hours"}, "n": {"$count": {}}}}).rows.first()
    assert (total.hours, total.n) == (14.5, 3)
    longest = run_command(store, {"find": "repairs", "sort": {"hours": -1}, "limit": 1}).rows
    assert longest.select(F.try_variant_get("doc", "$._id", "string")).first()[0] == "r2"
    per_machine = run({"$match": {"machine": {"$exists": True}}}, {"$group": {"_id": "$machine", "hours": {"$sum": "$hours"}}})
    assert shown(per_machine) == [("1", 1.0), ("1", 3.0), ("2", 8.0)]
    twin = run({"$group": {"_id": {"m": "$machine"}, "n": {"$count": {}}}}, {"$project": {"_id": 0, "m": "$_id.m", "n": 1}})
    assert shown(twin) == [("1", 1), ("1", 2), ("2", 1), (None, 1)]
    bounds = run({"$group": {"_id": None, "least": {"$min": "$machine"}, "most": {"$max": "$machine"}}})
    assert shown(bounds) == [(None, "1", "1")]
    rest = run_command(store, {"find": "repairs", "filter": {"_id": "r5"}, "projection": {"hours": 0}}).rows
    assert rest.select(F.to_json("doc")).first()[0] == '{"_id":"r5","machine":1}'


def test_lookup_between_loose_documents(store, docs):
    halls = docs('{"_id":1,"hall":{"name":"A","gate":3}}', '{"_id":2,"hall":{"name":"B"}}', '{"_id":7}')
    ts = store.with_table("places", halls)
    look = {"$lookup": {"from": "places", "localField": "machine", "foreignField": "_id", "as": "place"}}
    run = lambda *stages: shown(run_command(ts, {"aggregate": "repairs", "pipeline": [look, *stages]}))
    unwound = [{"$unwind": "$place"}, {"$project": {"hours": 1, "where": "$place.hall.name", "gate": "$place.hall.gate"}}]
    expected = [("r1", "2.5", "A", "3"), ("r2", "8", "B", None), ("r5", "0.5", "A", "3")]
    assert run(*unwound) == expected
    assert run({"$match": {"hours": {"$gt": 0}}}, *unwound) == expected
    assert run({"$match": {"place.hall.gate": 3}}, {"$project": {"hours": 1}}) == [("r1", "2.5"), ("r5", "0.5")]
    counts = run({"$project": {"n": {"$size": "$place"}}})
    assert counts == [("r1", 1), ("r2", 1), ("r3", 0), ("r4", 0), ("r5", 1)]
    assert run_command(ts, {"aggregate": "repairs", "pipeline": [look]}).rows.where("place IS NULL").count() == 2


def test_unwind_inside_loose_documents(spark, docs):
    ts = TableSet.of(spark, {"p": docs('{"_id":1,"tags":["a","b"]}', '{"_id":2,"tags":"c"}', '{"_id":3,"tags":[]}', '{"_id":4}')})
    stages = [{"$unwind": "$tags"}, {"$group": {"_id": "$tags", "n": {"$sum": 1}}}, {"$sort": {"_id": -1}}]
    out = run_command(ts, {"aggregate": "p", "pipeline": stages}).rows
    assert [(r[0], r[1]) for r in out.select(F.col("_id").try_cast("string"), "n").collect()] == [("c", 1), ("b", 1), ("a", 1)]
    kept = [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}}]
    assert run_command(ts, {"aggregate": "p", "pipeline": kept}).rows.count() == 5
