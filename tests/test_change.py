import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import change as C
from tablewarden.operators import compare as X
from tablewarden.sources.tables import CASCADE, SET_NULL, Reference, TableSet

NOW = datetime(2024, 1, 1)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, None, 7)], "id int, name string, n int")


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_add_column(spark, people):
    out = C.add_column(people, "phone", "VARCHAR(20)", "+1-555-0000", not_null=True)
    assert {r.phone for r in out.collect()} == {"+1-555-0000"}
    assert dict(C.add_column(people, "price", "DECIMAL(10,2)").dtypes)["price"] == "decimal(10,2)"
    assert dict(C.add_column(people, "tags", "TEXT[]").dtypes)["tags"] == "array<string>"
    with pytest.raises(ValueError):
        C.add_column(people, "name", "TEXT")
    with pytest.raises(ValueError):
        C.add_column(people, "x", "INT", not_null=True)
    assert "x" in C.add_column(people.limit(0), "x", "INT", not_null=True).columns


def test_drop_and_rename_follow_declarations(spark, people):
    child = spark.createDataFrame([(1, "a")], "id int, person string")
    ts = TableSet.of(
        spark, {"p": people, "c": child}, keys={"p": ("id",)}, uniques={"p": [("name",)]},
        references=[Reference("c", "person", "p", "name")],
    )
    with pytest.raises(ValueError):
        C.drop_column(ts, "p", "id")
    with pytest.raises(ValueError):
        C.drop_column(ts, "p", "name")
    dropped = C.drop_column(ts, "p", "name", cascade=True)
    assert dropped["p"].columns == ["id", "n"] and dropped.references == [] and dropped.uniques == {"p": []}
    renamed = C.rename_column(ts, "p", "name", "label")
    assert renamed.references[0].parent_column == "label" and renamed.uniques["p"] == [("label",)]
    with pytest.raises(ValueError):
        C.rename_column(ts, "p", "name", "n")
    with pytest.raises(KeyError):
        C.rename_column(ts, "p", "zzz", "y")


def as_json(df):
    return sorted(r[0] for r in df.select(F.to_json("doc")).collect())


def test_loose_fields(docs):
    frame = docs('{"_id":1,"a":1,"x":{"y":1,"z":2}}', '{"_id":2}')
    assert as_json(C.add_field(frame, "s", "string", required=True, now=NOW))[1] == '{"_id":2,"s":""}'
    assert as_json(C.add_field(frame, "s", "number", "12", now=NOW))[1] == '{"_id":2,"s":12.0}'
    assert as_json(C.add_field(frame, "s", "array", "nope", now=NOW))[1] == '{"_id":2,"s":[]}'
    assert as_json(C.add_field(frame, "s", "object", '{"q":1}', now=NOW))[1] == '{"_id":2,"s":{"q":1}}'
    assert as_json(C.add_field(frame, "s", "string", now=NOW))[1] == '{"_id":2,"s":null}'
    with pytest.raises(ValueError):
        C.add_field(frame, "a", "string", now=NOW)
    assert as_json(C.remove_field(frame, "x.y"))[0] == '{"_id":1,"a":1,"x":{"z":2}}'
    assert C.field_count(frame, "x.y").first().documents == 1
    with pytest.raises(ValueError):
        C.remove_field(frame, "_id")
    assert as_json(C.rename_field(frame, "a", "b")) == ['{"_id":1,"b":1,"x":{"y":1,"z":2}}', '{"_id":2}']
    with pytest.raises(ValueError):
        C.rename_field(frame, "a", "x")
    changed = C.update(frame, {"a": 1}, {"$set": {"x.y": 9, "k": [1]}, "$unset": {"a": ""}}, multi=True)
    assert as_json(changed) == ['{"_id":1,"k":[1],"x":{"y":9,"z":2}}', '{"_id":2}']


def test_typed_nested_fields(spark):
    df = spark.createDataFrame([((1, 2),)], "s struct<a: int, b: int>")
    assert C.remove_field(df, "s.a").first().s.asDict() == {"b": 2}
    assert C.set_field(df, "s.a", F.lit(9)).first().s.a == 9
    with pytest.raises(KeyError):
        C.remove_field(df, "s.q")


def test_update(people):
    every = C.update(people, {"n": {"$gte": 5}}, {"$set": {"name": "z"}}, multi=True)
    assert rows(every, "id", "name") == [(1, "z"), (2, "b"), (3, "z")]
    one = C.update(people, {"n": {"$gte": 5}}, {"$set": {"n": 0}}, key=("id",))
    assert rows(one, "id", "n") == [(1, 0), (2, None), (3, 7)]
    swap = C.update(people, {"n": 5}, {"$set": {"n": 6, "name": "q"}}, multi=True)
    assert (1, "q", 6) in rows(swap, "id", "name", "n")
    with pytest.raises(ValueError):
        C.update(people, {}, {"$inc": {"n": 1}}, multi=True)


def test_delete_keeps_what_is_unknown(people):
    assert rows(C.delete(people, {"n": {"$lt": 6}}), "id") == [(2,), (3,)]
    assert rows(C.delete(people, "name <> 'a'"), "id") == [(1,), (3,)]
    assert rows(C.delete(people, {}, many=False, key=("id",)), "id") == [(2,), (3,)]


def test_upsert(spark, people):
    source = spark.createDataFrame([(1, None), (4, "d"), (4, "e")], "id int, name string")
    merged = C.upsert(people, source, ("id",), order=F.col("name"))
    assert rows(merged, "id", "name", "n") == [(1, None, 5), (2, "b", None), (3, None, 7), (4, "e", None)]
    whole = C.upsert(people, source, ("id",), replace_row=True, order=F.col("name"))
    assert (1, None, None) in rows(whole, "id", "name", "n")
    wider = C.upsert(people, source.withColumn("extra", F.lit(1)), ("id",), order=F.col("name"))
    assert rows(wider, "id", "extra") == [(1, 1), (2, None), (3, None), (4, 1)]
    assert wider.columns == ["id", "name", "n", "extra"]
    assert C.upsert(people, source.limit(0), ("id",)).count() == 3


def test_seed(spark, people):
    seed = spark.createDataFrame([(1, "new", 0), (9, "x", 0), (9, "y", 0), (None, "z", 0), (None, "z", 0)], "id int, name string, n int")
    out, report = C.seed(people, seed, [("id",)])
    assert rows(out.where("id > 3 or id is null"), "id", "name") == [(9, "x"), (None, "z"), (None, "z")]
    assert tuple(report.first()) == (5, 3, 6)
    again, report = C.seed(out, seed.where("id is not null"), [("id",)])
    assert tuple(report.first()) == (3, 0, 6)


def test_seed_with_several_keys_is_like_row_by_row(spark):
    rng = random.Random(4)
    target = [(i, 1000 + i) for i in range(5)]
    seed = [(o, rng.choice([None, *range(40)]), rng.choice([None, *range(990, 1030)])) for o in range(120)]
    a, b = {t[0] for t in target}, {t[1] for t in target}
    expected = []
    for o, x, y in seed:
        if (x is not None and x in a) or (y is not None and y in b):
            continue
        expected.append((o, x, y))
        a.add(x)
        b.add(y)
    base = spark.createDataFrame([(0, *t) for t in target], "o int, x int, y int")
    got = C.seed_rows(base, spark.createDataFrame(seed, "o int, x int, y int"), [("x",), ("y",)], order=F.col("o"))
    assert rows(got, "o", "x", "y") == sorted(expected, key=repr)


def test_affected_rides_on_the_action(people):
    watched, seen = C.affected(people, {"n": {"$gte": 5}})
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"affected": 2}


def test_soft_delete(people):
    marked = people.withColumn("deleted_at", F.lit(None).cast("timestamp")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    out = C.soft_delete(marked, {"n": 5}, NOW)
    assert rows(C.live(out), "id") == [(2,), (3,)]
    assert out.where("id = 1").first().updated_at == out.where("id = 1").first().deleted_at


@pytest.fixture
def tree(spark):
    """employees <- employees (boss, cycle 7-8-9), notes cascade, badges are cleared."""
    staff = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, None), (6, 5), (7, 9), (8, 7), (9, 8)], "id int, boss int")
    notes = spark.createDataFrame([(10, 1), (11, 3), (12, 5), (13, None), (14, 8)], "id int, who int")
    badges = spark.createDataFrame([(20, 3), (21, 5), (22, 7)], "id int, who int")
    return TableSet.of(spark, {"staff": staff, "notes": notes, "badges": badges}, references=[
        Reference("staff", "boss", "staff", "id", CASCADE), Reference("notes", "who", "staff", "id", CASCADE),
        Reference("badges", "who", "staff", "id", SET_NULL),
    ])


def test_cascade_through_a_tree_and_a_cycle(tree):
    after = C.delete_cascade(tree, "staff", "id IN (1, 7)")
    assert rows(after["staff"], "id") == [(5,), (6,)]
    assert rows(after["notes"], "id") == [(12,), (13,)]
    assert rows(after["badges"], "id", "who") == [(20, None), (21, 5), (22, None)]
    assert rows(C.delete_cascade(tree, "staff", "id = 4")["staff"], "id") == [(i,) for i in (1, 2, 3, 5, 6, 7, 8, 9)]


def test_impact(tree):
    got = {(r.table_name, r.reference): r.rows for r in C.impact(tree, "staff", "id = 1").collect()}
    assert got == {("staff", None): 1, ("staff", "staff.boss->staff.id"): 3, ("notes", "notes.who->staff.id"): 2, ("badges", "badges.who->staff.id"): 1}


def test_other_actions_refuse(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1,)], "a int")
    ts = TableSet.of(spark, {"a": a, "b": b}, references=[Reference("b", "a", "a", "id")])
    with pytest.raises(ValueError):
        C.delete_cascade(ts, "a", "id = 1")
    assert C.delete_cascade(ts, "a", "id = 2")["a"].count() == 1


def test_drop_table_copies_first(spark, people, scratch):
    ts = TableSet.of(spark, {"p": people}, keys={"p": ("id",)})
    out, path = C.drop_table(ts, "p", scratch, NOW)
    assert out.names == [] and path.endswith("backup_p_20240101T000000.parquet")
    assert spark.read.parquet(path).count() == 3


def test_states(spark, people):
    ts = TableSet.of(spark, {"p": people, "q": people})
    same = X.diff_states(X.capture_state(ts), X.capture_state(ts))
    assert same.count() == 0 and X.verdict(same).first().safe
    trial = X.rehearse(ts, lambda t: C.drop_column(t, "p", "n"), "drop_column")
    assert not X.verdict(trial.findings).first().safe
    with pytest.raises(ValueError, match="column removed p.n"):
        trial.result()
    called = []
    fine = X.rehearse(ts, lambda t: t.with_table("q", C.insert(t["q"], people)), "insert", called.append)
    assert fine.result()["q"].count() == 6 and called == []
    X.rehearse(ts, lambda t: t, "delete", called.append)
    assert called == [ts]


def test_row_differences(spark):
    cols = "id int, a string, b string"
    before = spark.createDataFrame([(1, None, "x"), (2, "x", "y"), (3, "q", "q"), (5, "m", "m"), (5, "m", "m")], cols)
    after = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (4, "q", "q"), (5, "m", "m")], cols)
    got = {r.id: r.change for r in X.diff_rows(before, after, ("id",)).collect()}
    assert got == {1: "changed", 3: "removed", 4: "added", 5: "changed"}
    assert X.diff_rows(before, before.repartition(5), ("id",)).count() == 0


def test_several_edits_at_once(docs):
    """The same documents as edit by edit, and one refusal for all taken names."""
    import json
    from datetime import datetime

    now = datetime(2024, 1, 1)
    made = docs('{"a":1,"b":{"c":2,"d":3},"e":null}', '{"a":5}', '{}', '[1]', '{"b":"text","z":0}')
    edits = C.DocumentEdits(now).rename("a", "n").set("b.x", F.lit(1)).remove("b.c").add("new", "number", required=True).remove("e")
    one = C.remove_field(C.set_field(C.rename_field(made, "a", "n"), "b.x", F.lit(1)), "b.c")
    one = C.remove_field(C.add_field(one, "new", "number", required=True, now=now), "e")
    text = lambda df: sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in df.select(F.to_json("doc")).collect())
    assert text(edits.apply(made)) == text(one)
    chained = C.DocumentEdits(now).rename("a", "n").rename("n", "m").add("a", "string").apply(docs('{"a":1}'))
    assert text(chained) == ['{"a": null, "m": 1}']
    with pytest.raises(ValueError, match="b, z"):
        C.DocumentEdits(now).rename("a", "b").add("z", "string").apply(made)
    with pytest.raises(ValueError):
        C.DocumentEdits(now).set("q", F.lit(1)).add("q", "string").apply(made)
    with pytest.raises(ValueError):
        C.DocumentEdits(now).remove("_id")


def test_null_keys_equal_nothing(spark):
    base = spark.createDataFrame([(1, "a"), (None, "b")], "id int, v string")
    source = spark.createDataFrame([(None, "x"), (None, "y"), (1, "c"), (1, "b")], "id int, v string")
    got = C.upsert(base, source, ("id",)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "c"), (None, "b"), (None, "x"), (None, "y")], key=repr)
