from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import layout as N
from tablewarden.operators import migrate as M
from tablewarden.operators import snapshot as K

from tablewarden.runtime import list_dir, read_small_file, write_small_file
from tablewarden.sources.documents import read_documents, read_seed, read_seed_lines, write_seed_lines
from tablewarden.sources.sinks import clone, copy_table
from tablewarden.sources.tables import TableSet, jdbc_options

NOW = datetime(2024, 1, 1, 12)


@pytest.fixture
def varied(spark):
    df = spark.createDataFrame(
        [(1, 'q"\\\n', 0.1, True, Decimal("1.50"), ["a", None], {"k": 1}), (2, None, None, None, None, None, None),
         (3, "é", float("inf"), False, Decimal("-2.25"), [], {})],
        "id long, s string, d double, b boolean, m decimal(10,2), a array<string>, o map<string,int>",
    ).withColumns({
        "t": F.lit("2024-01-01 00:00:00.123456").cast("timestamp_ntz"), "z": F.lit("2024-01-01 00:00:00.123456").cast("timestamp"),
        "x": F.encode(F.lit("bytes"), "utf-8"), "st": F.struct(F.lit(1).alias("p"), F.lit(None).cast("string").alias("q")),
    })
    return TableSet.of(spark, {"v": df, "empty": df.limit(0)}, keys={"v": ("id",)})


def content(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("how", [{}, {"fmt": "json"}, {"key": True}, {"key": True, "mode": "GCM"}])
def test_snapshot_and_back(spark, varied, scratch, how):
    how = dict(how)
    key = f"{scratch}/key" if how.pop("key", None) else None
    if key:
        K.new_key(spark, key)
        assert len(read_small_file(spark, key)) == 32
        how["key_file"] = key
    manifest = K.snapshot(varied, f"{scratch}/s", now=NOW, **how)
    assert {r.table_name: r.rows for r in manifest.collect()} == {"v": 3, "empty": 0}
    back = K.restore(spark, f"{scratch}/s", key)
    assert back["v"].schema.simpleString() == varied["v"].schema.simpleString()
    assert content(back["v"]) == content(varied["v"]) and back["empty"].count() == 0
    assert all(r.ok for r in K.verify_snapshot(spark, f"{scratch}/s", key).collect())


def test_encrypted_rows_hide_their_text_and_their_key(spark, varied, scratch):
    K.new_key(spark, f"{scratch}/key")
    K.snapshot(varied.only("v"), f"{scratch}/s", now=NOW, key_file=f"{scratch}/key")
    raw = spark.read.parquet(f"{scratch}/s/v")
    assert raw.columns == ["sealed"] and b'"id"' not in bytes(raw.first().sealed)
    secret = read_small_file(spark, f"{scratch}/key").hex()
    plan = K.restore(spark, f"{scratch}/s", f"{scratch}/key")["v"]._jdf.queryExecution().toString()
    assert secret not in plan.lower()
    with pytest.raises(ValueError):
        K.restore(spark, f"{scratch}/s")
    with pytest.raises(Exception):
        K.new_key(spark, f"{scratch}/key")


def test_damage_is_noticed(spark, varied, scratch):
    K.snapshot(varied.only("v"), f"{scratch}/s", now=NOW)
    varied["v"].where("id <> 2").write.mode("overwrite").parquet(f"{scratch}/s/v")
    assert not K.verify_snapshot(spark, f"{scratch}/s").first().ok
    varied["v"].withColumn("id", F.when(F.col("id") == 2, 9).otherwise(F.col("id"))).write.mode("overwrite").parquet(f"{scratch}/s/v")
    assert not K.verify_snapshot(spark, f"{scratch}/s").first().ok


def test_listing_and_expiry(spark, varied, scratch):
    ts = varied.only("v")
    K.snapshot(ts, f"{scratch}/a", now=NOW, keep=K.TEMPORARY)
    K.snapshot(ts, f"{scratch}/b", now=NOW + timedelta(hours=1))
    write_small_file(spark, f"{scratch}/unfinished/part", b"x")
    listed = K.list_snapshots(spark, scratch, NOW + timedelta(hours=2)).collect()
    assert [(r.snapshot, r.age_seconds, r.left_seconds) for r in listed] == [
        ("b", 3600, 30 * 86400 - 3600), ("a", 7200, 7200),
    ]
    assert listed[0].bytes > 0 and listed[0].restorable
    assert K.expire_snapshots(spark, scratch, NOW + timedelta(hours=3)) == []
    assert K.expire_snapshots(spark, scratch, NOW + timedelta(hours=4)) == ["a"]
    assert [r.snapshot for r in K.list_snapshots(spark, scratch, NOW).collect()] == ["b"]


def test_rows_without_a_time_never_expire(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 11)), (2, datetime(2024, 1, 1, 8)), (3, None)], "id int, t timestamp")
    assert [r.id for r in K.expire(df, "t", timedelta(hours=4), NOW).collect()] == [1, 3]


def test_restore_replaces_or_merges(spark, varied, scratch):
    ts = varied.only("v")
    K.snapshot(ts, f"{scratch}/s", now=NOW)
    back = K.restore(spark, f"{scratch}/s")
    damaged = ts.with_table("v", ts["v"].where("id = 1").withColumn("s", F.lit("bad")).unionByName(ts["v"].where("id = 1").withColumn("id", F.lit(7).cast("long"))))
    assert content(K.restore_into(damaged, back)["v"]) == content(ts["v"])
    merged = K.restore_into(damaged, back, replace=False)["v"]
    assert sorted(r.id for r in merged.collect()) == [1, 2, 3, 7] and merged.where("id = 1").first().s != "bad"


def test_migrations_run_once_and_all_or_nothing(spark, scratch):
    store = M.VersionedStore(spark, scratch)
    store.publish({"t": spark.createDataFrame([(1, "test1"), (2, "test2")], "id int, name string"), "u": spark.range(2)})
    steps = [
        M.Migration("002", (("t", "SELECT *, upper(name) AS big FROM t"),)),
        M.Migration("001", (("t", "SELECT id, concat(name, ';') AS name FROM t"),)),
    ]
    assert M.apply_migrations(store, steps, NOW) == ["001", "002"]
    assert M.apply_migrations(store, steps, NOW) == []
    assert sorted(tuple(r) for r in store.open()["t"].collect()) == [(1, "test1;", "TEST1;"), (2, "test2;", "TEST2;")]
    assert [r.name for r in M.ledger(store.open()).collect()] == ["001", "002"]
    assert M.is_applied(store.open(), "001") and not M.is_applied(store.open(), "003")
    before = store.versions()
    broken = [M.Migration("003", (("u", "SELECT id + 1 AS id FROM u"), ("t", "SELECT raise_error('no') AS id FROM t")))]
    with pytest.raises(Exception):
        M.apply_migrations(store, broken, NOW)
    assert store.versions() == before and sorted(r.id for r in store.open()["u"].collect()) == [0, 1]
    assert store.open(1)["t"].columns == ["id", "name"]
    added = [*steps, M.Migration("004", change=lambda ts: {"v": ts["u"].limit(1)})]
    assert M.apply_migrations(store, added, NOW) == ["004"]
    assert store.open()["v"].count() == 1


def test_only_one_of_two_writers_wins(spark, scratch):
    store = M.VersionedStore(spark, scratch)
    store.publish({"t": spark.range(1)})
    store.publish({"t": spark.range(2)}, base=1)
    with pytest.raises(Exception):
        store.publish({"t": spark.range(3)}, base=1)
    assert store.open()["t"].count() == 2


def test_text_index(spark):
    df = spark.createDataFrame([(1, "The cat. The-dog's", "CAT"), (2, "Ölberg 42", None), (3, None, None)], "id int, a string, b string")
    index = N.build_text_index(df, "id", ["a", "b"])
    assert {(r.term, r.key): r.tf for r in index.collect()} == {
        ("the", 1): 2, ("cat", 1): 2, ("dog", 1): 1, ("s", 1): 1, ("ölberg", 2): 1, ("42", 2): 1,
    }
    assert {(r.key, r.terms, r.score) for r in N.text_lookup(index, ["Cat", "42", "the"]).collect()} == {(1, 2, 4), (2, 1, 1)}
    assert [r.key for r in N.text_lookup(index, ["cat", "THE"], every=True).collect()] == [1]


def test_clusters_are_narrow_and_even(spark, scratch):
    """A third of the rows share one value and still spread over files."""
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1000).alias("v"))
    N.cluster(df, ["v"], 9).write.parquet(f"{scratch}/c")
    sizes = spark.read.parquet(f"{scratch}/c").groupBy(F.input_file_name().alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).collect()
    assert sum(r.n for r in sizes) == 9000 and max(r.n for r in sizes) < 2500
    assert sum(r.lo <= 100 <= r.hi for r in sizes) == 1
    assert N.unique_index_ok(df, ("id",)) and not N.unique_index_ok(df, ("v",))


def test_seed_lines(spark, scratch):
    rows = spark.createDataFrame([("a", 1), ("b", None), (None, None)], "name string, n int")
    write_seed_lines(rows.repartition(3), f"{scratch}/lines")
    assert sorted(map(tuple, read_seed_lines(spark, f"{scratch}/lines", rows.schema).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    spark.createDataFrame([('{"name": "a"',)], "value string").write.text(f"{scratch}/broken")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        read_seed_lines(spark, f"{scratch}/broken", rows.schema).collect()


def test_seed_files(spark, scratch):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("id string, n int")
    write_small_file(spark, f"{scratch}/good.json", b' \n[{"id": "a", "n": 1},\n {"id": "b"}]')
    assert [tuple(r) for r in read_seed(spark, f"{scratch}/good.json", schema).collect()] == [("a", 1), ("b", None)]
    write_small_file(spark, f"{scratch}/bad.json", b'{"id": "a"}')
    with pytest.raises(ValueError):
        read_seed(spark, f"{scratch}/bad.json", schema)
    write_small_file(spark, f"{scratch}/worse.json", b"[1, 2]")
    with pytest.raises(Exception):
        read_seed(spark, f"{scratch}/worse.json", schema).collect()


def test_documents_keep_null_apart_from_missing(spark, scratch):
    write_small_file(spark, f"{scratch}/d.jsonl", b'{"a": null}\n{}\n\nbad\n')
    rows = read_documents(spark, f"{scratch}/d.jsonl").select(
        F.try_variant_get("doc", "$.a", "variant").isNotNull().alias("has"), F.col("doc").isNull().alias("bad")
    ).collect()
    assert [tuple(r) for r in rows] == [(True, False), (False, False), (False, True)]


def test_copies(spark, varied, scratch):
    path = copy_table(varied, "v", scratch, NOW)
    assert content(spark.read.parquet(path)) == content(varied["v"])
    twin = clone(varied, f"{scratch}/clone")
    assert twin.names == varied.names and twin.keys == varied.keys
    assert content(twin["v"]) == content(varied["v"])


def test_jdbc_reads_in_slices():
    options = jdbc_options("jdbc:x", "t", {"column": "id", "lower": 0, "upper": 100, "partitions": 5}, {"user": "u"})
    assert options == {
        "url": "jdbc:x", "dbtable": "t", "fetchsize": "10000", "user": "u",
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "5",
    }
    assert "partitionColumn" not in jdbc_options("jdbc:x", "t", {}, {})
    wide = jdbc_options("jdbc:x", "t", {"column": "id", "lower": 0, "upper": 2_500_000_000}, {})
    assert wide["numPartitions"] == "2500"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", {"column": "day", "lower": "2024-01-01", "upper": "2025-01-01"}, {})


def test_a_broken_newest_commit_never_took_place(spark, scratch):
    store = M.VersionedStore(spark, scratch)
    store.publish({"t": spark.range(3)})
    with open(f"{scratch}/commits/000000000002.json", "w"):
        pass
    with pytest.warns(UserWarning, match="broken"):
        assert store.open()["t"].count() == 3
        assert store.publish({"t": spark.range(5)}) == 3
    assert store.open()["t"].count() == 5 and store.open(1)["t"].count() == 3


def test_small_files_are_whole_or_absent(spark, scratch):
    write_small_file(spark, f"{scratch}/f/one.json", b"{}")
    with pytest.raises(FileExistsError):
        write_small_file(spark, f"{scratch}/f/one.json", b"[]")
    assert read_small_file(spark, f"{scratch}/f/one.json") == b"{}"
    assert [n for n in list_dir(spark, f"{scratch}/f") if not n.endswith(".crc")] == ["one.json"]
