"""Layouts skip what they should, versions and profiles read what is new."""

import math
import re
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import layout as N
from tablewarden.operators.compare import diff_rows
from tablewarden.operators.ranges import diff_versions, unequal_ranges, write_version
from tablewarden.operators.sketches import add_part, merged_profile


def scanned(df):
    """Rows that leave the scans of a plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(20_000).select(
        F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int").alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(977)) * 1.5).alias("y"),
        F.concat(F.lit("n"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(500))).alias("name"), "id",
    )


def test_curve_serves_each_column_alone(spark, points, scratch):
    N.cluster_curve(points, ["x", "y"], files=64).write.parquet(f"{scratch}/curve")
    N.cluster(points, ["x", "y"], files=64).write.parquet(f"{scratch}/ordered")
    curve, ordered = spark.read.parquet(f"{scratch}/curve"), spark.read.parquet(f"{scratch}/ordered")
    assert curve.columns == points.columns and curve.count() == 20_000
    assert diff_rows(points, curve, ("id",)).isEmpty()
    for where in ("x BETWEEN 100 AND 110", "y BETWEEN 300 AND 310"):
        assert scanned(curve.where(where).select("id")) < 20_000 / 3
        assert curve.where(where).count() == points.where(where).count()
    assert scanned(ordered.where("y BETWEEN 300 AND 310").select("id")) == 20_000


def test_curve_over_all_types(spark, scratch):
    rows = [(i, f"w{i:03d}" if i % 7 else None, i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, w string, even boolean").selectExpr(
        "*", "timestamp_seconds(i) AS t", "CAST(timestamp_seconds(i) AS timestamp_ntz) AS n", "date_add(DATE'2020-01-01', i) AS d", "CAST(i AS decimal(9,2)) AS m"
    )
    out = N.cluster_curve(df, ["w", "even", "t", "n", "d", "m"], files=4)
    assert sorted(r.i for r in out.collect()) == list(range(300))
    assert N.cluster_curve(df.limit(0), ["i", "w"], files=2).count() == 0
    with pytest.raises(ValueError, match="62"):
        N.curve_position(df, ["i", "w"], 40)


def test_bloom_filters_skip_row_groups(spark, points, scratch):
    odd = points.select((F.col("id") * 2).alias("v"), "name").orderBy(F.xxhash64("v"))
    N.write_hash_index(odd, f"{scratch}/bloom", ["v"], distinct=20_000)
    odd.write.parquet(f"{scratch}/plain")
    missing = "v = 10001"
    assert scanned(spark.read.parquet(f"{scratch}/plain").where(missing)) > 0
    assert scanned(spark.read.parquet(f"{scratch}/bloom").where(missing)) == 0
    assert spark.read.parquet(f"{scratch}/bloom").where("v = 10000").count() == 1


def test_buckets_join_without_a_shuffle(spark, points, scratch):
    left = N.write_buckets(points.select("id", "x"), "tw_left", f"{scratch}/l", ["id"], 4)
    right = N.write_buckets(points.select("id", "y").where("id % 3 = 0"), "tw_right", f"{scratch}/r", ["id"], 4)
    joined = left.hint("merge").join(right, "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "Exchange" not in left.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == points.where("id % 3 = 0").count()
    for t in ("tw_left", "tw_right"):
        spark.sql(f"DROP TABLE {t}")


def test_versions_are_compared_by_ranges(spark, points, scratch):
    before = points.withColumn("note", F.when(F.col("id") % 5 > 0, F.col("name")))
    after = before.withColumn("note", F.when(F.col("id") == 4711, "changed").otherwise(F.col("note")))
    write_version(before, f"{scratch}/a", ("id",), bits=8)
    write_version(after, f"{scratch}/b", ("id",), bits=8)
    assert len(unequal_ranges(spark, f"{scratch}/a", f"{scratch}/b")) == 1
    (row,) = diff_versions(spark, f"{scratch}/a", f"{scratch}/b", ("id",)).collect()
    assert (row.id, row.change) == (4711, "changed")
    assert unequal_ranges(spark, f"{scratch}/a", f"{scratch}/a") == []
    assert diff_versions(spark, f"{scratch}/a", f"{scratch}/a", ("id",)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_version_differences_are_those_of_rows(spark, scratch, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), rng.choice(["a", None, "b"])) for _ in range(100)]
    other = [r for r in rows if rng.random() < 0.9] + [(rng.randrange(80), "c") for _ in range(rng.randrange(4))]
    a, b = spark.createDataFrame(rows, "k int, v string"), spark.createDataFrame(other, "k int, v string")
    write_version(a, f"{scratch}/a", ("k",), bits=5)
    write_version(b, f"{scratch}/b", ("k",), bits=5)
    got = diff_versions(spark, f"{scratch}/a", f"{scratch}/b", ("k",)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, diff_rows(a, b, ("k",)).collect()))
    write_version(b.withColumn("more", F.lit(1)), f"{scratch}/c", ("k",), bits=5)
    assert diff_versions(spark, f"{scratch}/a", f"{scratch}/c", ("k",)).count() == len(got)
    write_version(a.limit(0), f"{scratch}/none", ("k",), bits=5)
    assert diff_versions(spark, f"{scratch}/none", f"{scratch}/a", ("k",)).count() == len({r[0] for r in rows})


def test_profiles_grow_by_their_parts(spark, points, scratch):
    rows = points.withColumn("name", F.when(F.col("id") % 4 > 0, F.col("name"))).withColumn("at", F.timestamp_seconds("id"))
    for n in range(2):
        rows.where(F.col("id") % 2 == n).write.parquet(f"{scratch}/rows{n}")
    add_part(spark.read.parquet(f"{scratch}/rows0"), f"{scratch}/s", "first")
    shutil.rmtree(f"{scratch}/rows0")  # what is known of it is enough
    add_part(spark.read.parquet(f"{scratch}/rows1"), f"{scratch}/s", "second")
    add_part(spark.read.parquet(f"{scratch}/rows1"), f"{scratch}/s", "second")
    got = {r.column: r for r in merged_profile(spark, f"{scratch}/s").collect()}
    assert {c: (r.rows, r.nulls) for c, r in got.items()} == {"x": (20000, 0), "y": (20000, 0), "name": (20000, 5000), "id": (20000, 0), "at": (20000, 0)}
    assert (got["id"].low, got["id"].high, got["name"].first) == (0.0, 19999.0, "n0") and got["name"].quantiles is None
    for c, exact in (("x", 1000), ("name", 500), ("id", 20000)):
        assert abs(got[c].distinct - exact) <= 0.03 * exact
    assert all(abs(q - 20000 * s) < 0.03 * 20000 for q, s in zip(got["id"].quantiles, (0.25, 0.5, 0.75), strict=True))


def test_profile_of_nothing(spark, scratch):
    df = spark.createDataFrame([], "a int, b string")
    add_part(df, f"{scratch}/s", "none")
    assert {(r.column, r.rows, r.distinct, r.quantiles) for r in merged_profile(spark, f"{scratch}/s").collect()} == {("a", 0, 0, None), ("b", 0, 0, None)}


TEXTS = {1: "The cat sat. The cat SAT on the mat", 2: "cat the sat", 3: None, 4: "", 5: "the the the cat", 6: "x " * 3000 + "cat sat"}


def test_phrases_and_ranking(spark, scratch):
    df = spark.createDataFrame(list(TEXTS.items()), "id int, body string")
    N.write_positions(df, f"{scratch}/p", "id", ["body"])
    find = lambda phrase: {r.key: r.occurrences for r in N.phrase_lookup(spark, f"{scratch}/p", phrase).collect()}
    assert find("the cat") == {1: 2, 5: 1} and find("Cat, sat!") == {1: 2, 6: 1}
    assert find("the the") == {5: 2} and find("x x x")[6] == 2998 and find("nothing here") == {}
    words = {k: [w for w in (t or "").lower().replace(".", "").split()] for k, t in TEXTS.items()}
    usual = sum(map(len, words.values())) / len(words)
    expected = {}
    for k, ws in words.items():
        score = 0.0
        for t in ("cat", "sat"):
            tf, n = ws.count(t), sum(t in o for o in words.values())
            score += math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / usual)) if tf else 0
        if score:
            expected[k] = score
    got = {r.key: r.score for r in N.ranked_lookup(spark, f"{scratch}/p", ["Cat sat", "cat"]).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_positions_are_written_where_they_are_read(spark, scratch, monkeypatch):
    """No row of the index is shuffled, and it is sorted in bounded runs; repeated and NULL keys count as rows of their own."""
    monkeypatch.setattr(N, "RUN_WORDS", 4)
    rows = [(k, t) for k, t in TEXTS.items()] + [(None, "the cat Ünï"), (5, "the cat"), (9, "a cat sat on the cat")]
    df = spark.createDataFrame(rows, "id int, body string").coalesce(1)
    N.write_positions(df, f"{scratch}/p", "id", ["body"])
    found = spark.read.parquet(f"{scratch}/p/postings")
    assert len(found.inputFiles()) == 1  # the one task that reads the documents writes them
    words = [(k, [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]) for k, t in rows]
    places = sorted(((w, k, i) for k, ws in words for i, w in enumerate(ws)), key=repr)
    got = [(r.term, r.key, r.block, p) for r in found.collect() for p in r.positions]
    assert all(b == p // N.POSITIONS for _, _, b, p in got) and sorted(((t, k, p) for t, k, _, p in got), key=repr) == places
    assert {r.key: r.occurrences for r in N.phrase_lookup(spark, f"{scratch}/p", "the cat").collect()} == {1: 2, 5: 1, None: 1, 9: 1}
    assert {r.key: r.terms for r in N.ranked_lookup(spark, f"{scratch}/p", ["cat", "on"]).collect()} == {1: 2, 2: 1, 5: 2, 6: 1, 9: 2}


def test_files_hold_a_bounded_number_of_rows(spark, scratch):
    """Rows that compress to next to nothing still are laid out in several files."""
    spark.range(5000).select((F.col("id") % 3).alias("a"), F.lit(1).alias("b")).coalesce(1).write.parquet(f"{scratch}/in")
    df = spark.read.parquet(f"{scratch}/in")
    assert N.files_for(df) == 1 and N.files_for(df, file_rows=1000) == 5 and N.files_for(df.limit(0)) == 1
    assert N.files_for(spark.range(N.FILE_ROWS * 2 + 1).select(F.lit(1).alias("c"))) == 3
