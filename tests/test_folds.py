import random

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import folds as L
from tablewarden.operators.ordered import SEGMENT, with_segments

SEGMENTS = [1, 2, 8, 60]


@pytest.fixture(scope="module")
def log(spark):
    """Two keys in five own most of the rows."""
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        key = 0 if rng.random() < 0.4 else rng.randrange(1, 40)
        status = rng.choice(["completed", "open", None, "closed"])
        rows.append((key, i, status, rng.choice([None, 1, 2, 5]), rng.choice([key % 7, 3]), None if rng.random() < 0.4 else rng.randrange(4)))
    return spark.createDataFrame(rows, "k int, o long, status string, amount long, who int, v long").cache(), rows


def credits(rows, status=None):
    status, out = dict(status or {}), {}
    for key, _, new, amount, who, _ in rows:
        if new == "completed" and status.get(key) != "completed":
            out[who] = out.get(who, 0) + (amount or 0)
        status[key] = new
    return out


@pytest.mark.parametrize("segments", SEGMENTS)
def test_credits(log, segments):
    df, rows = log
    got = L.fold_credits(df, "k", ["o"], "status", "amount", "who", segments=segments)
    assert {r.who: r.credits for r in got.collect()} == credits(rows)


def test_credits_go_on_from_an_earlier_status(spark, log):
    df, rows = log
    known = {0: "completed", 1: "open", 2: None, 5: "completed"}
    previous = spark.createDataFrame(list(known.items()), "k int, status string")
    got = L.fold_credits(df, "k", ["o"], "status", "amount", "who", previous=previous, segments=8)
    assert {r.who: r.credits for r in got.collect()} == credits(rows, known)


@pytest.mark.parametrize("segments", SEGMENTS)
def test_views(log, segments):
    df, rows = log
    counter = {}
    for key, *_, v in rows:
        now = counter.get(key, 3)
        counter[key] = now + 1 if v is None or v == now else v
    got = L.fold_views(df, "k", ["o"], "v", start=3, segments=segments)
    assert {r.k: r.view_count for r in got.collect()} == counter


@pytest.mark.parametrize("segments", SEGMENTS)
def test_views_when_values_often_equal_the_counter(spark, segments):
    rng, rows, counter = random.Random(9), [], {}
    for i in range(3000):
        key = 0 if rng.random() < 0.3 else rng.randrange(1, 200)
        now, r = counter.get(key, 0), rng.random()
        v = None if r < 0.3 else now if r < 0.7 else now + 1 if r < 0.85 else rng.randrange(30)
        counter[key] = now + 1 if v is None or v == now else v
        rows.append((key, i, v))
    got = L.fold_views(spark.createDataFrame(rows, "k int, o long, v long"), "k", ["o"], "v", segments=segments)
    assert {r.k: r.view_count for r in got.collect()} == counter


@pytest.mark.parametrize("segments", SEGMENTS)
def test_referrals(spark, segments):
    rng = random.Random(7)
    refs = [(i, rng.randrange(10) if i % 3 else 0, rng.randrange(3000), rng.choice(["pending", "pending", "completed", None]), rng.choice([False, True, None])) for i in range(300)]
    buys = [(i, rng.randrange(12) if i % 3 else 0, i if i % 5 else max(0, i - 1), rng.choice(["completed", "open", None]), rng.choice(["purchase", "gift"]), rng.choice([0, 1, None])) for i in range(2500)]
    expected = {}
    for rid, user, since, status, given in refs:
        expected[rid] = (status, given, None, None)
        if status == "pending" and not given:
            first = min(((b[2], b[0]) for b in buys if b[1] == user and b[2] >= since and b[3:5] == ("completed", "purchase") and (b[5] or 0) > 0), default=None)
            if first:
                expected[rid] = ("completed", True, *first)
    r = spark.createDataFrame(refs, "rid int, referred_id int, created_at long, status string, bonus_awarded boolean")
    r = r.withColumn("date_activated", F.lit(None).cast("long")).withColumn("first_purchase_id", F.lit(None).cast("int"))
    c = spark.createDataFrame(buys, "id int, user_id int, transaction_at long, status string, type string, credits int")
    got = L.fold_referrals(r, c, segments=segments).collect()
    assert {x.rid: (x.status, x.bonus_awarded, x.date_activated, x.first_purchase_id) for x in got} == expected


def test_updated_at(log):
    df, rows = log
    got = {r.k: r.updated_at for r in L.fold_updated_at(df, "k", "o").collect()}
    assert got == {k: max(o for kk, o, *_ in rows if kk == k) for k in {r[0] for r in rows}}


@pytest.mark.parametrize("cast", ["long", "double", "decimal(20,3)", "timestamp", "timestamp_ntz", "date"])
def test_segments_follow_the_order_and_are_even(spark, cast):
    days = F.expr("timestamp_seconds(id * 86400)")
    order = days.cast(cast) if "time" in cast or cast == "date" else F.col("id").cast(cast)
    df = spark.range(1000).select("id", F.when(F.col("id") > 0, order).alias("o"))
    cut = with_segments(df, "o", 10).orderBy("id").collect()
    numbers = [r[SEGMENT] for r in cut]
    assert numbers == sorted(numbers) and numbers[0] == 0
    assert max(numbers.count(n) for n in set(numbers)) < 150


def test_no_task_holds_a_hot_key(log):
    """Rows per (key, segment) stay near the share of one segment."""
    df, rows = log
    biggest = with_segments(df, "o", 40).groupBy("k", SEGMENT).count().agg(F.max("count")).first()[0]
    assert biggest <= 2 * len(rows) / 40


def test_an_empty_log(spark):
    empty = spark.createDataFrame([], "k int, o long, status string, amount long, who int, v long")
    assert L.fold_credits(empty, "k", ["o"], "status", "amount", "who").count() == 0
    assert L.fold_views(empty, "k", ["o"], "v").count() == 0


def test_one_key_at_one_moment_spreads_over_segments(spark):
    """Nothing but the second order column tells the rows apart."""
    df = spark.range(4000).selectExpr("0 AS k", "TIMESTAMP_NTZ'2024-01-01 10:00:00' AS at", "id", "1L AS v")
    sizes = [r["count"] for r in with_segments(df, ["at", "id"], 20).groupBy(SEGMENT).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 400
    fine = spark.range(4000).selectExpr("TIMESTAMP_NTZ'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, id / 1000000) AS at")
    assert with_segments(fine, "at", 20).groupBy(SEGMENT).count().where("count < 400").count() >= 15


@pytest.mark.parametrize("segments", [2, 8, 60])
def test_folds_over_ties(spark, segments):
    """Most changes fall on two days; the number decides within a day, and it alone cuts them."""
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        day = rng.choice([1, 1, 1, 2, 2, 3, 4])
        rows.append((0 if rng.random() < 0.5 else rng.randrange(1, 9), day, i, rng.choice(["completed", "open"]), rng.randrange(5), rng.randrange(3), None if rng.random() < 0.4 else rng.randrange(4)))
    df = spark.createDataFrame(rows, "k int, day int, o long, status string, amount long, who int, v long")
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    got = L.fold_credits(df, "k", ["day", "o"], "status", "amount", "who", segments=segments)
    assert {r.who: r.credits for r in got.collect()} == credits([(k, o, s, a, w, v) for k, _, o, s, a, w, v in ordered])
    counter = {}
    for key, *_, v in ordered:
        now = counter.get(key, 0)
        counter[key] = now + 1 if v is None or v == now else v
    assert {r.k: r.view_count for r in L.fold_views(df, "k", ["day", "o"], "v", segments=segments).collect()} == counter


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, 1, "completed", 5, 7)], ["a.k", "a.o", "a.status", "a.amount", "a.who"])
    assert L.fold_credits(df, "a.k", ["a.o"], "a.status", "a.amount", "a.who").collect()[0][0:2] == (7, 5)
    assert L.fold_views(df, "a.k", ["a.o"], "a.amount").collect()[0][1] == 5
    assert L.fold_updated_at(df, "a.k", "a.o").collect()[0][1] == 1
