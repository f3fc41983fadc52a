import random

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import folds as L
from tablewarden.plans import stream_queries as Q
from tablewarden.streaming import state as S
from tablewarden.streaming.search import latest_change, standing_search, windowed_hits
from tablewarden.streaming.state import CreditLedger, KeptAggregate, TtlTable, UpsertTable, ViewCounters, state_rows

SCHEMA = "k int, o long, status string, amount long, who int"


@pytest.fixture
def arriving(spark, scratch):
    """A log that arrives in five files, one per micro-batch."""
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 20), i, rng.choice(["completed", "open"]), rng.choice([1, 2, None]), rng.randrange(4)) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in range(5):
        df.where(F.floor(F.col("o") / 100) == n).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    return df, stream


def ledger_of(spark, path, stream):
    return CreditLedger(spark, path, stream.schema, key="k", order=["o"], status="status", amount="amount", user="who")


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def feed(spark, path, batches, schema):
    """A stream that is given one batch at a time; ``go`` runs what is there."""
    def go(n, run):
        spark.createDataFrame(batches[n], schema).repartition(2).write.mode("append").parquet(path)
        run(spark.readStream.schema(schema).parquet(path)).awaitTermination()
    return go


def test_ledger_equals_the_batch_fold(spark, arriving, scratch):
    df, stream = arriving
    ledger = ledger_of(spark, f"{scratch}/ledger", stream)
    ledger.start(stream).awaitTermination()
    assert pairs(ledger.balances()) == pairs(L.fold_credits(df, "k", ["o"], "status", "amount", "who"))


def test_ledger_survives_a_restart(spark, scratch):
    """Each batch is run by a new query over the old checkpoint, and only the state of its keys changes."""
    rng = random.Random(8)
    rows = [(rng.choice([None, 0, 0, *range(1, 9)]), i, rng.choice(["completed", "open", None]), rng.choice([1, None]), i % 3) for i in range(90)]
    batches = [rows[:30], rows[30:31], rows[31:60], rows[60:]]
    go = feed(spark, f"{scratch}/in", batches, SCHEMA)
    for n in range(4):
        ledger = CreditLedger(spark, f"{scratch}/ledger", spark.createDataFrame(rows[:0], SCHEMA).schema, key="k", order=["o"], status="status", amount="amount", user="who")
        go(n, ledger.start)
        so_far = spark.createDataFrame(sum(batches[: n + 1], []), SCHEMA)
        assert pairs(ledger.balances()) == pairs(L.fold_credits(so_far, "k", ["o"], "status", "amount", "who"))
    held = {r.key.k: r.value.done for r in state_rows(spark, f"{scratch}/ledger/checkpoint", "done").collect()}
    assert held == {r[0]: r[2] == "completed" for r in rows}


@pytest.mark.parametrize("kind", ["decimal(10,2)", "double", "float", "int"])
def test_amounts_of_any_kind(spark, scratch, kind):
    rows = spark.sql(f"SELECT CAST(id % 3 AS INT) AS k, id AS o, CASE WHEN id % 2 = 0 THEN 'completed' ELSE 'open' END AS status, "
                     f"CAST(id * 1.25 AS {kind}) AS amount, CAST(id % 5 AS INT) AS who FROM range(60)")
    rows.write.parquet(f"{scratch}/in")
    ledger = ledger_of(spark, f"{scratch}/l", rows)
    ledger.start(spark.readStream.schema(rows.schema).parquet(f"{scratch}/in")).awaitTermination()
    expected = L.fold_credits(rows, "k", ["o"], "status", "amount", "who")
    assert ledger.balances().schema["credits"].dataType == expected.schema["credits"].dataType
    assert pairs(ledger.balances()) == pairs(expected)


def test_state_is_called_by_group(spark, monkeypatch):
    """A processor gets a few rows of lists, however many keys and rows a batch has, and of a flag only its changes."""
    monkeypatch.setattr(S, "GROUPS", 3)
    monkeypatch.setattr(S, "LIST_ROWS", 40)
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(50)]), i, rng.random() < 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, a int, o int, done boolean").repartition(5)
    expected = []
    for k in {r[0] for r in rows}:
        line = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1], r[2]))
        expected += [(i == 0, k, r[3], r[2]) for i, r in enumerate(line) if i == 0 or line[i - 1][3] != r[3]]
    got = S._ordered(df, "k", ["a", "o"], F.col("done"), F.col("o").alias("at"), changing="done").collect()
    assert len(got) <= len(expected) / 40 + 3
    flat = [t for r in sorted(got, key=lambda r: (r.g, r.block)) for t in zip(r.new, r.k, r.done, r["at"])]
    by_key = lambda ts: sorted(ts, key=lambda t: (t[1] is not None, t[1]))
    assert by_key(flat) == by_key(expected)
    assert sum(len(r.at) for r in S._ordered(df, "k", ["a", "o"], F.col("o").alias("at")).collect()) == 600


@pytest.mark.parametrize("kind", ["string", "double", "decimal(8,2)", "timestamp", "date", "boolean"])
def test_keys_and_orders_of_any_kind(spark, scratch, monkeypatch, kind):
    """Keys of one value stay one key from batch to batch: 0 and -0, NaN, NULL, and any order."""
    monkeypatch.setattr(S, "GROUPS", 2)
    value = {
        "double": "CASE id % 5 WHEN 0 THEN 0D WHEN 1 THEN -0D WHEN 2 THEN double('NaN') WHEN 3 THEN 1.5D END", "boolean": "id % 5 = 1",
        "date": "date_add(DATE'2024-01-01', CAST(id % 5 AS INT))", "timestamp": "timestamp_micros(id % 5)",
    }.get(kind, f"CAST(id % 5 AS {kind})")
    rows = spark.sql(f"SELECT IF(id % 7 = 0, NULL, {value}) AS k, IF(id % 11 = 0, NULL, {value}) AS t, id AS o, IF(hash(id) % 3 = 0, 'completed', 'open') AS status, "
                     f"CAST(id AS INT) AS amount, 1 AS who FROM range(120)").withColumn("n", F.col("o") % 2)
    ledger = CreditLedger(spark, f"{scratch}/l", rows.schema, key="k", order=["n", "t", "o"], status="status", amount="amount", user="who")
    for n in range(2):
        rows.where(F.col("n") == n).repartition(3).write.mode("append").parquet(f"{scratch}/in")
        ledger.start(spark.readStream.schema(rows.schema).parquet(f"{scratch}/in")).awaitTermination()
    known = {}
    total = 0
    code = lambda v: "NaN" if v != v else v + 0 if kind == "double" and v is not None else v
    for n in range(2):
        line = rows.where(F.col("n") == n).orderBy("t", "o").collect()
        for r in line:
            k, done = code(r.k), r.status == "completed"
            total += r.amount if done and not known.get(k, False) else 0
            known[k] = done
    assert [tuple(r) for r in ledger.balances().collect()] == [(1, total)]
    held = state_rows(spark, f"{scratch}/l/checkpoint", "done").collect()
    assert len(held) == len(known) and {code(r.key.k): r.value.done for r in held} == known


def test_batches_are_cut_by_several_tasks(spark, scratch, monkeypatch):
    """A table that arrives is dealt into as many ranges as it has files, and batches stay in order."""
    spark.range(400).selectExpr("id AS event_id", "CAST(id * 7 % 400 AS INT) AS ts").write.parquet(f"{scratch}/events.parquet")
    cut = []
    monkeypatch.setattr(Q, "ROWS_PER_FILE", 20)
    monkeypatch.setattr(Q, "tables", lambda spark, d, *names: {n: spark.read.parquet(f"{d}/{n}.parquet") for n in names})
    monkeypatch.setattr(Q, "cut_lineage", lambda df, f=Q.cut_lineage: cut.append(f(df)) or cut[0])
    Q._stream(spark, scratch, "events", "ts")
    assert len(cut[0].inputFiles()) > 2 * Q.BATCHES
    ends = cut[0].groupBy("__part").agg(F.min("ts"), F.max("ts"), F.count("*")).orderBy("__part").collect()
    assert len(ends) == Q.BATCHES and all(a[2] < b[1] for a, b in zip(ends, ends[1:])) and sum(r[3] for r in ends) == 400


def test_view_counters_go_on(spark, scratch):
    rng = random.Random(6)
    rows = [(rng.choice([None, 0, 1, 2, 3]), i, None if rng.random() < 0.5 else rng.randrange(3)) for i in range(300)]
    schema = "k int, o long, v long"
    go = feed(spark, f"{scratch}/in", [rows[:120], rows[120:121], rows[121:]], schema)
    for n, end in enumerate([120, 121, 300]):
        counters = ViewCounters(spark, f"{scratch}/v", spark.createDataFrame([], schema).schema, key="k", order=["o"], value="v", start=1)
        go(n, counters.start)
        assert pairs(counters.counts()) == pairs(L.fold_views(spark.createDataFrame(rows[:end], schema), "k", ["o"], "v", start=1))


def test_upserts_in_any_order(spark, scratch):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, name string, at int")
    schema = "id int, name string, at int"
    go = feed(spark, f"{scratch}/in", [[(1, "new", 5), (3, "c", 1)], [(1, "late", 3), (3, None, 2), (1, "equal", 5)]], schema)
    for n in range(2):
        table = UpsertTable(base, f"{scratch}/log", base.schema, ("id",), "at")
        go(n, table.start)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "new", 5), (2, "b", 0), (3, None, 2)]


def test_aggregates_are_read_from_the_state(spark, scratch):
    schema = "k string, at long"
    go = feed(spark, f"{scratch}/in", [[("a", 1), ("b", 5), (None, 2)], [("a", 3)]], schema)
    for n in range(2):
        kept = []
        go(n, lambda stream: (kept.append(KeptAggregate(latest_change(stream, "k", "at"), f"{scratch}/cp", 1)) or kept[0].start()))
    assert kept[0].read().columns == ["k", "updated_at", "changes"]
    assert pairs(kept[0].read()) == pairs(spark.createDataFrame([("a", 3, 2), ("b", 5, 1), (None, 2, 1)], "k string, u long, c long"))


def test_closed_and_open_windows_are_all_hits(spark, scratch):
    schema = "id int, at timestamp, word string"
    rows = [(i, f"2024-01-0{1 + i // 10} 0{i % 10}:00:00", "hit" if i % 3 else "miss") for i in range(40)]
    source = spark.createDataFrame(rows, "id int, at string, word string").selectExpr("id", "CAST(at AS timestamp) AS at", "word")
    source.write.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(schema).parquet(f"{scratch}/in")
    kept = KeptAggregate(windowed_hits(stream, "log", "hit", "at", "1 day", "1 hour"), f"{scratch}/cp", 2)
    kept.start("append", "parquet", path=f"{scratch}/closed").awaitTermination()
    closed, opened = spark.read.parquet(f"{scratch}/closed").collect(), kept.read().collect()
    assert len(closed) == 3 and len(opened) == 1
    assert sum(r.hits for r in [*closed, *opened]) == sum(i % 3 > 0 for i in range(40))


def test_ttl_follows_the_time_of_the_events(spark, scratch):
    """Timers take rows out once the watermark has passed them, whatever the clock says."""
    schema = "id int, note string, at timestamp"
    rows = lambda *r: spark.createDataFrame(r, "id int, note string, at string").selectExpr("id", "note", "CAST(at AS timestamp) AS at")
    batches = [
        rows((1, "old", "2020-01-01 00:00:00"), (2, "kept", "2020-01-01 20:00:00"), (3, "no time", None), (2, "older", "2020-01-01 10:00:00")),
        rows((4, "moves on", "2020-01-02 00:00:00")),
        rows((5, "too late", "2020-01-01 00:00:00"), (2, "again", "2020-01-02 12:00:00"), (4, None, "2020-01-02 00:00:00")),
        rows((6, "last", "2020-01-03 12:00:00")),
    ]
    live = [{1: "old", 2: "kept"}, {2: "kept", 4: "moves on"}, {2: "again", 4: None}, {6: "last"}]
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        table = TtlTable(spark, f"{scratch}/ttl", batch.schema, key="id", at="at", keep="1 day")
        table.start(spark.readStream.schema(schema).parquet(f"{scratch}/in")).awaitTermination()
        now = {r.id: r.note for r in table.live().collect()}
        if n == 2:  # of rows of one time the greater digest counts
            assert now.pop(4) in (None, "moves on") and live[n].pop(4) is None
        assert now == live[n]
    assert sorted(r.id for r in table.expired().collect()) == [1, 2, 4]


def test_standing_search_equals_the_batch_search(spark, arriving, scratch):
    df, stream = arriving
    hits = standing_search(stream, "log", "1", key=("o",))
    q = hits.writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.row_key, tuple(r.matching_columns)) for r in spark.read.parquet(f"{scratch}/out").collect()}
    batch = standing_search(df, "log", "1", key=("o",)).collect()
    assert got == {(r.row_key, tuple(r.matching_columns)) for r in batch} and got
