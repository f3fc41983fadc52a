"""References and keys in tables made by hand."""

import json
import random
from collections import Counter
from itertools import combinations

import pytest

from tablewarden.operators.discovery import discover_keys, discover_references
from tablewarden.plans.registry import REFERENCES, tables
from tablewarden.sources.tables import Reference, TableSet
from tests.conftest import SMALL


def found(ts, **how):
    return {(r.child_table, r.child_column, r.parent_table, r.parent_column): r for r in discover_references(ts, **how).collect()}


@pytest.fixture
def shop(spark):
    users = spark.createDataFrame([(i, f"u{i}", 1.0 * i, i % 2 == 0) for i in range(1, 11)], "id long, name string, score double, ok boolean")
    # a whole number of another width; NULLs point nowhere; one value too many in ``wrong``
    orders = spark.createDataFrame([(i, 1 + i % 5 if i else None, f"u{1 + i % 3}", 1 + i % 11, None) for i in range(30)], "no int, user_id int, who string, wrong int, empty int")
    return TableSet.of(spark, {"users": users, "orders": orders}, references=[Reference("orders", "user_id", "users", "id")])


def test_references(shop):
    got = found(shop)
    assert {k[1:] for k in got if k[0] == "orders"} == {("user_id", "users", "id"), ("who", "users", "name"), ("user_id", "orders", "no"), ("wrong", "orders", "no")}
    assert got["orders", "user_id", "users", "id"].declared and not got["orders", "who", "users", "name"].declared
    assert not any("empty" in k or "score" in k or "ok" in k for k in got)
    near = found(shop, least_coverage=0.9)["orders", "wrong", "users", "id"]
    assert (near.child_values, near.parent_values, near.covered) == (11, 10, 10)


def test_repeats_and_nulls_are_no_parents(spark):
    ts = TableSet.of(spark, {
        "a": spark.createDataFrame([(1,), (1,), (2,)], "x int"), "b": spark.createDataFrame([(1,), (2,), (None,)], "y int"),
        "c": spark.createDataFrame([("long" * 100,)], "z string"), "d": spark.createDataFrame([("long" * 100,), ("other",)], "w string"),
    })
    assert set(found(ts)) == {("c", "z", "d", "w")}


def test_declared_references_of_the_test_tables_are_found(spark):
    names = {n for r in REFERENCES for n in (r.child, r.parent)}
    got = found(tables(spark, SMALL, *names))
    for r in REFERENCES:
        assert got[r.child, r.column, r.parent, r.parent_column].declared


def minimal_keys(rows, names, most):
    keys = []
    for k in range(1, most + 1):
        for s in combinations(range(len(names)), k):
            if not any(set(u) <= set(s) for u in keys) and not any(r[i] is None for r in rows for i in s):
                if len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                    keys.append(s)
    return {tuple(names[i] for i in s) for s in keys}


def test_keys_against_all_subsets(spark):
    rng = random.Random(3)
    for _ in range(6):
        n = rng.randrange(20, 120)
        rows = [(i // 7, i % 7, rng.randrange(4), rng.choice("ab"), rng.choice([None, "x"]), rng.randrange(10**6)) for i in range(n)]
        df = spark.createDataFrame(rows, "a int, b int, c long, d string, e string, f int")
        got = {tuple(r.columns) for r in discover_keys(df).collect() if r.unique}
        assert got == minimal_keys(rows, df.columns, 3)


def test_near_keys_come_with_an_example(spark):
    df = spark.createDataFrame([(i // 3, i % 3) for i in range(300)] + [(7, 1)], "o int, l int")
    (r,) = discover_keys(df).collect()
    assert (r.columns, r.unique, r.repeated_values, r.example) == (["o", "l"], False, 1, '{"o":7,"l":1}')


def test_small_tables(spark):
    one = spark.createDataFrame([(1, 2)], "a int, b int")
    assert [tuple(r) for r in discover_keys(one).collect()] == [([], 1, True, 0, None)]
    assert discover_keys(one.limit(0)).count() == 0


def test_sets_are_checked_in_the_rows_that_their_parts_repeat(spark, monkeypatch):
    """Exact counts and examples are as by all rows, of which the larger sets read few."""
    from tablewarden.operators import discovery

    rows = [(i // 20 if i else 1, i % 20 if i else 0, i * 7919 % 50, i % 3, i // 2000) for i in range(6000)]
    df = spark.createDataFrame(rows, "`a.b` int, c int, d int, e int, f int")
    read, check = [], discovery._checked

    def spy(names, rows_of):
        read.extend((s, r.count()) for s, r in rows_of.items())
        return check(names, rows_of)

    monkeypatch.setattr(discovery, "_checked", spy)
    got = {tuple(r.columns): (r.unique, r.repeated_values, r.example) for r in discover_keys(df).collect()}
    for s, (unique, repeated, example) in got.items():
        at = [df.columns.index(c) for c in s]
        counts = Counter(tuple(r[i] for i in at) for r in rows)
        several = sorted(v for v, n in counts.items() if n > 1)
        assert (unique, repeated) == (not several, len(several))
        assert (json.loads(example) if example else None) == (dict(zip(s, several[0], strict=True)) if several else None)
    assert ("a.b", "c") in got and not got["a.b", "c"][0]
    assert any(len(s) == 3 and {"a.b", "c"} < set(s) and n == 2 for s, n in read)
