"""The trigram index finds what a plain search finds, and reads less."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import trigrams as N
from tablewarden.operators.layout import runs
from tablewarden.operators.search import SearchValue, search
from tablewarden.sources.tables import TableSet

WORDS = ["alpha", "Beta", "straße", "KELVIN", "KKelvin", "ſhort", "İstanbul", "ılık", "a+b", "x|y", "foo(bar)", "tab\there", "line\nbreak", "日本語", "é"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(3)) if i % 10 else None, f"note {i}") for i in range(400)]
    rows += [(1000 + i, f"filler {i}", "needle in here" if i == 777 else "hay") for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, body string, note string").repartition(3, F.col("id") % 3)
    path = f"{tmp_path_factory.mktemp('trigrams')}/index"
    N.write_trigram_index(df, path, ["body", "note"], granule_rows=16)
    return df, path


VALUES = [
    ("alpha", {}), ("ALPHA beta", {}), ("Alpha", {"case_sensitive": True}), ("straße", {}), ("kelvin", {}), ("short", {}), ("istanbul", {}),
    ("ilik", {"regex": True}), ("short|kelvin", {"regex": True}), ("istanbul", {"regex": True}), ("note 7", {"exact": True}), ("a+b", {}),
    ("a\\+b", {"regex": True}), ("fo+\\(ba?r\\)", {"regex": True}), ("fil{1,2}er 12[0-9]", {"regex": True}), ("(alp|bet)ha", {"regex": True}), ("no", {}),
    ("nothing like it", {}), ("needle.*here$", {"regex": True}), ("(?i)NEEDLE", {"regex": True, "case_sensitive": True}),
    ("日本語", {}), ("line\nbreak", {}), ("x\\|y", {"regex": True}), ("needle(s)? in", {"regex": True}), ("need+?le", {"regex": True}), ("null", {}), ("q*|alpha", {"regex": True}),
]


@pytest.mark.parametrize("value, how", VALUES)
def test_same_hits_as_the_scan(spark, index, value, how):
    df, path = index
    found = N.indexed_search(spark, path, "t", value, ["body", "note"], key=("id",), **how)
    plain = search(TableSet.of(spark, {"t": df}, keys={"t": ("id",)}), value, **how)
    expected = {(r.row_key, tuple(c for c in r.matching_columns if c != "id")) for r in plain.collect()}
    assert {(r.row_key, tuple(r.matching_columns)) for r in found.collect()} == {e for e in expected if e[1]}


def rows_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_few_rows_are_read(spark, index):
    _, path = index
    assert 0 < rows_read(N.indexed_search(spark, path, "t", "needle in here", ["body", "note"])) <= 48
    assert rows_read(N.indexed_search(spark, path, "t", "ne", ["body", "note"])) == 2400


@pytest.mark.parametrize("pattern, expected", [
    ("abc", [["abc"]]), ("abc|de", [["abc"], ["de"]]), ("ab?c", [["a", "c"]]), ("ab+c", [["ab", "c"]]), ("a.c[xyz]d(e|f)g", [["a", "c", "d", "g"]]),
    ("a\\.b\\dc", [["a.b", "c"]]), ("a\\+?b", [["a", "b"]]), ("ab{0,2}c{2}d", [["a", "c", "d"]]), ("a\\Qb", None), ("(?x)a b", None), ("a(b", None),
    ("[]a]b", None), ("a\\x41", None), ("a++b", [["a", "b"]]), ("(?:abc)?d", [["d"]]), ("a(?!b)c", [["a", "c"]]), ("|a", [[], ["a"]]), ("\\bword\\b", [["word"]]),
])
def test_required_literals(pattern, expected):
    assert N.required_literals(pattern) == expected


def test_required_literals_are_in_every_match():
    """Texts made at random: where Python finds a match, some alternative has all its literals in it."""
    rng = random.Random(9)
    for _ in range(3000):
        parts = ["a", "b", "c", ".", "[ab]", "(a|b)", "a?", "b*", "c+", "(?:bc)?", "\\.", "a{0,1}", "b{2}", "|"]
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 7)))
        literals = N.required_literals(pattern)
        for _ in range(5):
            text = "".join(rng.choice("abc.") for _ in range(6))
            if literals is not None and (m := re.search(pattern, text)):
                assert any(all(x in m[0] for x in parts_) for parts_ in literals), (pattern, text)


def test_empty_table(spark, scratch):
    df = spark.createDataFrame([], "id int, body string")
    N.write_trigram_index(df, f"{scratch}/none", ["body"])
    assert N.indexed_search(spark, f"{scratch}/none", "t", "abcd", ["body"]).count() == 0
    with pytest.raises(ValueError, match="no text column"):
        N.write_trigram_index(df, f"{scratch}/bad", ["id"])


def test_many_trigrams_and_runs():
    assert N.required_trigrams(SearchValue("null")) is None and N.required_trigrams(SearchValue("ab")) is None
    assert runs([1, 2, 3, 10, 11, 50], 2) == [(1, 11), (50, 50)] and runs([5], 4) == [(5, 5)]
    assert runs([1, 2, 3, 10, 11, 50], 9) == [(1, 3), (10, 11), (50, 50)]
