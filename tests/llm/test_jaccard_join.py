"""The Jaccard join against all pairs of plain sets."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tablewarden.llm import jaccard_join as J
from tablewarden.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm import data


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) or frozenset([tuple(w)] if w else [])


def expected(docs):
    sets = [sets_of(t) for _, t in docs]
    distinct = sorted(set(sets), key=len)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    holders: dict = {}
    for s in distinct:
        for x in s:
            holders.setdefault(x, []).append(s)
    for s in distinct:
        for other, both in Counter(o for x in s for o in holders[x]).items():
            if 100 * both >= 85 * (len(s) + len(other) - both):
                root[find(other)] = find(s)
    least: dict = {}
    for (i, _), s in zip(docs, sets, strict=True):
        if i is not None and s:
            least[id(find(s))] = min(least.get(id(find(s)), i), i)
    return Counter((i, len(s), least.get(id(find(s))) if s else i) for (i, _), s in zip(docs, sets, strict=True))


def found(df):
    return Counter(tuple(r) for r in J.jaccard_groups(df).collect())


def near(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_awkward_rows(spark):
    rows = data.rows()
    assert found(data.frame(spark)) == expected([r[:2] for r in rows])


def test_empty_table(spark):
    assert found(data.frame(spark).limit(0)) == Counter()


@pytest.mark.parametrize("cell", [4, J.CELL])
def test_groups_chains_and_borders(spark, monkeypatch, cell):
    """Chains of copies, a group with a common body, sizes at the border, one common passage in unlike texts."""
    monkeypatch.setattr(J, "CELL", cell)
    rng, texts = random.Random(7), []
    for k in range(12):
        now = data.prose(1000 + k, rng.choice([20, 60, 250]))
        for _ in range(10):
            texts.append(now)
            now = near(rng, now, rng.randrange(1, 4))
    body = data.prose(50, 120)
    texts += [near(rng, body, rng.randrange(8)) for _ in range(80)]
    texts += [f"{data.PASSAGE} {data.prose(2000 + k, 20)}" for k in range(40)]
    words = [f"w{i}" for i in range(103)]
    texts += [" ".join(words[:n]) for n in range(80, 104)] + ["w1 w2", "W1 w2", "w1 w2 w3 w4"]
    docs = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == expected(docs)


def test_query(spark):
    docs = duckdb.execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = Counter(tuple(r) for r in QUERIES["op11_jaccard_join"](spark, SMALL).collect())
    assert got == expected(docs)


def test_bound_never_underestimates():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 300, 5000):
        for share in (0.5, 0.8, 0.86, 0.95, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(share * n)], rng.integers(0, 1 << 63, n - int(share * n), dtype=np.uint64)]))
            x, y = (np.frombuffer(J.bitmap(s), np.uint64) for s in (a, b))
            words = min(len(x), len(y))
            differing = int(np.bitwise_count(J.fold(x, words) ^ J.fold(y, words)).sum())
            assert differing <= len(np.setxor1d(a, b))
            assert not J.linked(a, b) or J.may_link(len(a) + len(b), differing)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_shared_postings_over_batches(size):
    rows = [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1), (3, 1, 2), (3, 1, 2), (3, 2, 0), (4, 5, 5), (5, 1, 1), (5, 1, 1), (5, 2, 2), (6, 0, 0)]
    rows = [(*r, r[0] in (3, 6)) for r in rows]
    types = [pa.int64()] * 3 + [pa.bool_()]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + size]], types[k]) for k in range(4)], ["key", "s1", "s2", "common"])
        for at in range(0, len(rows), size)
    ]
    out = [tuple(r.values()) for b in J._shared(iter(batches)) for r in b.to_pylist()]
    assert out == [(3, 1, 1), (3, 1, 2), (3, 2, 0), (5, 1, 1), (5, 2, 2), (6, 0, 0)]
