"""The manifest against trees built one by one, with superblocks of several sizes."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewarden.llm import merkle
from tests.llm import data

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string, digest int, `group` string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    i, text, lang, source, n = row[:5]
    fields = [i, source, lang, n + more if n is not None else None, text]
    return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(digests):
    """The root, and for each leaf its siblings with their side."""
    proofs, at, now = [[] for _ in digests], list(range(len(digests))), digests
    while len(now) > 1:
        for k, p in enumerate(at):
            other = p ^ 1
            proofs[k].append((other < p, now[other]) if other < len(now) else None)
            at[k] = p >> 1
        now = [H(*now[k : k + 2]) for k in range(0, len(now), 2)]
    return now[0], proofs


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts, subroots = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, proofs = tree([leaf(r) for r in own])
        parts[lang] = own, proofs
        subroots.append(root)
    root, upper = tree(subroots)
    out = []
    for k, lang in enumerate(langs):
        for r, proof in zip(*parts[lang], strict=True):
            whole = proof + upper[k]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(r, 1 if tampered else 0)
            for s in whole:
                now = H(now) if s is None else H(s[1], now) if s[0] else H(now, s[1])
            proof_sha = H(*[s[1] for s in whole if s])
            out.append((r[0], leaf(r), subroots[k], root, proof_sha, now, now == root))
    return Counter(out)


def found(df, bits):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.manifest(df, {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, bits=bits)
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", "verified")
    return Counter(tuple(r) for r in rows.collect())


def table_of(spark, rows):
    return spark.createDataFrame([(*r[:5], "other", 7, "g") for r in rows], SCHEMA)


@pytest.mark.parametrize("bits", [1, 2, 10])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 21])
def test_trees_of_many_sizes(spark, bits, n):
    rows = [(i * 3 % 64, f"text {i}", [None, "en", "été", "", "z"][min(i % 7, 4)], "s", i) for i in range(n)]
    assert found(table_of(spark, rows), bits) == expected(rows)


def test_awkward_rows(spark):
    rows = data.rows()
    got = found(table_of(spark, rows), 2)
    assert got == expected(rows) and sum(got.values()) == len(rows)
    # a changed row fails, one without a count cannot be changed by one
    assert {r[-1] for r in got} == {True, False}


def test_empty_table(spark):
    df = table_of(spark, data.rows()).limit(0)
    assert found(df, 2) == Counter()


def test_many_groups(spark):
    rows = [(i, "t", f"lang{i % 19:02d}", None, None) for i in range(60)]
    assert found(table_of(spark, rows), 1) == expected(rows)


def test_query(spark):
    import duckdb

    from tablewarden.llm.queries import QUERIES
    from tests.conftest import SMALL

    rows = duckdb.execute(f"SELECT doc_id, text, lang, source, n_chars FROM '{SMALL}/documents.parquet'").fetchall()
    out = QUERIES["op12_merkle_manifest"](spark, SMALL)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in out.collect()) == expected(rows)
