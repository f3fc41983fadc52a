"""The burst trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import turn_trie
from tablewarden.llm.queries import QUERIES
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, TURN string, head int, seq long"


def rebuilt(rows):
    own: dict = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def nodes(convs):
    members: dict = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children: dict = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in below)
    out = []
    for p, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(ms), len(p), parent, len(ms), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "other", 1, 2) for r in rows], SCHEMA)
    conv = F.col("conv_id")
    whole = turn_trie.rebuilt(df, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6)
    out = turn_trie.trie(whole, **how)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in out.select(*names).collect())


def awkward():
    rng = random.Random(5)
    rows = []
    for c in [*range(130), 200, 207, 399, 1001]:
        common = rng.random() < 0.5
        for t in range(rng.randrange(1, 9)):
            text = "same" if common and t < rng.randrange(9) else rng.choice(["a", "b", "", "ü" * 3, None])
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None, ""]), text))
    rows += [(500, 0, "user", "x" * 100_000)] + [(500, t, "user", f"long {t}") for t in range(1, 300)]
    rows += [(600 + k, t, "user", f"equal {t}") for k in (0, 6) for t in range(50)]
    rows += [(None, 0, "user", "nobody"), *rows[:3], (700, None, None, None)]
    return rows


@pytest.mark.parametrize("container, cell", [(1, 3), (20, 64), (10_000, 1024)])
def test_trie(spark, container, cell):
    rows = awkward()
    got = found(spark, rows, container_turns=container, turns_per_cell=cell)
    assert got == nodes(rebuilt(rows))
    assert max(got.values()) == 1


def test_empty(spark):
    assert found(spark, awkward()[:0]) == Counter()
    assert found(spark, [(None, 1, "a", "b")]) == Counter()


def test_only_a_root(spark):
    # neither has more turns than it loses, and there is no conversation 100
    turnless = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0][:2]
    rows = [(c, 0, "user", "hello") for c in turnless]
    got = found(spark, rows)
    ends = hashlib.sha256(",".join(map(str, turnless)).encode()).hexdigest()
    assert got == Counter([(turnless[0], 0, None, 2, 0, 1, 0, ends)])


def test_query(spark):
    rows = duckdb.execute(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall()
    got = Counter(tuple(r) for r in QUERIES["op13_burst_trie"](spark, SMALL).collect())
    assert got == nodes(rebuilt(rows))
