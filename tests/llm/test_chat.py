"""Chat snapshots against a plain reading of them."""

from collections import Counter

import pytest

from tablewarden.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, TURN string, part int"


def expected(rows, per_part=chat.TURNS_PER_PART):
    chats: dict = {}
    for r in {r[:4] for r in rows}:
        chats.setdefault(r[0], []).append(r[1:])
    key = lambda t: tuple((v is None, v) if v is not None else (True, 0 if k == 0 else "") for k, v in enumerate(t))
    chats = {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in chats.items()}
    out = []
    for c, ts in chats.items():
        others = [(d, us) for d, us in chats.items() if d != c]
        if any(len(us) > len(ts) and us[: len(ts)] == ts for _, us in others):
            continue
        if any(us == ts and d is not None and (c is None or d < c) for d, us in others):
            continue
        for at in range(0, len(ts), per_part):
            part = ts[at : at + per_part]
            text = "".join(f"<|{'unknown' if r is None else r}|>\n{t or ''}<|end|>\n" for r, t in part)
            out.append((c, at // per_part, at, len(part), text))
    return Counter(out)


def rows():
    base = [("user", "hi"), ("assistant", "hello"), ("user", ""), ("assistant", None), (None, "end")]
    out = []
    for c, n in ((5, 1), (6, 2), (7, 5), (8, 5), (9, 3), (10, 4)):
        out += [(c, k * 2, *t) for k, t in enumerate(base[:n])]
    out += [(11, 0, "user", "hi"), (11, 1, "assistant", "other"), (12, None, "user", "late"), (12, 1, "user", "hi")]
    out += [(None, 0, "user", "nobody"), (13, 0, "user", "nobody"), (14, 3, "user", "tie"), (14, 3, "assistant", "tie"), (14, 3, None, "tie")]
    out += [(20, k, "user", f"t{k % 7}") for k in range(3000)] + [(21, k, "user", f"t{k % 7}") for k in range(2999)]
    out += [(30, 0, "user", "é" * 300_000)]
    return [(*r, "x", 1) for r in out + out[:4]]


@pytest.mark.parametrize("per_part", [256, 2])
def test_maximal_conversations(spark, per_part):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = Counter(tuple(r) for r in chat.format_chats(df, per_part).collect())
    assert got == expected(rows(), per_part)
    assert {r[0] for r in got} == {7, 11, 12, 13, 14, 20, 30}


def test_nothing(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_differs_from_empty(spark):
    own = [(1, 0, "user", None), (2, 0, "user", ""), (2, 1, "user", "more"), (3, 0, None, ""), (4, 0, "", "")]
    df = spark.createDataFrame(own, "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in chat.format_chats(df).collect()} == {1, 2, 3, 4}
