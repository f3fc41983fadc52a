"""Prefix trie of conversations, built as a burst trie.

Equal conversations are one sequence with a weight. All sequences begin in one
container under the root. A container that holds more than a bound of turns is
burst: each of its sequences moves below the trie head that its next turn leads
to. What is left are containers of few suffixes, which are dealt over shards,
sorted and swept into nodes, and containers of one suffix, whose nodes are a
chain and need no sweep. What containers say of themselves is added up over the
heads above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewarden.llm.common import Stages, pick, ship_package, table

#: Turns in a container above which it is burst.
CONTAINER_TURNS = 400
#: Ids of one chunk of a list of members; chunks are joined before they meet.
IDS_PER_CHUNK = 4096
#: Turns of a sequence in one cell when sums run along it.
TURNS_PER_CELL = 1024

_VALUES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_seq")


def ordered_turns(turns: DataFrame, turns_per_cell: int = TURNS_PER_CELL) -> DataFrame:
    """``conv_id, at, role, text``: turns from 1 on in the order of their number, NULL first, then of role and text.

    NULL roles and texts become empty. A long conversation is counted cell by
    cell of turn numbers.
    """
    rows = pick(turns, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / turns_per_cell), F.lit(-(1 << 62))).alias("cell"),
    )
    # NULL numbers come before all others, so they have the lowest cell
    counts = rows.groupBy("conv_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    own = Window.partitionBy("conv_id", "cell").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.withColumn("at", F.row_number().over(own)).join(counts, ["conv_id", "cell"])
    return numbered.select("conv_id", (F.col("at") + F.col("skipped")).alias("at"), "role", "text")


def rebuilt(turns: DataFrame, family: Column, heads: Column) -> DataFrame:
    """``conv_id, at, role, text``: every conversation with its first turns taken from the head of its family.

    ``family`` and ``heads`` are of ``conv_id``: the conversation whose first
    ``heads`` turns replace the own ones; fewer if it has fewer, none if there
    is no such conversation. A conversation may be left without turns and then
    has one row with a NULL ``at``.
    """
    own = ordered_turns(turns)
    convs = own.select("conv_id").distinct().withColumn("family", family).withColumn("heads", heads)
    rest = own.join(convs, "conv_id").where(F.col("at") > F.col("heads"))
    given = own.withColumnRenamed("conv_id", "family").join(convs, "family").where(F.col("at") <= F.col("heads"))
    taken = given.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    moved = rest.join(taken, "conv_id", "left").withColumn("at", F.col("at") - F.col("heads") + F.coalesce("taken", F.lit(0)))
    rows = given.select("conv_id", "at", "role", "text").unionAll(moved.select("conv_id", "at", "role", "text"))
    return convs.select("conv_id").join(rows, "conv_id", "left")


def _turn_id(role: Column, text: Column) -> Column:
    """128 bits that name a turn."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))


def _members_digest(members: DataFrame) -> DataFrame:
    """``seq, ends_sha256``: the digest of the ids of equal conversations, ascending, joined by commas.

    A digest is read from front to back, so each list goes through one task, but
    as chunks that were joined before, and only one chunk at a time.
    """
    chunks = members.groupBy("seq", F.floor(F.col("conv_id") / IDS_PER_CHUNK).alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([state.hexdigest()])], ["seq", "ends_sha256"])

        for batch in batches:
            for own, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own != seq:
                    if seq is not None:
                        yield done()
                    seq, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if seq is not None:
            yield done()

    dealt = chunks.repartition("seq").sortWithinPartitions("seq", "chunk").select("seq", "ids")
    return dealt.mapInArrow(digest, "seq long, ends_sha256 string")


def sweep(suffixes: list[tuple[list[bytes], list[int], int, int]], depth: int) -> list[tuple]:
    """Nodes below a head at a depth, from its suffixes ``(turn ids, characters, smallest member, weight)``.

    Suffixes are sorted, and a stack holds the nodes of the last one; a node is
    closed when a suffix leaves it. Nodes come as :data:`_VALUES`. Those just
    below the head have no parent here, and the last row is what the head gets:
    children, leaves and saved tokens, at depth -1.
    """
    # a node on the stack: characters, smallest member, members, children, leaves, saved tokens, sequence that ends, closed children
    blank = (1 << 63, 0, 0, 0, 0, None)
    out, path, stack = [], [], [[0, *blank, []]]

    def close() -> None:
        chars, conv, n, children, leaves, saved, end, below = stack.pop()
        path.pop()
        leaves, saved = leaves or 1, saved + (n - 1) * chars
        for row in below:
            row[2] = conv
        out.append(row := [conv, depth + len(stack), None, n, children, leaves, saved, end])
        above = stack[-1]
        above[1], above[2], above[3] = min(above[1], conv), above[2] + n, above[3] + 1
        above[4], above[5] = above[4] + leaves, above[5] + saved
        above[7].append(row)

    for ids, chars, seq, weight in sorted(suffixes, key=lambda s: s[0]):
        shared = 0
        while shared < min(len(path), len(ids)) and path[shared] == ids[shared]:
            shared += 1
        while len(path) > shared:
            close()
        for own, turn in zip(chars[shared:], ids[shared:], strict=True):
            stack.append([own, *blank, []])
            path.append(turn)
        last = stack[-1]
        last[1], last[2], last[6] = min(last[1], seq), last[2] + weight, seq
    while path:
        close()
    _, _, _, children, leaves, saved, _, _ = stack[0]
    return [*out, [None, -1, None, None, children, leaves, saved, None]]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of containers from their rows, which are sorted by head, sequence and place."""
    kind = pa.schema([("head", pa.binary()), *[(n, pa.int64()) for n in _VALUES]])
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for (head, depth), container in groupby(rows, key=lambda r: r[:2]):
        suffixes = []
        for (seq, weight), own in groupby(container, key=lambda r: r[2:4]):
            ids, chars = zip(*[r[4:6] for r in own], strict=True)
            suffixes.append((list(ids), list(chars), seq, weight))
        nodes = sweep(suffixes, depth)
        arrays = [pa.array(column, pa.int64()) for column in zip(*nodes, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([head] * len(nodes), pa.binary()), *arrays], schema=kind)


def _sum_onwards(rows: DataFrame, value: Column, out: str, turns_per_cell: int) -> DataFrame:
    """Adds the sum of a value over a sequence's turns from each one on, cell by cell."""
    rows = rows.withColumn("__cell", F.floor(F.col("at") / turns_per_cell)).withColumn("__value", value)
    sums = rows.groupBy("seq", "__cell").agg(F.sum("__value").alias("__sum"))
    later = Window.partitionBy("seq").orderBy(F.col("__cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("seq", "__cell", F.coalesce(F.sum("__sum").over(later), F.lit(0)).alias("__later"))
    own = Window.partitionBy("seq", "__cell").orderBy(F.col("at").desc())
    summed = rows.join(sums, ["seq", "__cell"]).withColumn(out, F.sum("__value").over(own) + F.col("__later"))
    return summed.drop("__cell", "__value", "__later")


def _burst(stages: Stages, turns: DataFrame, sequences: DataFrame, container_turns: int) -> DataFrame:
    """``seq, len, weight, depth, head, above, chars``: the heads each sequence passes, down to that of its container."""
    zero = F.lit(0).cast("long")
    root = F.lit(bytes(16))
    here, _ = stages.write(sequences.select(
        "seq", "len", "weight", zero.alias("depth"), root.alias("head"), F.lit(None).cast("binary").alias("above"), zero.alias("chars")
    ))
    passed = here
    while True:
        sizes = here.groupBy("head").agg(F.sum(F.col("len") - F.col("depth")).alias("turns"), F.count(F.lit(1)).alias("n"))
        burst, _ = stages.write(sizes.where(_is_burst(container_turns)).select("head"))
        if burst.isEmpty():
            return passed
        moving = here.where("len > depth").join(burst, "head", "left_semi").withColumn("at", F.col("depth") + 1).drop("chars")
        below = F.unhex(F.substring(F.sha2(F.concat("head", "id"), 256), 1, 32))
        here, _ = stages.write(moving.join(turns, ["seq", "at"]).select(
            "seq", "len", "weight", F.col("at").alias("depth"), below.alias("head"), F.col("head").alias("above"), "chars"
        ))
        passed = passed.unionAll(here)


def _is_burst(container_turns: int) -> Column:
    return (F.col("turns") > container_turns) & (F.col("n") > 1)


def trie(conversations: DataFrame, container_turns: int = CONTAINER_TURNS, turns_per_cell: int = TURNS_PER_CELL) -> DataFrame:
    """A row for each node of the prefix trie of ``conversations``: ``conv_id, at, role, text``, as :func:`rebuilt` gives them.

    ``conv_id`` smallest member; ``depth``; ``parent_conv_id``, the parent's
    (root: NULL); ``n_convs``, members; ``n_children``; ``n_leaves``, childless
    nodes in the subtree; ``saved_tokens``, over the subtree the characters of
    the last turn of a node times its members but one; ``ends_sha256``, digest
    of the ids of the members that end here. A node is known by ``conv_id`` and
    ``depth``.

    Turns are compared by 128 bits of their SHA-256, whole conversations by two
    64-bit hashes that are joined over their turns, so no conversation is
    gathered to find its equals. Empty texts are turns like others, long ones
    travel as their digest, and conversations without turns end in the root. An
    empty table gives no rows.

    A container of more than ``container_turns`` turns is burst, one turn deeper
    a round, until it is small or holds one sequence. So there are as many
    rounds as turns that more than a container of *different* conversations
    share, and no task gathers more than a container. The turns of a single
    sequence stay rows.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    stages = Stages(spark, "trie")
    given = F.col("at").isNotNull()
    turns, _ = stages.write(conversations.select(
        "conv_id", F.col("at").cast("long").alias("at"), F.when(given, _turn_id(F.col("role"), F.col("text"))).alias("id"),
        F.length("text").cast("long").alias("chars"),
    ))
    joined = [F.coalesce(F.bit_xor(F.when(given, F.xxhash64(F.lit(salt), "at", "id"))), F.lit(0).cast("long")).alias(salt) for salt in ("x", "y")]
    whole, _ = stages.write(turns.groupBy("conv_id").agg(F.count("at").alias("len"), *joined))
    sequences, _ = stages.write(whole.groupBy("len", "x", "y").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("weight")))
    ends = _members_digest(whole.join(sequences, ["len", "x", "y"]).select("seq", "conv_id"))
    turns, _ = stages.write(turns.where(given).withColumnRenamed("conv_id", "seq").join(sequences.select("seq"), "seq", "left_semi"))

    passed = _burst(stages, turns, sequences, container_turns)
    heads = passed.groupBy("head", "above", "depth", "chars").agg(
        F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("len") - F.col("depth")).alias("turns"), F.max(F.when(F.col("len") == F.col("depth"), F.col("seq"))).alias("end_seq"),
    ).withColumn("burst", _is_burst(container_turns))
    heads, _ = stages.write(heads)

    # containers of several suffixes are sorted and swept, one to a shard's turn
    last = passed.join(heads.where("NOT burst").select("head", "n"), "head").select("seq", "weight", "len", "depth", "head", "n")
    behind = turns.join(last, "seq").where("at > depth")
    several = behind.where("n > 1").repartition("head").sortWithinPartitions("head", "seq", "at")
    kind = "head binary, " + ", ".join(f"{n} long" for n in _VALUES)
    swept, _ = stages.write(several.select("head", "depth", "seq", "weight", "id", "chars").mapInArrow(_swept, kind))
    chain, _ = stages.write(_sum_onwards(behind.where("n = 1"), (F.col("weight") - 1) * F.col("chars"), "saved", turns_per_cell))

    # what containers say of themselves goes to all heads above, along the path of one of their sequences
    of_sweep = swept.where("depth = -1").select("head", "n_children", "n_leaves", "saved_tokens")
    of_chain = chain.where("at = depth + 1").select("head", F.lit(1).cast("long").alias("n_children"), "saved")
    facts = heads.join(of_sweep, "head", "left").join(of_chain.withColumnRenamed("n_children", "one"), "head", "left").select(
        F.col("conv_id").alias("seq"), F.col("depth").alias("deepest"),
        F.when(F.col("burst"), 0).otherwise(F.coalesce("n_leaves", F.lit(1))).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved_tokens", "saved", F.lit(0))).alias("saved"),
    )
    sums = facts.join(passed.select("seq", "depth", "head"), "seq").where("depth <= deepest").groupBy("head").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    below = heads.where("above IS NOT NULL").groupBy(F.col("above").alias("head")).agg(F.count(F.lit(1)).alias("n_children"))
    below = below.unionAll(of_sweep.select("head", "n_children")).unionAll(of_chain.select("head", "n_children"))
    names = heads.select(F.col("head").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    own = heads.join(names, "above", "left").join(sums, "head").join(below, "head", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", "end_seq"
    )
    inner = swept.where("depth >= 0").join(names.withColumnsRenamed({"above": "head", "parent_conv_id": "top"}), "head")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top")).select(*_VALUES)
    ending = F.col("at") == F.col("len")
    alone = chain.select(
        F.col("seq").alias("conv_id"), F.col("at").alias("depth"), F.col("seq").alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(ending, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.when(ending, F.col("seq")).alias("end_seq"),
    )
    nodes = own.unionAll(inner).unionAll(alone)
    ended = nodes.join(ends.withColumnRenamed("seq", "end_seq"), "end_seq", "left")
    return ended.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))).drop("end_seq")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    heads = F.crc32(conv.cast("string").cast("binary")) % 6
    whole = rebuilt(table(spark, sf_dir, "conversations"), conv - conv % 100, heads)
    return trie(whole).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


#: Every prefix of every rebuilt conversation as a value; the CRC-32 is computed bit by bit.
SQL = """
    WITH t AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), i AS (
        SELECT c, c - c % 100 AS f, xor(list_reduce(
            list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
            lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))
        ), 4294967295::UBIGINT) % 6 AS h FROM (SELECT DISTINCT c FROM t)
    ), u AS (
        SELECT i.c, 0 AS own, t.pos, role, text FROM i JOIN t ON t.c = i.f AND t.pos <= h
        UNION ALL SELECT i.c, 1, t.pos, role, text FROM i JOIN t ON t.c = i.c AND t.pos > h
    ), l AS (
        SELECT i.c, coalesce(list(struct_pack(r := role, x := text) ORDER BY own, pos) FILTER (own IS NOT NULL), []) AS s FROM i LEFT JOIN u USING (c) GROUP BY i.c
    ), m AS (
        SELECT c, d, len(s) AS len, sha256(CAST(s[1:d] AS VARCHAR)) AS node, sha256(CAST(s[1:d - 1] AS VARCHAR)) AS above, coalesce(length(s[d].x), 0) AS chars
        FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM l)
    ), n AS (
        SELECT d, node, any_value(above) AS above, min(c) AS conv, count(*) AS n, any_value(chars) AS chars,
            sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len = d), '')) AS ends FROM m GROUP BY d, node
    ), k AS (SELECT d - 1 AS d, above AS node, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL
    ), v AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k USING (d, node)
    ), s AS (
        SELECT a.d, a.node, sum((v.n - 1) * v.chars) AS saved, count(*) FILTER (v.children = 0) AS leaves
        FROM v JOIN m a ON a.c = v.conv AND a.d <= v.d GROUP BY a.d, a.node
    )
    SELECT v.conv AS conv_id, v.d AS depth, p.conv AS parent_conv_id, v.n AS n_convs, v.children AS n_children, s.leaves AS n_leaves,
        CAST(s.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
    FROM v JOIN s USING (d, node) LEFT JOIN n p ON p.d = v.d - 1 AND p.node = v.above
"""
