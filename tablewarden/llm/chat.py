"""Chat formatting: logged snapshots of a growing conversation are collapsed before it is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewarden.llm.common import Stages, pick, table

#: Turns whose numbers fall into one cell of a conversation; a longer one is worked on cell by cell.
TURNS_PER_CELL = 1024
#: Turns in one rendered part; most conversations have one part.
TURNS_PER_PART = 256


def _hashes(position: Column, role: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at its position; NULL differs from any text."""
    marks = F.concat(F.when(role.isNull(), "n").otherwise("r"), F.when(text.isNull(), "n").otherwise("t"))
    return [F.xxhash64(F.lit(salt), position, marks, role, F.lit(salt), text) for salt in ("first", "second")]


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, h1, h2, last``: turns in order with the hash of the conversation up to each.

    Turns are ordered by number, role and text, NULLs last; a row that is logged
    twice counts once. The rolling hash joins the hashes of turns at their
    positions by XOR, so it can be continued from cell to cell: windows hold a
    cell of a conversation each, and one row per cell is added up over the
    conversation.
    """
    cell = F.floor(F.col("turn") / TURNS_PER_CELL)
    rows = pick(turns, "conv_id", "turn", "role", "text").distinct().withColumn("cell", cell)
    keys = ["conv_id", "cell"]
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
    own = Window.partitionBy(*keys).orderBy(*order)
    cells = Window.partitionBy("conv_id").orderBy(F.col("cell").asc_nulls_last())
    before = cells.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")

    def carry(df: DataFrame, sums: DataFrame) -> DataFrame:
        # names apart from those of the rows
        sums = sums.withColumnsRenamed({"conv_id": "__conv", "cell": "__cell"})
        return df.join(sums, F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("cell").eqNullSafe(F.col("__cell"))).drop("__conv", "__cell")

    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("turns", F.sum("n").over(whole)).drop("n")
    rows = carry(rows, counts).withColumn("position", F.row_number().over(own) - 1 + F.col("skipped")).drop("skipped")
    first, second = _hashes(F.col("position"), F.col("role"), F.col("text"))
    rows = rows.withColumn("t1", first).withColumn("t2", second)
    # one row per position in a cell: XOR up to it, then XOR of the cells before
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("x1", F.bit_xor("t1").over(upto)).withColumn("x2", F.bit_xor("t2").over(upto))
    sums = rows.groupBy(*keys).agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    zero = F.lit(0).cast("long")
    sums = sums.withColumn("b1", F.coalesce(F.bit_xor("s1").over(before), zero)).withColumn("b2", F.coalesce(F.bit_xor("s2").over(before), zero))
    rows = carry(rows, sums.drop("s1", "s2"))
    return rows.select(
        "conv_id", "position", "role", "text", F.col("x1").bitwiseXOR(F.col("b1")).alias("h1"),
        F.col("x2").bitwiseXOR(F.col("b2")).alias("h2"), (F.col("position") == F.col("turns") - 1).alias("last"),
    )


def maximal(rows: DataFrame) -> DataFrame:
    """``conv_id`` of the conversations that no other one continues; of equal ones the smallest id."""
    whole = rows.where("last").groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    continued = rows.where("NOT last").select("position", "h1", "h2").distinct()
    return whole.join(continued, ["position", "h1", "h2"], "left_anti").select("conv_id")


def rendered(role: Column, text: Column) -> Column:
    """One turn as text: role line, content, end mark. A turn without role is of ``unknown``."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_chats(turns: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """``conv_id, part, first_turn, n_turns, text``: the maximal conversations, rendered.

    ``turns`` has ``conv_id, turn, role, text``. A conversation whose turns
    begin another, longer one is a snapshot of it and is left out; of equal
    conversations the one with the smallest id stays. Prefixes are compared by
    128 bits of hashes. A conversation of more than ``turns_per_part`` turns is
    rendered in parts, so that a very long one never has to fit into one row.

    Rows without ``conv_id`` are one conversation, left out when another equals
    it; a NULL turn comes last, NULL roles and texts are allowed and differ from
    empty ones. Rows that are equal in all four columns count once. An empty
    table gives no rows.
    """
    rows, _ = Stages(turns.sparkSession, "turns").write(prefixes(turns))
    stay = maximal(rows).select(F.col("conv_id").alias("__conv"))
    kept = rows.join(stay, F.col("conv_id").eqNullSafe(F.col("__conv")), "left_semi")
    part = F.floor(F.col("position") / turns_per_part).alias("part")
    turn = F.struct("position", rendered(F.col("role"), F.col("text")).alias("text"))
    parts = kept.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return parts.select(
        "conv_id", "part", F.get("turns", F.lit(0))["position"].cast("long").alias("first_turn"),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH logged AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
numbered AS (
  SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) - 1 AS position,
    count(*) OVER (PARTITION BY conv_id) AS turns
  FROM logged),
shown AS (
  SELECT *, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line,
    coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n') AS exact
  FROM numbered),
rolling AS (
  SELECT *, string_agg(exact, '') OVER (PARTITION BY conv_id ORDER BY position) AS upto FROM shown),
stay AS (
  SELECT min(conv_id) AS conv_id FROM rolling w WHERE position = turns - 1 AND NOT EXISTS (
    SELECT 1 FROM rolling p WHERE p.position < p.turns - 1 AND p.position = w.position AND p.upto = w.upto)
  GROUP BY upto)
SELECT conv_id, CAST(position // {TURNS_PER_PART} AS BIGINT) AS part, CAST(min(position) AS BIGINT) AS first_turn,
  CAST(count(*) AS BIGINT) AS n_turns, string_agg(line, '' ORDER BY position) AS text
FROM shown WHERE conv_id IN (SELECT conv_id FROM stay) OR (conv_id IS NULL AND EXISTS (SELECT 1 FROM stay WHERE conv_id IS NULL))
GROUP BY conv_id, position // {TURNS_PER_PART}
"""
