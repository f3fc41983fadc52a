"""References and keys as the data has them, whatever was declared."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewarden.functions.digests import value_key
from tablewarden.runtime import cut_lineage
from tablewarden.sources.tables import TableSet

#: Sets of columns whose distinct values are estimated in one job.
SETS_PER_JOB = 64
#: Binary logarithm of the registers of an estimate, whose standard error is 0.8 %.
REGISTERS = 14
#: An estimate below this share of the rows rules a key out: over ten standard errors.
RULED_OUT = 0.9


def _family(dtype: T.DataType) -> str | None:
    """Columns are compared within a family; floating numbers, truth values and nested ones are no references."""
    if isinstance(dtype, T.IntegralType):
        return "whole"
    if isinstance(dtype, T.DecimalType):
        return "decimal" if dtype.scale else "whole"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, T.DateType):
        return "date"
    return "time" if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) else None


def _comparable(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return value_key(col)
    if isinstance(dtype, T.DecimalType) and dtype.scale:  # 1.50 is 1.5
        return F.regexp_replace(col.cast("string"), r"\.?0+$", "")
    return col.cast("string")


def column_values(ts: TableSet) -> DataFrame:
    """``family, value, column, n``: how often each column holds a value; NULL is one.

    Every table is read once, whatever its number of columns, and values are
    counted map-side. ``column`` is ``table.column``. Long texts are their digest.
    """
    frames = []
    for name in ts.tables:
        df = ts[name]
        entries = [
            F.struct(F.lit(_family(f.dataType)).alias("family"), F.lit(f"{name}.{f.name}").alias("column"), _comparable(F.col(f"`{f.name}`"), f.dataType).alias("value"))
            for f in df.schema.fields if _family(f.dataType)
        ]
        if entries:
            frames.append(df.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    rows = reduce(DataFrame.unionByName, frames)
    return rows.groupBy("family", "value", "column").agg(F.count(F.lit(1)).alias("n"))


def discover_references(ts: TableSet, least_coverage: float = 1.0) -> DataFrame:
    """References that the data would allow: unary inclusion dependencies into unique columns.

    ``child_table, child_column, parent_table, parent_column, child_values,
    parent_values, covered, declared``: a child column of which at least the
    share ``least_coverage`` of the distinct values is held by a parent column
    without NULLs or repeats. NULLs and columns without values point nowhere.

    No two columns are joined. Values are grouped once to the set of columns that
    hold them; equal sets are counted, of which there are few; and what two
    columns share is a sum over these. A value that is everywhere is one row with
    one short list, as long as there are columns.
    """
    counted = cut_lineage(column_values(ts))
    facts = counted.groupBy("column").agg(
        F.count("value").alias("values"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("most"),
        F.max(F.when(F.col("value").isNull(), F.col("n"))).alias("nulls"),
    )
    holders = counted.where("value IS NOT NULL").groupBy("family", "value").agg(F.sort_array(F.collect_set("column")).alias("columns"))
    sets = holders.groupBy("columns").agg(F.count(F.lit(1)).alias("n"))
    first = sets.select("columns", "n", F.explode("columns").alias("child"))
    shared = first.select("child", "n", F.explode("columns").alias("parent")).where("child <> parent")
    shared = shared.groupBy("child", "parent").agg(F.sum("n").alias("covered"))
    child = facts.select(F.col("column").alias("child"), F.col("values").alias("child_values"))
    parent = facts.where("most = 1 AND nulls IS NULL").select(F.col("column").alias("parent"), F.col("values").alias("parent_values"))
    found = shared.join(child, "child").join(parent, "parent").where(F.col("covered") >= least_coverage * F.col("child_values"))
    declared = [(f"{r.child}.{r.column}", f"{r.parent}.{r.parent_column}", True) for r in ts.references]
    known = ts.spark.createDataFrame(declared, "child string, parent string, declared boolean")
    named = found.join(known, ["child", "parent"], "left")

    def part(col: str, i: int) -> Column:
        # a table name may hold a dot, a column name is what follows the last one
        return F.regexp_extract(col, r"^(.*)\.([^.]*)$", i)

    return named.select(
        part("child", 1).alias("child_table"), part("child", 2).alias("child_column"),
        part("parent", 1).alias("parent_table"), part("parent", 2).alias("parent_column"),
        "child_values", "parent_values", "covered", F.coalesce("declared", F.lit(False)).alias("declared"),
    )


def key_columns(df: DataFrame) -> list[str]:
    """Columns that can be part of a key by their type."""
    return [f.name for f in df.schema.fields if _family(f.dataType)]


def _estimates(df: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Distinct values of column sets, estimated together: a sketch per task and set is all that is shuffled."""
    out = {}
    for at in range(0, len(sets), SETS_PER_JOB):
        part = sets[at : at + SETS_PER_JOB]
        counts = df.agg(*[
            F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[F.col(f"`{c}`") for c in s]), REGISTERS)).alias(f"n{i}") for i, s in enumerate(part)
        ]).first()
        out |= dict(zip(part, counts, strict=True))
    return out


def _repeats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The values of some columns that several rows have."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")


def _checked(names: list[str], rows_of: dict[tuple[str, ...], DataFrame]) -> dict[tuple[str, ...], tuple[int, str | None]]:
    """For each set how many of its values repeat in its rows, and the smallest that does, as JSON; exact, in one job.

    Columns are known by their place in ``names``.
    """
    frames = []
    for i, (s, rows) in enumerate(rows_of.items()):
        places = [f"c{names.index(c)}" for c in s]
        value = F.struct(*[F.col(p).alias(c) for p, c in zip(places, s, strict=True)])
        repeated = _repeats(rows, places)
        frames.append(repeated.agg(F.count(F.lit(1)).alias("n"), F.to_json(F.min(value)).alias("example")).withColumn("i", F.lit(i)))
    found = reduce(DataFrame.unionByName, frames).collect() if frames else []
    sets = list(rows_of)
    return {sets[r.i]: (r.n, r.example) for r in found}


def _rows_that_repeat(rows: DataFrame, columns: list[str]) -> DataFrame:
    """All rows whose values of some columns several rows have, as a table of their own."""
    repeated = cut_lineage(_repeats(rows, columns)).toDF(*[f"r{i}" for i in range(len(columns))])
    same = [F.col(c) == F.col(f"r{i}") for i, c in enumerate(columns)]
    return cut_lineage(rows.join(repeated, same, "left_semi"))


def _parts(sets: list[tuple[str, ...]], known: list[tuple[str, ...]]) -> dict[tuple[str, ...], tuple[str, ...]]:
    """For sets a known part of them, such that few parts serve many sets; a part for one set only is not worth it."""
    out: dict[tuple[str, ...], tuple[str, ...]] = {}
    left = list(sets)
    while left and known:
        part = max(known, key=lambda p: sum(set(p) < set(s) for s in left))
        served = [s for s in left if set(part) < set(s)]
        if len(served) < 2:
            break
        out |= dict.fromkeys(served, part)
        left = [s for s in left if s not in out]
    return out


def discover_keys(df: DataFrame, columns: list[str] | None = None, most_columns: int = 3) -> DataFrame:
    """``columns, rows, unique, repeated_values, example``: the smallest sets of columns that tell all rows apart.

    Sets grow by a column a level. Supersets of a key, columns with NULLs and
    columns with a single value are left out; so are sets whose parts have too
    few values for the rows, by the product of their counts. The other sets of a
    level are estimated together, and those that come near the number of rows are
    checked exactly; where a part of such a set was checked before, only in the rows
    whose values of that part repeat, as no others can. A set that nearly is a key, such as one that was meant to
    be, comes back with ``unique`` false and a value that repeats. Sets of one
    column are tried at every level up to ``most_columns``.

    An empty table has no keys; a table of one row has that of no columns.
    """
    names = columns or key_columns(df)
    spark = df.sparkSession
    schema = "columns array<string>, rows long, unique boolean, repeated_values long, example string"
    nulls = [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"n{i}") for i, c in enumerate(names)]
    first = df.agg(F.count(F.lit(1)).alias("rows"), *nulls).first()
    rows = first[0]
    if rows < 2:
        return spark.createDataFrame([([], 1, True, 0, None)] if rows else [], schema)
    names = [c for c, n in zip(names, first[1:], strict=True) if not n]
    values = {s[0]: n for s, n in _estimates(df, [(c,) for c in names]).items()}
    names = [c for c in names if values[c] > 1]
    keys: list[tuple[str, ...]] = []
    out, known = [], {(c,): values[c] for c in names}
    placed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    nearly: list[tuple[str, ...]] = []
    for size in range(1, most_columns + 1):
        sets = []
        for s in combinations(names, size):
            if any(set(k) <= set(s) for k in keys):
                continue
            # what a part of one column less can have at most, times the values of that column
            most = min((known[(*s[:i], *s[i + 1 :])] * values[s[i]] for i in range(size) if (*s[:i], *s[i + 1 :]) in known), default=rows) if size > 1 else rows
            if most >= RULED_OUT * rows:
                sets.append(s)
        known |= _estimates(df, [s for s in sets if s not in known])
        near = [s for s in sets if known[s] >= RULED_OUT * rows]
        part_of = _parts(near, nearly)
        rows_of = {p: _rows_that_repeat(placed, [f"c{names.index(c)}" for c in p]) for p in dict.fromkeys(part_of.values())}
        for s, (repeated, example) in _checked(names, {s: rows_of[part_of[s]] if s in part_of else placed for s in near}).items():
            out.append((list(s), rows, repeated == 0, repeated, example))
            (nearly if repeated else keys).append(s)
    return spark.createDataFrame(out, schema)
