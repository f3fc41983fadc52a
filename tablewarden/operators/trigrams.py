"""Trigram index: substring and regular-expression search that reads only rows which can match.

The rows are laid out in granules, runs of neighbouring rows, and the index says
which granules hold which three characters in a row. A value or pattern must
hold certain trigrams wherever it matches; only granules that have all of them
are read, and the predicate of a plain search decides there.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewarden.operators.layout import runs
from tablewarden.operators.search import SearchValue, hits_of, match_text, row_key
from tablewarden.sources.tables import TableSet

GRANULE = "__granule"
#: Rows of a granule, and of a Parquet page, the least that can be skipped.
GRANULE_ROWS = 1024
#: Granules a search picks one by one; where more can match, it reads all rows.
MOST_GRANULES = 100_000
#: Runs of granules that go into the Parquet filter; more are joined where the gaps are smallest.
RUNS = 256

# Characters besides A-Z that a pattern without regard to case takes for ASCII letters, and those letters.
# U+0307 is what the lower-case form of U+0130 has after its "i".
_LIKE_ASCII, _ASCII = "ſı̇", "si"


# Beginnings of quotes, of flags, and of classes that hold a closing bracket.
_NOT_READ = ("\\Q", "(?x", "(?-", "(?s", "(?m", "(?u", "(?U", "(?i", "(?d", "[]", "[^]")


def folded(text: Column) -> Column:
    """A text in lower case, such that ASCII letters a match can take are ASCII letters here."""
    return F.translate(F.lower(text), _LIKE_ASCII, _ASCII)


def trigrams(literal: str) -> set[str]:
    """The ASCII trigrams of a literal in lower case."""
    low = "".join(c.lower() if c.isascii() else "ÿ" for c in literal)
    return {low[i : i + 3] for i in range(len(low) - 2) if low[i : i + 3].isascii()}


def _group_end(pattern: str, at: int) -> int:
    """The place after the parenthesis that closes the one at ``at``, or -1."""
    depth, in_class = 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif not in_class and c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return at + 1
        at += 1
    return -1


def _class_end(pattern: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``, or -1."""
    depth = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return -1


def required_literals(pattern: str) -> list[list[str]] | None:
    """Texts that a match of a regular expression holds: for each alternative at the outermost level those it needs.

    None where nothing is known. Only plain characters are looked at; classes,
    groups, references and anchors are gaps between them, and a character that
    may be absent is none. Patterns that change what their characters mean,
    by flags for comments or quoting, are not looked into.
    """
    if any(p in pattern for p in _NOT_READ):
        return None
    alternatives: list[list[str]] = [[]]
    run = ""
    at = 0

    def close() -> None:
        nonlocal run
        if run:
            alternatives[-1].append(run)
        run = ""

    while at < len(pattern):
        c, plain = pattern[at], None
        if c == "|":
            close()
            alternatives.append([])
            at += 1
            continue
        if c == "\\":
            if at + 1 >= len(pattern):
                return None
            escaped = pattern[at + 1]
            at += 2
            if escaped.isalnum():  # a class, an anchor, a reference, or a character by its number
                if escaped in "xupPkN0c" or escaped.isdigit():
                    return None
            else:
                plain = escaped
        elif c in "([":
            end = _group_end(pattern, at) if c == "(" else _class_end(pattern, at)
            if end < 0:
                return None
            at = end
        elif c in ".^$":
            at += 1
        elif c in "*+?{":
            return None  # without something to repeat, or a form not known here
        else:
            plain, at = c, at + 1
        # how often it may come: one count, which a further mark makes lazy or possessive
        least = 1
        counted = at < len(pattern) and pattern[at] in "*+?{"
        if counted:
            if pattern[at] == "{":
                end = pattern.find("}", at)
                count = pattern[at + 1 : end].split(",")[0] if end > 0 else ""
                if not count.isdigit():
                    return None
                least, at = int(count), end + 1
            else:
                least, at = int(pattern[at] == "+"), at + 1
            if at < len(pattern) and pattern[at] in "+?":
                at += 1
        if plain is None:
            close()
        elif not counted:
            run += plain
        else:
            if least:
                run += plain
            close()
    close()
    return alternatives


def required_trigrams(v: SearchValue) -> list[set[str]] | None:
    """Alternatives, in one of which all trigrams must be present; None if rows cannot be told apart by trigrams."""
    if v.is_null or v.is_path:
        return None
    literals = required_literals(v.text) if v.regex else [[v.text]]
    if literals is None:
        return None
    grams = [set().union(*map(trigrams, parts)) if parts else set() for parts in literals]
    return grams if all(grams) else None


def write_trigram_index(df: DataFrame, path: str, columns: list[str], granule_rows: int = GRANULE_ROWS) -> None:
    """Lay out the rows in ``<path>/rows`` and write the index of some text columns to ``<path>/grams``.

    A granule is a run of rows of one file, so its number says where it is. Only
    the trigrams of ASCII characters are kept, once for each granule: they are
    reduced where the text is read, and sorted in each file after one shuffle.
    NULLs have no trigrams.
    """
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.StringType):
            raise ValueError(f"{c} is no text column")
    shift = (granule_rows - 1).bit_length()
    numbered = df.withColumn(GRANULE, F.shiftright(F.monotonically_increasing_id(), shift))
    numbered.write.option("parquet.page.row.count.limit", str(1 << shift)).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    per_column = [
        rows.select(
            F.lit(c).alias("of"),
            F.explode(F.array_distinct(F.regexp_extract_all(folded(F.col(f"`{c}`")), F.lit(r"(?s)(?=([\x00-\x7F]{3}))"), F.lit(1)))).alias("gram"),
            GRANULE,
        )
        for c in columns
    ]
    grams = reduce(DataFrame.unionAll, per_column).distinct()
    grams.sortWithinPartitions("of", "gram", GRANULE).write.parquet(f"{path}/grams")


def candidates(grams: DataFrame, wanted: list[set[str]], columns: list[str]) -> DataFrame:
    """Granules in which some column holds all trigrams of some alternative."""
    every = sorted(set().union(*wanted))
    held = grams.where(F.col("of").isin(columns) & F.col("gram").isin(every))
    # one number per granule and column; each bit of the mask is a trigram of the search
    masks = [sum(1 << i for i, g in enumerate(every) if g in grams_) for grams_ in wanted]
    if len(every) <= 62:
        bit = reduce(lambda out, i: out.when(F.col("gram") == every[i], 1 << i), range(1, len(every)), F.when(F.col("gram") == every[0], 1))
        seen = held.groupBy(GRANULE, "of").agg(F.bit_or(bit.cast("long")).alias("seen"))
        complete = reduce(or_, [F.col("seen").bitwiseAND(F.lit(m)) == m for m in masks])
        return seen.where(complete).select(GRANULE).distinct()
    parts = []
    for grams_ in wanted:
        full = held.where(F.col("gram").isin(sorted(grams_))).groupBy(GRANULE, "of").agg(F.count(F.lit(1)).alias("n"))
        parts.append(full.where(F.col("n") == len(grams_)).select(GRANULE))
    return reduce(DataFrame.unionAll, parts).distinct()


def picked_rows(spark: SparkSession, path: str, v: SearchValue, columns: list[str]) -> DataFrame:
    """The rows of the granules in which a value can be; all rows where the index cannot tell or too many are left."""
    rows = spark.read.parquet(f"{path}/rows")
    wanted = required_trigrams(v)
    if wanted is None:
        return rows
    # numbers of granules only, at most a fixed number of them
    found = [r[0] for r in candidates(spark.read.parquet(f"{path}/grams"), wanted, columns).limit(MOST_GRANULES + 1).collect()]
    if len(found) > MOST_GRANULES:
        return rows
    if not found:
        return rows.where(F.lit(False))
    found.sort()
    granule = F.col(GRANULE)
    # the ranges reach the Parquet reader, which skips files, row groups and pages by them
    ranges = reduce(or_, [granule.between(a, b) for a, b in runs(found, RUNS)])
    return rows.where(ranges & granule.isin(found))


def indexed_search(spark: SparkSession, path: str, table: str, value: str, columns: list[str], key: tuple[str, ...] = (), **how: bool) -> DataFrame:
    """What :func:`tablewarden.operators.search.search` finds in the indexed text columns, read through the index.

    ``columns`` are some of those the index was written with.
    """
    v = SearchValue(value, **how)
    rows = picked_rows(spark, path, v, columns)
    ts = TableSet.of(spark, {table: rows}, keys={table: key})
    predicates = {c: F.col(f"`{c}`").isNull() if v.is_null else match_text(F.col(f"`{c}`"), v) for c in columns}
    hits = hits_of(rows, predicates)
    return hits.select(F.lit(table).alias("table_name"), row_key(ts, table).alias("row_key"), "matching_columns")
