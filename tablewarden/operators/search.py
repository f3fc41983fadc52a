"""Find a value anywhere in a set of tables.

One plan per table, one union, one job: a hit is ``(table_name, row_key,
matching_columns)``. The predicate that selects a row is the one that names its
columns, so a hit always lists why it was found. Values travel as literals; no
character of them acts as a wildcard unless a regular expression is asked for.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewarden.functions.digests import row_digest
from tablewarden.functions.jsontext import any_leaf, hint, variant_path
from tablewarden.functions.values import as_number, type_tag
from tablewarden.runtime import run_together
from tablewarden.sources.sinks import text_form
from tablewarden.sources.tables import TableSet


# Spellings of the two truth values.
_TRUE_WORDS = ("true", "t", "yes", "y", "1")
_FALSE_WORDS = ("false", "f", "no", "n", "0")

# All characters the text of a date or time can have.
_DATE_CHARACTERS = set("0123456789+-:. ")

_HIT_SCHEMA = "table_name string, row_key string, matching_columns array<string>"


@dataclass(frozen=True)
class SearchValue:
    """The value looked for and how it is compared."""

    text: str
    exact: bool = False
    case_sensitive: bool = False
    regex: bool = False
    recursive: bool = False
    text_form: bool = False

    @property
    def is_null(self) -> bool:
        return self.text.lower() == "null"

    @property
    def is_path(self) -> bool:
        return self.recursive and "->" in self.text

    @property
    def pattern(self) -> str:
        """What to match as a regular expression, flags included."""
        body = self.text if self.regex else re.escape(self.text)
        return body if self.case_sensitive else f"(?iu){body}"


def match_text(col: Column, v: SearchValue) -> Column:
    """Regular expression, equality or substring, with or without case."""
    if v.regex:
        return col.rlike(v.pattern)
    if v.case_sensitive:
        return col == F.lit(v.text) if v.exact else col.contains(F.lit(v.text))
    lowered = F.lower(col)
    needle = F.lower(F.lit(v.text))
    return lowered == needle if v.exact else lowered.contains(needle)


def match_number(col: Column, dtype: T.DataType, v: SearchValue) -> Column | None:
    """Numeric equality, so that 1 finds 1.0; ``text_form`` compares the texts.

    An integer column is compared with an integer literal and a decimal column
    with a decimal one, which stays exact and reaches the Parquet filter.
    """
    number = as_number(v.text)
    if number is None:
        return None
    if v.text_form:
        return col.cast("string") == F.lit(v.text)
    if isinstance(dtype, T.IntegralType):
        if number != number.to_integral_value() or abs(number) >= 2**63:
            return F.lit(False)
        return col == F.lit(int(number))
    if isinstance(dtype, T.DecimalType):
        return col == F.lit(number)
    if isinstance(dtype, T.FloatType):
        # the nearest float, as the column itself holds it
        return col == F.lit(float(number)).cast("float")
    return col == F.lit(float(number))


def _contains_number(col: Column, element: T.DataType, v: SearchValue) -> Column:
    """As :func:`match_number` on every element, in generated code."""
    number = as_number(v.text)
    if isinstance(element, T.IntegralType):
        if number != number.to_integral_value() or abs(number) >= 2**63:
            return F.lit(False)
        return F.array_contains(col.cast("array<bigint>"), F.lit(int(number)).cast("bigint"))
    if isinstance(element, T.DecimalType):
        return F.exists(col, lambda e: e == F.lit(number))
    return F.array_contains(col, F.lit(float(number)).cast(element))


def match_boolean(col: Column, v: SearchValue) -> Column | None:
    word = v.text.lower()
    if word in _TRUE_WORDS:
        return col == F.lit(True)
    if word in _FALSE_WORDS:
        return col == F.lit(False)
    return None


def match_json_text(col: Column, v: SearchValue) -> Column:
    """JSON held as text or VARIANT: a path, ``key:value``, any leaf, or its text."""
    text = col
    if v.is_path:
        return _hinted(_match_path(F.try_parse_json(text), v), text, v)
    if v.recursive:
        return _hinted(any_leaf(text, lambda kind, plain: _match_leaf(kind, plain, v)), text, v)
    if ":" in v.text and not v.regex:
        key, value = (p.strip() for p in v.text.split(":", 1))
        if key and value:
            doc = F.try_parse_json(text)
            at_key = variant_path([key])
            # the text 1 and the number 1 differ: only a string value can be equal
            return (F.try_variant_get(doc, at_key, "string") == F.lit(value)) & (
                F.schema_of_variant(F.try_variant_get(doc, at_key, "variant")) == "STRING"
            )
    if v.regex:
        return text.rlike(v.pattern)
    return F.lower(text).contains(F.lower(F.lit(v.text)))


def _hinted(match: Column, text: Column, v: SearchValue, raw: bool = True) -> Column:
    """The match, tried only where the JSON text can hold the value at all."""
    if v.regex or v.is_null:
        return match
    target = v.text.split("->")[-1].strip() if v.is_path else v.text
    worth = hint(text, target, raw)
    return match if worth is None else worth & match


def _match_path(doc: Column, v: SearchValue) -> Column:
    """``a->b->0->value``: the value at the path, or one element of an array there."""
    *path, target = (p.strip() for p in v.text.split("->"))
    at = variant_path(path)
    single = F.try_variant_get(doc, at, "string") == F.lit(target)
    elements = F.try_variant_get(doc, at, "array<variant>")
    among = F.exists(elements, lambda e: F.try_variant_get(e, "$", "string") == F.lit(target))
    return F.coalesce(single, F.lit(False)) | F.coalesce(among, F.lit(False))


def _match_leaf(kind: Column, plain: Column, v: SearchValue) -> Column:
    number = as_number(v.text)
    if number is not None:
        numeric = plain.try_cast("double") == F.lit(float(number))
    else:
        numeric = plain.contains(F.lit(v.text))
    return (
        F.when(kind == "string", match_text(plain, v))
        .when(kind == "number", numeric)
        .when(kind == "boolean", plain == F.lit(v.text.lower()))
        .otherwise(F.lit(v.is_null))
    )


def match_variant(value: Column, v: SearchValue) -> Column:
    """The rules for one schema-less value, decided by what the value is.

    An array matches when an element does; an object matches on its JSON text,
    on any leaf when recursive, or on the value found along a path.
    """
    if v.is_path:
        *path, target = (p.strip() for p in v.text.split("->"))
        at = F.try_variant_get(value, variant_path(path), "variant")
        return match_variant(at, replace(v, text=target, recursive=False))

    def by_kind(x: Column, array_rule: Callable[[Column], Column]) -> Column:
        kind = type_tag(x)
        plain = F.try_variant_get(x, "$", "string")
        return (
            F.when(kind == "array", array_rule(x))
            .when(kind == "object", _match_object_text(F.to_json(x), v))
            .when(kind == "date", plain.contains(F.lit(v.text)))
            .otherwise(_match_leaf(kind, plain, v))
        )

    def leaves(x: Column) -> Column:
        return any_leaf(F.to_json(x), lambda kind, plain: _match_leaf(kind, plain, v))

    def elements(x: Column) -> Column:
        return F.exists(F.try_variant_get(x, "$", "array<variant>"), lambda e: by_kind(e, leaves))

    return by_kind(value, elements)


def _match_object_text(text: Column, v: SearchValue) -> Column:
    if v.recursive:
        return any_leaf(text, lambda kind, plain: _match_leaf(kind, plain, v))
    return match_text(text, replace(v, exact=False))


def matching_fields(doc: Column, v: SearchValue, field: str | None = None) -> Column:
    """Names of the top-level fields of a document that match; ``_id`` is left out."""
    entries = F.map_entries(F.try_variant_get(doc, "$", "map<string,variant>"))
    if field is None:
        # most documents cannot match, which their text tells sooner
        any_match = _hinted(F.lit(True), F.to_json(doc), v, raw=False)
        entries = F.when(any_match, entries)
    wanted = F.filter(
        entries,
        lambda e: (e["key"] == field if field else e["key"] != "_id")
        & F.coalesce(match_variant(e["value"], v), F.lit(False)),
    )
    return F.transform(wanted, lambda e: e["key"])


def match_value(col: Column, dtype: T.DataType, v: SearchValue, is_json: bool = False) -> Column | None:
    """The predicate for one column, or None when its type cannot hold the value."""
    if v.is_null:
        return col.isNull()
    if isinstance(dtype, T.VariantType):
        return match_variant(col, v)
    if is_json:
        return match_json_text(col, v)
    if isinstance(dtype, T.StructType):
        return _match_struct(col, dtype, v)
    if isinstance(dtype, T.ArrayType):
        if match_value(F.lit(None).cast(dtype.elementType), dtype.elementType, v) is None:
            return None
        if isinstance(dtype.elementType, T.NumericType) and not v.text_form:
            return _contains_number(col, dtype.elementType, v)
        return F.exists(col, lambda e: match_value(e, dtype.elementType, v))
    if isinstance(dtype, T.MapType):
        return match_json_text(F.to_json(col), v)
    if isinstance(dtype, T.StringType):
        return match_text(col, v)
    if isinstance(dtype, T.NumericType):
        return match_number(col, dtype, v)
    if isinstance(dtype, T.BooleanType):
        return match_boolean(col, v)
    if isinstance(dtype, T.BinaryType):
        return None
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if not set(v.text) <= _DATE_CHARACTERS:
            return F.lit(False)  # spares the formatting of every value
    # dates, times and the rest: part of the text form
    return col.cast("string").contains(F.lit(v.text))


def _match_struct(col: Column, dtype: T.StructType, v: SearchValue) -> Column | None:
    """A nested object: along a path, any leaf when recursive, else its JSON text."""
    if v.is_path:
        head, rest = (p.strip() for p in v.text.split("->", 1))
        if head not in dtype.names:
            return F.lit(False)
        below = replace(v, text=rest, recursive="->" in rest)
        inner, kind = col.getField(head), dtype[head].dataType
        if isinstance(kind, T.ArrayType) and below.is_path:
            position, _, tail = rest.partition("->")
            if position.strip().isdigit():
                inner = F.get(inner, int(position))
                kind = kind.elementType
                below = replace(v, text=tail.strip(), recursive="->" in tail)
        return match_value(inner, kind, below)
    if v.recursive:
        leaves = [match_value(col.getField(f.name), f.dataType, v) for f in dtype.fields]
        leaves = [F.coalesce(p, F.lit(False)) for p in leaves if p is not None]
        return reduce(or_, leaves) if leaves else None
    return match_json_text(F.to_json(col), v)


def column_predicates(
    ts: TableSet, table: str, v: SearchValue, column: str | None = None
) -> dict[str, Column]:
    """Searchable columns of a table with their predicates, in column order."""
    schema = ts[table].schema
    if column is not None and column not in schema.names:
        raise KeyError(f'column "{column}" does not exist in table "{table}"')
    out = {}
    for f in schema.fields:
        if column not in (None, f.name) or f.name == "_id":
            continue
        predicate = match_value(F.col(f"`{f.name}`"), f.dataType, v, ts.is_json(table, f.name))
        if predicate is not None:
            out[f.name] = predicate
    return out


def matching_columns(predicates: dict[str, Column]) -> Column:
    """Names of the columns whose predicate holds.

    Taking out a marker stays in generated code; a lambda over NULLs would not.
    """
    named = [F.when(p, F.lit(name)).otherwise(F.lit("")) for name, p in predicates.items()]
    return F.array_remove(F.array(*named), "")


def hits_of(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Rows with at least one matching column, plus the names of those columns.

    The filter is a plain OR: it stops at the first match, and the list of
    names is only built for rows that pass.
    """
    return df.where(reduce(or_, predicates.values())).withColumn(
        "matching_columns", matching_columns(predicates)
    )


def is_collection(df: DataFrame) -> bool:
    """True for schema-less documents: a VARIANT column named ``doc``."""
    return "doc" in df.columns and isinstance(df.schema["doc"].dataType, T.VariantType)


def row_key(ts: TableSet, table: str) -> Column:
    """The declared key as text, parts joined with ``|``; NULL without a key.

    A document without a declared key is known by its ``_id``.
    """
    key = ts.key_of(table)
    if not key and is_collection(ts[table]):
        return F.try_variant_get(F.col("doc"), "$._id", "string")
    if not key:
        return F.lit(None).cast("string")
    return F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in key])


def _limited(ts: TableSet, table: str, hits: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` hits of a table in key order, the same on every run: rows of one key follow a digest."""
    if limit is None:
        return hits
    key = ts.key_of(table)
    order = [*[F.col(f"`{k}`") for k in key], row_digest(ts[table].schema.fields)]
    return hits.orderBy(*order).limit(limit)


def _per_table(
    ts: TableSet,
    v: SearchValue,
    table: str | None,
    column: str | None,
    shape: Callable[[str, DataFrame], DataFrame],
    limit: int | None,
) -> list[DataFrame]:
    if table is None:
        # one broken table does not spoil the search of the others
        ts, errors = check_tables(ts)
        for name, error in errors.items():
            warnings.warn(f'table "{name}" is not searched: {error}', stacklevel=3)
    else:
        ts[table].schema  # noqa: B018 - an unknown table is an error
    frames = []
    for name in [table] if table else ts.names:
        if name.startswith("system."):
            continue
        if is_collection(ts[name]):
            found = matching_fields(F.col("doc"), v, column)
            hits = ts[name].withColumn("matching_columns", found).where(F.size("matching_columns") > 0)
            frames.append(shape(name, _limited(ts, name, hits, limit)))
            continue
        predicates = column_predicates(ts, name, v, column)
        if predicates:
            frames.append(shape(name, _limited(ts, name, hits_of(ts[name], predicates), limit)))
    return frames


def search(
    ts: TableSet,
    value: str,
    table: str | None = None,
    column: str | None = None,
    *,
    limit: int | None = None,
    with_data: bool = False,
    **how: bool,
) -> DataFrame:
    """Hits of a value in one column, one table or all tables.

    ``how`` takes exact, case_sensitive, regex, recursive and text_form.
    ``limit`` applies per table and is there for reports; None gives all hits.
    ``with_data`` adds the row as a map from column to text.
    """
    v = SearchValue(value, **how)

    def shape(name: str, hits: DataFrame) -> DataFrame:
        columns = [F.lit(name).alias("table_name"), row_key(ts, name).alias("row_key"), "matching_columns"]
        if with_data:
            columns.append(row_as_map(ts[name].schema).alias("data"))
        return hits.select(*columns)

    frames = _per_table(ts, v, table, column, shape, limit)
    if not frames:
        return ts.spark.createDataFrame([], _HIT_SCHEMA + (", data map<string,string>" if with_data else ""))
    return reduce(DataFrame.unionByName, frames)


def row_as_map(schema: T.StructType) -> Column:
    pairs = [x for f in schema.fields for x in (F.lit(f.name), text_form(f.name, f.dataType))]
    return F.create_map(*pairs)


def hits_compact(hits: DataFrame) -> DataFrame:
    """Keep of ``data`` only the columns that matched."""
    kept = F.map_filter("data", lambda name, _: F.array_contains("matching_columns", name))
    return hits.withColumn("data", kept)


def hits_wide(
    ts: TableSet,
    value: str,
    table: str | None = None,
    column: str | None = None,
    *,
    limit: int | None = None,
    **how: bool,
) -> DataFrame:
    """Hits of differently shaped tables under the union of their columns."""
    v = SearchValue(value, **how)

    def shape(name: str, hits: DataFrame) -> DataFrame:
        texts = [text_form(f.name, f.dataType).alias(f.name) for f in ts[name].schema.fields]
        joined = F.array_join("matching_columns", ";").alias("matching_columns")
        return hits.select(F.lit(name).alias("table"), joined, *texts)

    frames = _per_table(ts, v, table, column, shape, limit)
    if not frames:
        return ts.spark.createDataFrame([], "table string, matching_columns string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def hit_counts(hits: DataFrame) -> DataFrame:
    """Hits per table and column."""
    return (
        hits.select("table_name", F.explode("matching_columns").alias("column_name"))
        .groupBy("table_name", "column_name")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def highlight(col: Column, value: str, regex: bool = False, before: str = "<<", after: str = ">>") -> Column:
    """Wrap every match, upper or lower case, in two marks."""
    pattern = f"(?iu)({value if regex else re.escape(value)})"
    if value == "":
        return col
    left, right = (m.replace("\\", "\\\\").replace("$", "\\$") for m in (before, after))
    return F.regexp_replace(col, pattern, f"{left}$1{right}")


def check_tables(ts: TableSet) -> tuple[TableSet, dict[str, str]]:
    """Tables that open, and the error text of those that do not."""

    def problem(name: str) -> str | None:
        try:
            ts[name].schema  # noqa: B018 - opens the table
            return None
        except (PySparkException, Py4JError, OSError) as err:
            return str(err).splitlines()[0]

    found = run_together(ts.spark, [lambda n=n: problem(n) for n in ts.names], at_once=16)
    errors = {n: e for n, e in zip(ts.names, found) if e}
    return (ts.only(*[n for n in ts.names if n not in errors]) if errors else ts), errors
