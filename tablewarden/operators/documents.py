"""Document-style find, group, lookup and aggregation stages over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewarden.functions.values import type_tag
from tablewarden.operators.change import remove_field
from tablewarden.operators.predicates import Fields, compile_filter, fields_of
from tablewarden.operators.search import is_collection
from tablewarden.sources.tables import TableSet


def find(
    df: DataFrame,
    filter: dict | None = None,
    projection: dict | None = None,
    sort: dict | None = None,
    limit: int | None = None,
    skip: int = 0,
) -> DataFrame:
    """Filter, sort, skip, limit and project, in that order."""
    if filter:
        df = df.where(compile_filter(filter, fields_of(df)))
    if sort:
        df = df.orderBy(*_sort_columns(df, sort))
    if skip:
        df = df.offset(skip)
    if limit is not None:
        df = df.limit(limit)
    return project(df, projection) if projection else df


def _sort_columns(df: DataFrame, sort: dict) -> list[Column]:
    fields = fields_of(df)
    parts = [
        (part, way) for name, way in sort.items()
        for part in (_ranked(fields.value(name)) if fields.is_variant(name) else [_value(fields, name)])
    ]
    return [part.desc() if way < 0 else part.asc() for part, way in parts]


def _value(fields: Fields, path: str) -> Column:
    col = fields.value(path)
    return F.lit(None).cast("string") if col is None else col


# How values of different types sort in schema-less documents.
_TYPE_ORDER = ["null", "number", "string", "object", "array", "binary", "boolean", "date"]


def _ranked(value: Column) -> list[Column]:
    """A schema-less value as columns to order by: its type, then itself."""
    tag = type_tag(value)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in _TYPE_ORDER]), tag), F.lit(1))
    return [rank, _number(value), F.when(tag != "number", F.try_variant_get(value, "$", "string"))]


def _number(value: Column) -> Column:
    """The number a schema-less value is, or NULL."""
    return F.when(type_tag(value) == "number", F.try_variant_get(value, "$", "double"))


def _text_key(fields: Fields, path: str) -> Column:
    """A value as text that is equal for equal values, typed or schema-less."""
    if fields.is_variant(path):
        value = fields.value(path)
        number, plain = _number(value), F.to_json(value)
        return F.when(F.is_variant_null(value), F.lit(None)).otherwise(
            F.coalesce(F.concat(F.lit("n"), number.cast("string")), F.concat(F.lit("j"), plain))
        )
    dtype, col = fields.data_type(path), _value(fields, path)
    if isinstance(dtype, T.NumericType):
        return F.concat(F.lit("n"), col.cast("double").cast("string"))
    return F.concat(F.lit("j"), F.to_json(col.cast("variant")))


def project(df: DataFrame, spec: dict) -> DataFrame:
    """Keep, drop or compute fields.

    ``1`` or ``True`` keeps a field under its name, a dotted one under its last
    part; ``0`` drops it; ``"$a.b"`` or an expression computes one. ``_id`` is
    kept unless it is dropped by name.
    """
    drops = [n for n, v in spec.items() if v is False or (v == 0 and not isinstance(v, (str, dict)))]
    keeps = {n: v for n, v in spec.items() if n not in drops}
    fields = fields_of(df)
    if not keeps:
        for path in drops:
            df = df.drop(path) if path in df.columns else remove_field(df, path) if fields.loose else df
        return df
    if ("_id" in df.columns or fields.loose) and "_id" not in spec:
        keeps = {"_id": 1} | keeps
    out = []
    for name, v in keeps.items():
        col = _value(fields, name) if v is True or v == 1 else expression(v, df)
        out.append(col.alias(name.rsplit(".", 1)[-1]))
    return df.select(*out)


def expression(spec: Any, df: DataFrame) -> Column:
    """``"$a.b"`` reads a field, a dict applies an operator, the rest is a literal."""
    if isinstance(spec, str) and spec.startswith("$"):
        return _value(fields_of(df), spec[1:])
    if not isinstance(spec, dict):
        return F.lit(spec)
    if len(spec) == 1 and next(iter(spec)).startswith("$"):
        name, arg = next(iter(spec.items()))
        if name == "$size":
            if _is_variant(arg, df):
                return F.size(F.try_variant_get(expression(arg, df), "$", "array<variant>"))
            return F.size(expression(arg, df))
        if name == "$ifNull":
            return F.coalesce(*[expression(a, df) for a in arg])
        if name in _ARITHMETIC:
            return reduce(_ARITHMETIC[name], [_numeric(a, df) for a in arg])
        raise ValueError(f"unknown operator {name}")
    return F.struct(*[expression(v, df).alias(k) for k, v in spec.items()])


def _is_variant(spec: Any, df: DataFrame) -> bool:
    return isinstance(spec, str) and spec.startswith("$") and fields_of(df).is_variant(spec[1:])


def _numeric(spec: Any, df: DataFrame) -> Column:
    """An expression as something to calculate with."""
    return _number(expression(spec, df)) if _is_variant(spec, df) else expression(spec, df)


_ARITHMETIC = {
    "$add": lambda a, b: a + b,
    "$subtract": lambda a, b: a - b,
    "$multiply": lambda a, b: a * b,
    "$divide": lambda a, b: a / b,
}


def group(df: DataFrame, key: Any, accumulators: dict[str, dict]) -> DataFrame:
    """Group by an expression (None: all rows in one group) and accumulate.

    Every accumulator has a map-side partial form, so a key that holds most of
    the rows arrives at its task as one row per input partition.
    """
    aggs = [_accumulate(op, arg, df).alias(name) for name, spec in accumulators.items()
            for op, arg in spec.items()]
    if key is None:
        return df.agg(*aggs).select(F.lit(None).cast("string").alias("_id"), *accumulators)
    parts = key if isinstance(key, dict) else {"_id": key}
    if any(_is_variant(part, df) for part in parts.values()):
        # schema-less values group by a text, and stand for their group themselves
        texts = [_text_key(fields_of(df), p[1:]) if _is_variant(p, df) else expression(p, df) for p in parts.values()]
        keyed = df.groupBy(*[t.alias(f"__key{i}") for i, t in enumerate(texts)]).agg(
            *[F.any_value(expression(p, df)).alias(f"__part{i}") for i, p in enumerate(parts.values())], *aggs
        )
        found = [F.when(F.col(f"__key{i}").isNotNull(), F.col(f"__part{i}")).alias(n) for i, n in enumerate(parts)]
        return keyed.select(F.struct(*found).alias("_id") if isinstance(key, dict) else found[0], *accumulators)
    return df.groupBy(expression(key, df).alias("_id")).agg(*aggs)


def _accumulate(op: str, arg: Any, df: DataFrame) -> Column:
    if op == "$sum":
        if isinstance(arg, (int, float)) and not isinstance(arg, bool):
            return F.count(F.lit(1)) * F.lit(arg) if arg != 1 else F.count(F.lit(1))
        return F.coalesce(F.sum(_numeric(arg, df)), F.lit(0))
    if op == "$avg":
        return F.avg(_numeric(arg, df))
    if op in ("$min", "$max"):
        value = expression(arg, df)
        if not _is_variant(arg, df):
            return F.min(value) if op == "$min" else F.max(value)
        known = F.when(value.isNotNull() & ~F.is_variant_null(value), F.struct(*_ranked(value)))
        return F.min_by(value, known) if op == "$min" else F.max_by(value, known)
    if op == "$count":
        return F.count(F.lit(1))
    raise ValueError(f"unknown accumulator {op}")


def _item(other: DataFrame) -> Column:
    """A row of the other side as one value: its document, or a struct."""
    return F.col("doc") if is_collection(other) else F.struct(*[F.col(f"`{c}`") for c in other.columns])


def _join_keys(df: DataFrame, local: str, other: DataFrame, foreign: str) -> tuple[Column, Column]:
    """The fields of either side as columns that can be compared."""
    left, right = fields_of(df), fields_of(other)
    if left.is_variant(local) or right.is_variant(foreign):
        return _text_key(left, local), _text_key(right, foreign)
    return _value(left, local), _value(right, foreign)


def lookup_rows(
    df: DataFrame, other: DataFrame, local: str, foreign: str, as_: str, keep_empty: bool = False
) -> DataFrame:
    """Left rows with their matches: one row per match, the match as a struct or document.

    A row without matches is left out, or with ``keep_empty`` stays with NULL.
    Matches are never gathered into an array, so a key may have any number of
    them. A plain equi join: adaptive execution splits it when a key is hot.
    """
    left, right = _join_keys(df, local, other, foreign)
    matches = other.select(right.alias("__key"), _item(other).alias(as_))
    return df.join(matches, left == F.col("__key"), "left" if keep_empty else "inner").drop("__key")


def lookup_matching(
    df: DataFrame, other: DataFrame, local: str, foreign: str, condition: dict | None = None, none: bool = False
) -> DataFrame:
    """Left rows with a match that meets the condition, or with ``none`` those without one. Nothing is multiplied."""
    if condition:
        other = other.where(compile_filter(condition, fields_of(other)))
    left, right = _join_keys(df, local, other, foreign)
    return df.join(other.select(right.alias("__key")), left == F.col("__key"), "left_anti" if none else "left_semi")


def lookup_size(df: DataFrame, other: DataFrame, local: str, foreign: str, as_: str) -> DataFrame:
    """Only the number of matches, counted before the join."""
    left, right = _join_keys(df, local, other, foreign)
    counts = other.groupBy(right.alias("__key")).agg(F.count(F.lit(1)).alias(as_))
    joined = df.join(counts, left == F.col("__key"), "left").drop("__key")
    return joined.withColumn(as_, F.coalesce(as_, F.lit(0)))


def unwind(df: DataFrame, path: str, keep_empty: bool = False) -> DataFrame:
    """One row per element of an array; a value that is no array stays as it is.

    An array inside a schema-less document becomes a column of its name, which
    later stages see in its place.
    """
    name = path.removeprefix("$")
    fields = fields_of(df)
    explode = F.explode_outer if keep_empty else F.explode
    if fields.is_variant(name):
        value = fields.value(name)
        elements = F.coalesce(
            F.try_variant_get(value, "$", "array<variant>"), F.when(value.isNotNull() & ~F.is_variant_null(value), F.array(value))
        )
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], explode(elements).alias(name))
    if not isinstance(fields.data_type(name), T.ArrayType):
        return df if keep_empty else df.where(F.col(name).isNotNull())
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*others, explode(name).alias(name)).select(*df.columns)


def pipeline(ts: TableSet, base: str | DataFrame, stages: list[dict]) -> DataFrame:
    """A list of stages, each one key, applied in order.

    The matches of a ``$lookup`` are never gathered into arrays, see
    :class:`Looked`. Where it is the last stage, its result has one row per match.
    """
    df = ts[base] if isinstance(base, str) else base
    looked: Looked | None = None
    for stage in stages:
        (name, spec), *more = stage.items()
        if more:
            raise ValueError("a stage has exactly one operator")
        if name != "$lookup" and name not in _STAGES:
            raise ValueError(f"unknown stage {name}")
        if name == "$lookup":
            df = looked.rows() if looked else df
            looked = Looked(df, ts[spec["from"]], spec["localField"], spec["foreignField"], spec["as"])
        elif looked:
            df, looked = looked.then(name, spec)
        else:
            df = _STAGES[name](df, spec)
    return looked.rows() if looked else df


@dataclass(frozen=True)
class Looked:
    """Left rows whose matches have been asked for but not joined yet.

    What follows decides how: ``$unwind`` makes it a join, ``$size`` a count
    before the join, a ``$match`` on the matches a semi join, and stages that do
    not look at them work on the left rows alone. Results do not depend on how
    many matches a key has. A stage that needs the whole array is an error.
    """

    df: DataFrame
    other: DataFrame
    local: str
    foreign: str
    as_: str
    sorts: tuple[dict, ...] = ()

    @property
    def _args(self) -> tuple[DataFrame, DataFrame, str, str]:
        return self.df, self.other, self.local, self.foreign

    def rows(self, keep_empty: bool = True) -> DataFrame:
        out = lookup_rows(*self._args, self.as_, keep_empty=keep_empty)
        # a join does not keep an order
        return out.orderBy(*_sort_columns(out, self.sorts[-1])) if self.sorts else out

    def then(self, name: str, spec: Any) -> tuple[DataFrame, Looked | None]:
        """The frame and what is still to be joined to it after one more stage."""
        if name == "$unwind":
            path, keep = (spec["path"], spec.get("preserveNullAndEmptyArrays", False)) if isinstance(spec, dict) else (spec, False)
            if path.removeprefix("$") == self.as_:
                return self.rows(keep), None
        if name == "$count" or (name == "$group" and not self._named_in(spec)):
            return _STAGES[name](self.df, spec), None
        if name == "$match":
            return self._match(spec)
        if name in ("$project", "$group"):
            return self._shown(name, spec)
        if self._named_in(spec):
            raise ValueError(f'{name} needs the array "{self.as_}" as a whole: unwind it first')
        after = replace(self, df=_STAGES[name](self.df, spec), sorts=(*self.sorts, spec) if name == "$sort" else self.sorts)
        return after.df, after

    def _named_in(self, spec: Any) -> bool:
        """Whether the array, or what is in it, is named as a key or as a value."""
        if isinstance(spec, dict):
            return any(self._names(k) or self._named_in(v) for k, v in spec.items())
        if isinstance(spec, (list, tuple)):
            return any(map(self._named_in, spec))
        return isinstance(spec, str) and spec.startswith("$") and self._names(spec[1:])

    def _names(self, path: str) -> bool:
        return path == self.as_ or path.startswith(f"{self.as_}.")

    def _match(self, spec: dict) -> tuple[DataFrame, Looked]:
        df = self.df
        for path, condition in spec.items():
            if not self._names(path):
                if self._named_in(condition):
                    raise ValueError(f'conditions on "{self.as_}" cannot be alternatives: unwind it first')
                df = df.where(compile_filter({path: condition}, fields_of(df)))
                continue
            inside = path[len(self.as_) + 1 :]
            if inside and _finds_one(condition):
                df = lookup_matching(df, *self._args[1:], {inside: condition})
            elif not inside and condition in ([], {"$size": 0}, {"$eq": []}):
                df = lookup_matching(df, *self._args[1:], none=True)
            elif not inside and condition == {"$ne": []}:
                df = lookup_matching(df, *self._args[1:])
            else:
                raise ValueError(f'this condition needs the array "{self.as_}" as a whole: unwind it first')
        return df, replace(self, df=df)

    def _shown(self, name: str, spec: dict) -> tuple[DataFrame, Looked | None]:
        """A projection or group that takes at most the number of matches."""
        hidden = {n for n, v in spec.items() if n == self.as_ and v in (0, False) and not isinstance(v, (str, dict))}
        spec = {n: v for n, v in spec.items() if n not in hidden}
        if not self._named_in(spec):
            drops = name == "$project" and all(v in (0, False) and not isinstance(v, (str, dict)) for v in spec.values())
            if drops and not hidden and self.local not in spec:
                after = replace(self, df=project(self.df, spec))
                return after.df, after
            return (project(self.df, spec) if spec else self.df) if name == "$project" else _STAGES[name](self.df, spec), None
        number = f"__n_{self.as_}"
        counted = _swapped(spec, {"$size": f"${self.as_}"}, f"${number}")
        if self._named_in(counted):
            raise ValueError(f'{name} takes "{self.as_}" as its $size only: unwind it first')
        return _STAGES[name](lookup_size(*self._args, number), counted), None


def _finds_one(condition: Any) -> bool:
    """Whether a condition on an array holds when it holds for one element."""
    if not isinstance(condition, dict):
        return condition is not None
    return bool(condition) and all(k in ("$eq", "$gt", "$gte", "$lt", "$lte", "$in", "$regex", "$options") for k in condition) and (
        None not in condition.get("$in", ()) and condition.get("$eq", 0) is not None
        # several bounds may be met by several elements
        and len([k for k in condition if k != "$options"]) == 1
    )


def _swapped(spec: Any, old: Any, new: Any) -> Any:
    if spec == old:
        return new
    if isinstance(spec, dict):
        return {k: _swapped(v, old, new) for k, v in spec.items()}
    return [_swapped(v, old, new) for v in spec] if isinstance(spec, list) else spec


def _unwind_stage(df: DataFrame, spec: Any) -> DataFrame:
    if isinstance(spec, dict):
        return unwind(df, spec["path"], spec.get("preserveNullAndEmptyArrays", False))
    return unwind(df, spec)


def _group_stage(df: DataFrame, spec: dict) -> DataFrame:
    return group(df, spec["_id"], {k: v for k, v in spec.items() if k != "_id"})


_STAGES = {
    "$match": lambda df, spec: df.where(compile_filter(spec, fields_of(df))),
    "$group": _group_stage,
    "$sort": lambda df, spec: df.orderBy(*_sort_columns(df, spec)),
    "$project": project,
    "$unwind": _unwind_stage,
    "$limit": lambda df, spec: df.limit(spec),
    "$skip": lambda df, spec: df.offset(spec),
    "$count": lambda df, spec: df.agg(F.count(F.lit(1)).alias(spec)),
}
