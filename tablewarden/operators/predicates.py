"""Filter documents compiled to Columns.

A compiled predicate may be NULL where a comparison meets NULL; a filter treats
that as false, and negations go through :func:`negate`. Keeping the raw
comparison lets Catalyst push it down to the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewarden.functions.jsontext import variant_path
from tablewarden.functions.values import type_tag


_KINDS = {"boolean": "boolean", "number": "double", "string": "string"}


def _kind_of(sample: Any) -> str:
    if isinstance(sample, bool):
        return "boolean"
    return "number" if isinstance(sample, (int, float)) else "string"


class Fields:
    """How a dotted field name of a frame becomes a Column.

    A name is first looked for among the columns, nested ones too. What is
    inside a VARIANT column, or not a column of a frame that has schema-less
    documents in ``doc``, is looked for there.
    """

    def __init__(self, df: DataFrame):
        self.schema = df.schema
        names = {f.name: f.dataType for f in df.schema.fields}
        self.loose = isinstance(names.get("doc"), T.VariantType)

    def _typed(self, path: str) -> tuple[T.DataType | None, list[str]]:
        """The type a path leads to and what of the path lies inside a VARIANT.

        A step through an array gives an array.
        """
        parts = path.split(".")
        here: T.DataType = self.schema
        in_array = False
        for i, part in enumerate(parts):
            if isinstance(here, T.VariantType):
                return here, parts[i:]
            if isinstance(here, T.ArrayType):
                here, in_array = here.elementType, True
            if not isinstance(here, T.StructType) or part not in here.names:
                return None, []
            here = here[part].dataType
        return (T.ArrayType(here) if in_array else here), []

    def data_type(self, path: str) -> T.DataType | None:
        """The type of a field; VARIANT for one of a schema-less document."""
        found, _ = self._typed(path)
        return T.VariantType() if found is None and self.loose else found

    def is_variant(self, path: str) -> bool:
        return isinstance(self.data_type(path), T.VariantType)

    def _inside(self, path: str, as_type: str) -> Column:
        """A value inside a VARIANT column as some type."""
        found, rest = self._typed(path)
        parts = path.split(".")
        if found is None:
            base, rest = F.col("doc"), parts
        else:
            base = F.col(".".join(f"`{p}`" for p in parts[: len(parts) - len(rest)]))
        return F.try_variant_get(base, variant_path(rest), as_type)

    def value(self, path: str) -> Column | None:
        """The field, or None when the frame cannot have it."""
        if self.is_variant(path):
            return self._inside(path, "variant")
        if self.data_type(path) is None:
            return None
        return F.col(".".join(f"`{p}`" for p in path.split(".")))

    def present(self, path: str) -> Column:
        col = self.value(path)
        return F.lit(False) if col is None else col.isNotNull()

    def is_null(self, path: str) -> Column:
        """A null value and a missing field alike."""
        col = self.value(path)
        if col is None:
            return F.lit(True)
        return col.isNull() | F.is_variant_null(col) if self.is_variant(path) else col.isNull()

    def holds(self, path: str, like: Any, test: Callable[[Column], Column]) -> Column:
        """The test on the value; an array passes when one of its elements does.

        In schema-less documents only values of the same kind compare.
        """
        col = self.value(path)
        if col is None:
            return F.lit(False)
        if not self.is_variant(path):
            if isinstance(self.data_type(path), T.ArrayType) and not isinstance(like, list):
                return F.exists(col, test)
            return test(col)
        kind = _kind_of(like)
        single = (type_tag(col) == kind) & test(self._inside(path, _KINDS[kind]))
        among = F.exists(
            self._inside(path, "array<variant>"),
            lambda e: (type_tag(e) == kind) & test(F.try_variant_get(e, "$", _KINDS[kind])),
        )
        return F.coalesce(single, F.lit(False)) | F.coalesce(among, F.lit(False))


def fields_of(df: DataFrame) -> Fields:
    return Fields(df)


def negate(predicate: Column) -> Column:
    """Rows for which the predicate is not true, NULL counting as not true."""
    return ~F.coalesce(predicate, F.lit(False))


def compile_filter(query: dict, fields: Fields) -> Column:
    """A filter document as one predicate; all its members must hold."""
    parts = [_member(name, wanted, fields) for name, wanted in query.items()]
    return reduce(and_, parts) if parts else F.lit(True)


def _member(name: str, wanted: Any, fields: Fields) -> Column:
    if name in ("$and", "$or", "$nor"):
        each = [compile_filter(q, fields) for q in wanted]
        if name == "$and":
            return reduce(and_, each)
        either = reduce(or_, each)
        return either if name == "$or" else negate(either)
    if name.startswith("$"):
        raise ValueError(f"unknown operator {name}")
    if isinstance(wanted, dict) and any(k.startswith("$") for k in wanted):
        tests = [
            _test(name, op, arg, wanted, fields) for op, arg in wanted.items() if op != "$options"
        ]
        return reduce(and_, tests)
    return _equals(name, wanted, fields)


def _equals(name: str, wanted: Any, fields: Fields) -> Column:
    if wanted is None:
        return fields.is_null(name)
    return fields.holds(name, wanted, lambda col: col == F.lit(wanted))


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
}


def _test(name: str, op: str, arg: Any, whole: dict, fields: Fields) -> Column:
    if op == "$exists":
        present = fields.present(name)
        return present if arg else negate(present)
    if op == "$not":
        return negate(_member(name, arg, fields))
    if op == "$eq":
        return _equals(name, arg, fields)
    if op == "$ne":
        return negate(_equals(name, arg, fields))
    if op == "$in":
        return reduce(or_, [_equals(name, v, fields) for v in arg], F.lit(False))
    if op == "$nin":
        return negate(_test(name, "$in", arg, whole, fields))
    if op == "$regex":
        pattern = ("(?iu)" if "i" in whole.get("$options", "") else "") + arg
        return fields.holds(name, "", lambda col: col.cast("string").rlike(pattern))
    if op in _COMPARE:
        return fields.holds(name, arg, lambda col: _COMPARE[op](col, F.lit(arg)))
    raise ValueError(f"unknown operator {op}")
