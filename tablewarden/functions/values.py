"""Type tags, numeric tests and text-to-value conversion."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, functions as F, types as T

# When a field was seen with several types, the first of these
# that occurs is reported as its common type.
TYPE_PREFERENCE = ["objectId", "string", "number", "boolean", "date", "array", "object", "null"]

# Leading word of a VARIANT shape -> type tag.
_SHAPE_TAGS = {
    "VOID": "null",
    "ARRAY": "array",
    "OBJECT": "object",
    "STRUCT": "object",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "date",
    "TIMESTAMP_NTZ": "date",
    "BINARY": "binary",
}

# Document type name -> Spark type name.
DOCUMENT_TYPES = {
    "number": "double",
    "int": "double",
    "integer": "double",
    "float": "double",
    "double": "double",
    "boolean": "boolean",
    "date": "timestamp",
    "array": "variant",
    "object": "variant",
}


def type_tag(value: Column) -> Column:
    """null, array, date, binary, boolean, number, string or object for a VARIANT.

    A missing value (SQL NULL) has no tag. The lookup evaluates the shape once
    per value; every shape not listed is some width of number.
    """
    head = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z_]+", 0)
    tags = F.create_map(*[F.lit(x) for pair in _SHAPE_TAGS.items() for x in pair])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(tags, head), F.lit("number")))


def common_type(tags: Column) -> Column:
    """One type for an array of distinct tags, by the fixed preference."""
    preferred = F.coalesce(
        *[F.when(F.array_contains(tags, t), F.lit(t)) for t in TYPE_PREFERENCE], F.lit("mixed")
    )
    return F.when(F.size(tags) == 1, F.element_at(tags, 1)).otherwise(preferred)


def is_numeric(text: Column) -> Column:
    """True for text that reads as a finite number."""
    cast = text.try_cast("double")
    return cast.isNotNull() & ~F.isnan(cast) & (F.abs(cast) != float("inf"))


def as_number(text: str) -> Decimal | None:
    """The exact number a search value stands for, or None."""
    try:
        value = Decimal(text.strip())
    except InvalidOperation:
        return None
    if not value.is_finite() or "_" in text or math.isinf(float(value)):
        return None
    return value


def parse_text(text: Column, type_name: str) -> Column:
    """Text to a typed value: bad arrays become ``[]``, bad objects ``{}``."""
    kind = type_name.lower()
    if kind in ("array", "object"):
        empty = "[]" if kind == "array" else "{}"
        return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit(empty)))
    if kind == "boolean":
        return F.lower(text) == "true"
    return text.try_cast(DOCUMENT_TYPES.get(kind, "string"))


def empty_value(type_name: str, now: datetime) -> Column:
    """What a required field holds when no default is given."""
    kind = type_name.lower()
    spark_type = DOCUMENT_TYPES.get(kind, "string")
    if spark_type == "double":
        return F.lit(0.0)
    if kind == "boolean":
        return F.lit(False)
    if kind == "date":
        return F.lit(now).cast("timestamp")
    if kind in ("array", "object"):
        return F.parse_json(F.lit("[]" if kind == "array" else "{}"))
    return F.lit("")


def moment(at: datetime, dtype: T.DataType) -> Column:
    """A point in time as a literal of a column's type.

    A wall-clock column is compared by its wall clock, whatever time zone the
    session has.
    """
    if isinstance(dtype, T.TimestampType):
        return F.lit(at)
    return F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz").cast(dtype)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(part * 100.0 / whole, digits)
