"""Row digests and short stand-ins for long values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

_SHORT = 64


def is_comparable(dtype: T.DataType) -> bool:
    """Whether Spark can group and order by values of a type."""
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return is_comparable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(is_comparable(f.dataType) for f in dtype.fields)
    return True


def comparable(field: T.StructField) -> Column:
    """A column as something to group, order and hash by; maps and VARIANT as JSON text."""
    col = F.col(f"`{field.name}`")
    return col if is_comparable(field.dataType) else F.to_json(F.struct(col))


def whole_row(fields: list[T.StructField]) -> Column:
    """All columns as one comparable value."""
    return F.struct(*[comparable(f).alias(f.name) for f in fields])


def row_digest(fields: list[T.StructField]) -> Column:
    """A 64-bit digest of some columns of a row.

    The built-in hash skips NULLs, so ``(NULL, 1)`` and ``(1, NULL)`` would be
    equal; a text of null marks is hashed along with the values.
    """
    marks = F.concat(*[F.when(F.col(f"`{f.name}`").isNull(), "1").otherwise("0") for f in fields])
    return F.xxhash64(marks, *[comparable(f) for f in fields])


def value_key(text: Column) -> Column:
    """A text that is equal for equal values and never long.

    Shuffling on it keeps exact distinct counts cheap for columns of whole
    documents: longer values are represented by their SHA-256.
    """
    return F.when(F.length(text) <= _SHORT, F.concat(F.lit("="), text)).otherwise(F.sha2(text, 256))
