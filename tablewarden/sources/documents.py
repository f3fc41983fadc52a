"""Readers of document collections and seed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewarden.runtime import first_character


def read_documents(spark: SparkSession, path: str, keep_text: bool = False) -> DataFrame:
    """One JSON document per line as a VARIANT column ``doc``.

    VARIANT keeps the difference between a null and a missing field, which a
    fixed struct loses. Lines that are not JSON give a NULL document.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    doc = F.try_parse_json("value").alias("doc")
    return lines.select(doc, "value") if keep_text else lines.select(doc)


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A seed file: one JSON array of objects. Any other content is an error.

    The reader streams the elements of an array but would also take a lone
    object, so the first character is looked at beforehand.
    """
    if first_character(spark, path) != "[":
        raise ValueError("a seed must be a JSON array of objects")
    return (
        spark.read.schema(schema)
        .options(multiLine=True, mode="FAILFAST")
        .json(path)
    )


def read_seed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A seed of any size: a file or folder with one JSON object a line, read in as many tasks as its size asks for."""
    return spark.read.schema(schema).options(mode="FAILFAST").json(path)


def write_seed_lines(df: DataFrame, path: str) -> None:
    """Rows as a seed that :func:`read_seed_lines` reads, in as many files as the frame has partitions."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
