"""What the operators share: safe column choice, words, grouped batches, running sums."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewarden.runtime import delete_path, scratch_path, write_small_file

#: One word is a run of anything but these six characters; it is also what ``bytes.split()`` splits on.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, so that Python tasks find it wherever they run.

    It goes through the shared folder, once per application.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    file = Path(folder) / name
                    out.write(file, f"{root.name}/{file.relative_to(root)}")
    path = f"{scratch_path(spark, 'package')}/tablewarden_package.zip"
    write_small_file(spark, path, packed.getvalue())
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Some columns by their exact names, whatever other columns are called.

    Spark resolves names without regard to case, so an extra column ``Text``
    makes ``text`` ambiguous; here columns are taken by place. Of several
    columns with one exact name the first counts.
    """
    by_place = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    wanted = {n: n for n in names} | renamed
    return by_place.select(*[F.col(f"c{df.columns.index(old)}").alias(new) for new, old in wanted.items()])


class Placed:
    """A frame whose columns are renamed by place, so that added ones cannot clash."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.columns = self.df.columns

    def place(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def col(self, name: str) -> Column:
        return F.col(self.place(name))

    def restore(self, df: DataFrame, *extra: Column) -> DataFrame:
        """The columns under their own names again; of added ones those asked for.

        An added column whose name a document column has already gets that
        name with a leading underscore.
        """
        taken = {n.lower() for n in self.names}
        out = df.select(*[F.col(c) for c in self.columns], *extra)
        added = []
        for name in out.columns[len(self.names):]:
            while name.lower() in taken:
                name = f"_{name}"
            taken.add(name.lower())
            added.append(name)
        return out.toDF(*self.names, *added)


class Stages:
    """Tables written to the shared folder to cut lineage, which a loop replaces round by round."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, scratch_path(spark, label)
        self.n = 0

    def write(self, df: DataFrame, codec: str = "snappy") -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        delete_path(self.spark, path)


def as_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def word_lists(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``size`` bytes, so that a very long text needs little memory."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        if words := data[at:end].split():
            yield words
        at = end


def complete_groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], values: Sequence[str],
) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Sorted rows as arrays that hold whole groups, with the places where groups begin and end.

    A group may go over batches; only the last, unfinished group is held back.
    """
    names = [*keys, *values]
    held: dict[str, np.ndarray] | None = None

    def edges(block: dict[str, np.ndarray]) -> np.ndarray:
        n = len(block[keys[0]])
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= block[k][1:] != block[k][:-1]
        new[:1] = True
        return np.append(np.flatnonzero(new), n)

    for batch in batches:
        if not batch.num_rows:
            continue
        block = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        if held is not None:
            block = {n: np.concatenate([held[n], block[n]]) for n in names}
        at = edges(block)
        last = at[-2]
        held = {n: block[n][last:] for n in names}
        if last:
            yield {n: block[n][:last] for n in names}, at[:-1]
    if held is not None:
        yield held, edges(held)


def running_sum(
    df: DataFrame, group: Sequence[str], spread: str, order: Sequence[str], value: Column, out: str,
    rows_per_cell: int = 4_000,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that come before in the order.

    The order is ``spread``, a 64-bit hash, then ``order``. A group of any size
    is dealt by the leading bits of the hash into cells of about
    ``rows_per_cell`` rows, which are summed on their own; the sums of cells,
    one row per cell, are added up before. So no task holds a whole group.
    """
    cells = max(1, -(-df.count() // rows_per_cell))
    bits = max(0, (cells - 1).bit_length())
    # the sign bit is turned so that cells follow the order of signed hashes
    cell = F.shiftrightunsigned(F.col(spread).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")
    rows = df.withColumn("__cell", cell).withColumn("__value", value)
    sums = rows.groupBy(*group, "__cell").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    keys = [*group, "__cell"]
    own = Window.partitionBy(*keys).orderBy(spread, *order).rowsBetween(Window.unboundedPreceding, -1)
    left, right = rows.alias("l"), sums.alias("r")
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = left.join(right, match).select("l.*", "r.__before")
    return joined.withColumn(out, F.col("__before") + F.coalesce(F.sum("__value").over(own), F.lit(0))).drop(
        "__cell", "__value", "__before"
    )
