"""A set of named tables with their keys and references."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tablewarden.runtime import list_dir, run_together

NO_ACTION, CASCADE, SET_NULL = "NO ACTION", "CASCADE", "SET NULL"


@dataclass(frozen=True)
class Reference:
    """``child.column`` points at ``parent.parent_column``."""

    child: str
    column: str
    parent: str
    parent_column: str
    on_delete: str = NO_ACTION

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}->{self.parent}.{self.parent_column}"


class _LazyTables(Mapping):
    """Opens a table when it is first asked for, so unused ones cost nothing."""

    def __init__(self, openers: dict[str, Callable[[], DataFrame]]):
        self._openers = openers
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self._openers[name]()
        return self._open[name]

    def __contains__(self, name: object) -> bool:
        return name in self._openers

    def __iter__(self) -> Iterator[str]:
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)


@dataclass(frozen=True)
class TableSet:
    """Named frames plus what is declared about them.

    ``keys`` holds the primary key of a table, ``uniques`` further unique keys,
    ``json_columns`` the string columns that hold JSON text.
    """

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    uniques: dict[str, list[tuple[str, ...]]] = field(default_factory=dict)
    references: list[Reference] = field(default_factory=list)
    json_columns: dict[str, set[str]] = field(default_factory=dict)

    @classmethod
    def from_parquet(
        cls, spark: SparkSession, directory: str, names: list[str] | None = None, **declared
    ) -> TableSet:
        """Every ``<name>.parquet`` file or folder below ``directory``."""
        if names is None:
            names = [
                n.removesuffix(".parquet")
                for n in list_dir(spark, directory)
                if n.endswith(".parquet") and not n.startswith((".", "_"))
            ]

        def opener(name: str) -> Callable[[], DataFrame]:
            return lambda: spark.read.parquet(f"{directory}/{name}.parquet")

        return cls(spark, _LazyTables({n: opener(n) for n in names}), **declared)

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        tables: Mapping[str, Mapping],
        properties: Mapping[str, str] | None = None,
        **declared,
    ) -> TableSet:
        """Tables of a relational database, each read in parallel slices.

        ``tables`` maps a name to ``{"column", "lower", "upper", "partitions"}``;
        without ``partitions`` a slice covers about a million numbers of the
        column. With an empty mapping the table is read in one slice, by one
        task, which is for small tables only.
        """

        def opener(name: str, split: Mapping) -> Callable[[], DataFrame]:
            options = jdbc_options(url, name, split, properties or {})
            return lambda: spark.read.format("jdbc").options(**options).load()

        return cls(spark, _LazyTables({n: opener(n, s) for n, s in tables.items()}), **declared)

    @classmethod
    def of(cls, spark: SparkSession, tables: Mapping[str, DataFrame], **declared) -> TableSet:
        return cls(spark, dict(tables), **declared)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f'table "{name}" does not exist')
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def open(self) -> TableSet:
        """Open all tables side by side; each needs a small job for its schema."""
        run_together(self.spark, [lambda n=n: self.tables[n].schema for n in self.names], at_once=16)
        return self

    @property
    def names(self) -> list[str]:
        return sorted(self.tables)

    def key_of(self, name: str) -> tuple[str, ...]:
        return tuple(self.keys.get(name, ()))

    def unique_keys(self, name: str) -> list[tuple[str, ...]]:
        """The primary key, if declared, followed by the other unique keys."""
        primary = [self.key_of(name)] if self.key_of(name) else []
        return primary + [tuple(k) for k in self.uniques.get(name, [])]

    def is_json(self, name: str, column: str) -> bool:
        return column in self.json_columns.get(name, set())

    def only(self, *names: str) -> TableSet:
        """The same declarations over some of the tables."""
        missing = [n for n in names if n not in self.tables]
        if missing:
            raise KeyError(f'table "{missing[0]}" does not exist')
        if isinstance(self.tables, _LazyTables):
            kept: Mapping = _LazyTables({n: self.tables._openers[n] for n in names})
        else:
            kept = {n: self.tables[n] for n in names}
        return replace(self, tables=kept)

    def with_table(self, name: str, df: DataFrame) -> TableSet:
        return replace(self, tables=_overlay(self.tables, {name: lambda: df}))

    def with_tables(self, frames: Mapping[str, DataFrame]) -> TableSet:
        out = self
        for name, df in frames.items():
            out = out.with_table(name, df)
        return out

    def without(self, name: str) -> TableSet:
        """Drop a table and every declaration that mentions it."""
        self[name]
        openers = _overlay(self.tables, {})._openers
        openers.pop(name)
        return replace(
            self,
            tables=_LazyTables(openers),
            keys={k: v for k, v in self.keys.items() if k != name},
            uniques={k: v for k, v in self.uniques.items() if k != name},
            references=[r for r in self.references if name not in (r.child, r.parent)],
            json_columns={k: v for k, v in self.json_columns.items() if k != name},
        )

    def register_views(self) -> None:
        for name in self.names:
            self[name].createOrReplaceTempView(name)

    def sql(self, text: str, *names: str, **args) -> DataFrame:
        """Run SQL over the tables; name those used to open only them."""
        for name in names or self.names:
            self[name].createOrReplaceTempView(name)
        return self.spark.sql(text, args=args or None)


def _overlay(tables: Mapping, extra: dict[str, Callable[[], DataFrame]]) -> _LazyTables:
    if isinstance(tables, _LazyTables):
        openers = {n: (lambda n=n: tables[n]) for n in tables}
    else:
        openers = {n: (lambda df=df: df) for n, df in tables.items()}
    return _LazyTables(openers | extra)


_NUMBERS_PER_SLICE = 1_000_000


def jdbc_options(url: str, table: str, split: Mapping, properties: Mapping[str, str]) -> dict[str, str]:
    """Reader options of one table; a split column makes the read parallel."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000", **properties}
    if split:
        slices = split.get("partitions")
        if slices is None:
            if not all(isinstance(split[b], (int, float)) for b in ("lower", "upper")):
                raise ValueError(f'table "{table}": say how many partitions to read by a column that is no number')
            slices = max(1, -(-int(split["upper"] - split["lower"]) // _NUMBERS_PER_SLICE))
        options |= {
            "partitionColumn": split["column"],
            "lowerBound": str(split["lower"]),
            "upperBound": str(split["upper"]),
            "numPartitions": str(slices),
        }
    return options
