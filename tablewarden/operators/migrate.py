"""Versioned publishing and run-once migrations.

A version is one small commit file that names the path of every table. Changed
tables are written under new paths first; creating the commit file, which
must not exist yet, makes them all visible at once.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.runtime import list_dir, read_small_file, run_together, write_small_file
from tablewarden.sources.tables import TableSet

LEDGER = "applied_migrations"
_LEDGER_SCHEMA = "name string, applied_at timestamp, sql_content string"


class VersionedStore:
    """Tables below a folder, published version by version."""

    def __init__(self, spark: SparkSession, root: str, **declared):
        self.spark, self.root, self.declared = spark, root.rstrip("/"), declared

    def versions(self) -> list[int]:
        names = list_dir(self.spark, f"{self.root}/commits")
        return [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]

    def _paths(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        if version is not None:
            return version, self._tables_of(version) if version else {}
        # a commit that does not parse never took place
        for known in sorted(self.versions(), reverse=True):
            if not self._is_broken(known):
                return known, self._tables_of(known)
            warnings.warn(f"commit {known} is broken and passed over", stacklevel=3)
        return 0, {}

    def _is_broken(self, version: int) -> bool:
        try:
            self._tables_of(version)
        except ValueError:
            return True
        return False

    def _tables_of(self, version: int) -> dict[str, str]:
        text = read_small_file(self.spark, f"{self.root}/commits/{version:012d}.json")
        return json.loads(text)["tables"]

    def open(self, version: int | None = None) -> TableSet:
        """The tables of a version, by default the newest."""
        _, paths = self._paths(version)
        return TableSet.of(
            self.spark, {n: self.spark.read.parquet(p) for n, p in paths.items()}, **self.declared
        )

    def publish(self, changed: dict[str, DataFrame], dropped: tuple[str, ...] = (), base: int | None = None) -> int:
        """Write the changed tables and make them the next version.

        Unchanged tables keep their files. If another writer published on the
        same base first, creating the commit file fails and nothing is changed.
        """
        version, paths = self._paths(base)
        # a broken commit keeps its number
        known, last = set(self.versions()), version
        while last + 1 in known and self._is_broken(last + 1):
            last += 1
        paths = {n: p for n, p in paths.items() if n not in dropped}
        fresh = {n: f"{self.root}/data/{n}-{uuid.uuid4().hex}" for n in changed}
        run_together(self.spark, [lambda n=n: changed[n].write.parquet(fresh[n]) for n in changed])
        commit = json.dumps({"tables": paths | fresh}, indent=1).encode()
        write_small_file(self.spark, f"{self.root}/commits/{last + 1:012d}.json", commit)
        return last + 1


@dataclass(frozen=True)
class Migration:
    """A named change: statements ``(table, SELECT that gives its new content)``
    run in order, each seeing the ones before, or a function of the tables."""

    name: str
    statements: tuple[tuple[str, str], ...] = ()
    change: Callable[[TableSet], dict[str, DataFrame]] | None = None

    @property
    def content(self) -> str:
        return ";\n".join(f"{t} := {q}" for t, q in self.statements) or f"python: {self.change.__qualname__}"


def ledger(ts: TableSet) -> DataFrame:
    """What was applied, oldest first."""
    if LEDGER not in ts:
        return ts.spark.createDataFrame([], _LEDGER_SCHEMA)
    return ts[LEDGER].orderBy("applied_at", "name")


def is_applied(ts: TableSet, name: str) -> bool:
    return not ledger(ts).where(F.col("name") == name).isEmpty()


def pending(ts: TableSet, steps: list[Migration]) -> list[Migration]:
    """Steps that were not applied yet, in name order."""
    names = [s.name for s in steps]
    # never more rows than there are steps
    applied = {r["name"] for r in ledger(ts).where(F.col("name").isin(names)).select("name").collect()}
    return sorted((s for s in steps if s.name not in applied), key=lambda s: s.name)


def apply_migrations(store: VersionedStore, steps: list[Migration], now: datetime) -> list[str]:
    """Run what is pending and publish it together with its ledger entries.

    Everything becomes visible in one version; a failing step leaves the store
    as it was.
    """
    base, _ = store._paths()
    ts = store.open(base)
    todo = pending(ts, steps)
    if not todo:
        return []
    changed: dict[str, DataFrame] = {}
    for step in todo:
        for table, query in step.statements:
            changed[table] = ts.sql(query)
            ts = ts.with_table(table, changed[table])
        for table, df in (step.change(ts) if step.change else {}).items():
            changed[table] = df
            ts = ts.with_table(table, df)
    entries = store.spark.createDataFrame([(s.name, now, s.content) for s in todo], _LEDGER_SCHEMA)
    changed[LEDGER] = ledger(ts).unionByName(entries).coalesce(1)
    store.publish(changed, base=base)
    return [s.name for s in todo]
