"""Whole document commands, as dicts or JSON text.

Two forms are understood: ``{"find": "users", "filter": ..}`` and its relatives
aggregate, count, insert, update and delete; and
``{"collection": "users", "type": "find", "query": .., "options": ..}``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tablewarden.operators.change import delete, insert, update
from tablewarden.operators.documents import find, pipeline
from tablewarden.operators.predicates import compile_filter, fields_of
from tablewarden.operators.profile import count
from tablewarden.operators.search import is_collection
from tablewarden.sources.tables import TableSet


@dataclass(frozen=True)
class Answer:
    """Rows of a query, or one row ``n`` of a change, and the tables after it."""

    rows: DataFrame
    tables: TableSet


def run_command(ts: TableSet, command: dict[str, Any] | str) -> Answer:
    if isinstance(command, str):
        command = json.loads(command)
    if "collection" in command:
        command = _as_command(command)
    name = next((n for n in _COMMANDS if n in command), None)
    if name is None:
        raise ValueError(f"unknown command {', '.join(command)}")
    run, known = _COMMANDS[name]
    _only(command, {name, *known, *_TRANSPORT}, name)
    return run(ts, command[name], command)


#: How an answer is delivered, not what it is.
_TRANSPORT = {"cursor", "batchSize", "comment", "ordered"}


def _only(given: dict[str, Any], known: set[str], what: str) -> None:
    """Refuse what is not understood: an option that is passed over gives wrong answers."""
    if unknown := sorted(set(given) - known):
        raise ValueError(f"{what} does not understand {', '.join(unknown)}")


def _as_command(wrapped: dict[str, Any]) -> dict[str, Any]:
    """The wrapper form as a command; its options are honoured."""
    table, kind = wrapped["collection"], wrapped.get("type", "find").lower()
    query, options = wrapped.get("query", {}), wrapped.get("options") or {}
    _only(wrapped, {"collection", "type", "query", "options"}, kind)
    if kind == "find":
        return {"find": table, "filter": query, **options}
    if kind == "count":
        return {"count": table, "query": query, **options}
    if kind == "aggregate":
        return {"aggregate": table, "pipeline": query, **options}
    if kind == "update":
        if "update" not in options:
            raise ValueError("an update needs the changes in options.update")
        _only(options, {"update", "updateMany", "upsert"}, kind)
        one = {"q": query, "u": options["update"], "multi": bool(options.get("updateMany")), "upsert": bool(options.get("upsert"))}
        return {"update": table, "updates": [one]}
    if kind == "delete":
        _only(options, {"deleteMany"}, kind)
        return {"delete": table, "deletes": [{"q": query, "limit": 0 if options.get("deleteMany") else 1}]}
    raise ValueError(f"unknown query type {kind}")


def _find(ts: TableSet, table: str, c: dict) -> Answer:
    rows = find(ts[table], c.get("filter"), c.get("projection"), c.get("sort"), c.get("limit") or None, c.get("skip") or 0)
    return Answer(rows, ts)


def _count(ts: TableSet, table: str, c: dict) -> Answer:
    counted = count(ts[table], c.get("query") or {}).withColumnRenamed("rows", "n")
    if skip := c.get("skip"):
        counted = counted.select(F.greatest(F.col("n") - skip, F.lit(0).cast("bigint")).alias("n"))
    if limit := c.get("limit"):
        counted = counted.select(F.least("n", F.lit(limit).cast("bigint")).alias("n"))
    return Answer(counted, ts)


def _aggregate(ts: TableSet, table: str, c: dict) -> Answer:
    return Answer(pipeline(ts, table, c["pipeline"]), ts)


def _insert(ts: TableSet, table: str, c: dict) -> Answer:
    target = ts[table]
    rows = _documents(target, c["documents"])
    return Answer(rows.agg(F.count(F.lit(1)).alias("n")), ts.with_table(table, insert(target, rows)))


def _documents(target: DataFrame, documents: list[dict]) -> DataFrame:
    """Given documents as rows of a table, or as schema-less ones."""
    texts = target.sparkSession.createDataFrame([(json.dumps(d),) for d in documents], "text string")
    if is_collection(target):
        return texts.select(F.parse_json("text").alias("doc"))
    return texts.select(F.from_json("text", target.schema).alias("r")).select("r.*")


def _upserted(query: dict, changes: dict[str, dict]) -> dict:
    """The document an upsert adds: the values the query asks for, then the changes."""
    fixed = {p: v for p, v in query.items() if not p.startswith("$") and not isinstance(v, (dict, list))}
    fixed |= {p: v["$eq"] for p, v in query.items() if isinstance(v, dict) and set(v) == {"$eq"}}
    out: dict[str, Any] = {}
    for path, value in (fixed | changes.get("$set", {})).items():
        *parents, last = path.split(".")
        at = out
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def _affected(df: DataFrame, query: dict, many: bool) -> DataFrame:
    matches = df.where(compile_filter(query, fields_of(df)))
    n = F.count(F.lit(1))
    return matches.agg((n if many else F.least(n, F.lit(1).cast("bigint"))).alias("n"))


def _total(counts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("n"))


def _update(ts: TableSet, table: str, c: dict) -> Answer:
    df, counts = ts[table], []
    for u in c["updates"]:
        _only(u, {"q", "u", "multi", "upsert"}, "update")
        many = bool(u.get("multi"))
        hit = _affected(df, u["q"], many)
        after = update(df, u["q"], u["u"], multi=many, key=ts.key_of(table))
        if u.get("upsert"):
            # one row is added where none is hit, and counts as one
            fresh = _documents(df, [_upserted(u["q"], u["u"])]).where(hit.select(F.col("n") == 0).scalar())
            after = insert(after, fresh)
            hit = hit.select(F.greatest("n", F.lit(1).cast("bigint")).alias("n"))
        counts.append(hit)
        df = after
    return Answer(_total(counts), ts.with_table(table, df))


def _delete(ts: TableSet, table: str, c: dict) -> Answer:
    df, counts = ts[table], []
    for d in c["deletes"]:
        _only(d, {"q", "limit"}, "delete")
        many = not d.get("limit")
        counts.append(_affected(df, d["q"], many))
        df = delete(df, d["q"], many=many, key=ts.key_of(table))
    return Answer(_total(counts), ts.with_table(table, df))


#: Each command with the options it understands.
_COMMANDS = {
    "find": (_find, {"filter", "projection", "sort", "limit", "skip"}), "count": (_count, {"query", "limit", "skip"}),
    "aggregate": (_aggregate, {"pipeline"}), "insert": (_insert, {"documents"}),
    "update": (_update, {"updates"}), "delete": (_delete, {"deletes"}),
}
