"""Changes as frame-to-frame functions: columns, fields, rows, cascades.

Nothing here writes. A changed :class:`TableSet` can be compared with the one
it came from (``compare.rehearse``) and is published as a new version
(``migrate.VersionedStore``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import replace
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from tablewarden.functions.digests import row_digest, whole_row
from tablewarden.functions.jsontext import variant_path
from tablewarden.functions.values import empty_value, moment, parse_text
from tablewarden.operators.integrity import ExpectedColumn, dependents
from tablewarden.operators.predicates import compile_filter, fields_of, negate
from tablewarden.operators.search import is_collection
from tablewarden.runtime import cut_lineage, scratch_path
from tablewarden.sources.sinks import copy_table
from tablewarden.sources.tables import CASCADE, SET_NULL, Reference, TableSet


# ---- columns -----------------------------------------------------------------


def sql_type(declared: str) -> str:
    """The Spark type of a declared type such as ``VARCHAR(255)`` or ``DECIMAL(10,2)``."""
    column = ExpectedColumn("c", declared)
    if column.spark_type == "decimal":
        precision = declared.partition("(")[2].partition(")")[0]
        return f"decimal({precision})" if precision else "decimal(38,10)"
    return "array<string>" if column.spark_type == "array" else column.spark_type


def add_column(
    df: DataFrame, name: str, type_name: str, default: Any = None, not_null: bool = False
) -> DataFrame:
    """A new column holding the default; refused when the name is taken.

    A required column needs a default unless the table is empty.
    """
    if name in df.columns:
        raise ValueError(f'column "{name}" already exists')
    if not_null and default is None and not df.isEmpty():
        raise ValueError(f'column "{name}" is NOT NULL and has no default, but there are rows')
    return df.withColumn(name, F.lit(default).cast(sql_type(type_name)))


def drop_column(ts: TableSet, table: str, column: str, cascade: bool = False) -> TableSet:
    """Drop a column; key columns are refused, referenced ones need ``cascade``."""
    df = ts[table]
    if column not in df.columns:
        raise KeyError(f'column "{column}" does not exist in table "{table}"')
    if column in ts.key_of(table):
        raise ValueError(f'column "{column}" is part of the primary key')
    pointing = [r for r in ts.references if (r.parent, r.parent_column) == (table, column)]
    if pointing and not cascade:
        raise ValueError(f'column "{column}" is referenced by {", ".join(r.name for r in pointing)}')
    lost = pointing + [r for r in ts.references if (r.child, r.column) == (table, column)]
    out = ts.with_table(table, df.drop(column))
    return replace(
        out,
        references=[r for r in ts.references if r not in lost],
        uniques=ts.uniques | {table: [k for k in ts.uniques.get(table, []) if column not in k]},
    )


def rename_column(ts: TableSet, table: str, old: str, new: str) -> TableSet:
    """Rename a column here and in every declaration; the new name must be free."""
    df = ts[table]
    if old not in df.columns:
        raise KeyError(f'column "{old}" does not exist in table "{table}"')
    if new in df.columns:
        raise ValueError(f'column "{new}" already exists')

    def named(key: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(new if k == old else k for k in key)

    def moved(r: Reference) -> Reference:
        if (r.child, r.column) == (table, old):
            r = replace(r, column=new)
        return replace(r, parent_column=new) if (r.parent, r.parent_column) == (table, old) else r

    keys = ts.keys | ({table: named(ts.key_of(table))} if table in ts.keys else {})
    uniques = ts.uniques | ({table: [named(k) for k in ts.uniques[table]]} if table in ts.uniques else {})
    out = ts.with_table(table, df.withColumnRenamed(old, new))
    return replace(out, keys=keys, uniques=uniques, references=[moved(r) for r in ts.references])


# ---- document fields ---------------------------------------------------------


def _members(doc: Column) -> Column:
    return F.try_variant_get(doc, "$", "map<string,variant>")


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is computed once, however often it appears.

    Edits are nested in one another, and a filter on the result is pushed below
    them: without a name each edit would multiply the work of those before it.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_member(doc: Column, path: list[str], value: Callable[[Column], Column] | None) -> Column:
    """A document with the field at a path set, or taken out when value is None.

    ``value`` is given the document. Other fields stay; a step that is not an
    object is left as it is when taking out and becomes an object when setting.
    """

    def edit(here: Column, rest: list[str], whole: Column) -> Column:
        head, *below = rest

        def rebuilt(members: Column) -> Column:
            others = F.map_filter(members, lambda k, _: k != head)
            if value is None and not below:
                return F.when(members.isNull(), here).otherwise(F.to_variant_object(others))
            inner = edit(F.try_variant_get(here, f"$['{head}']", "variant"), below, whole) if below else None
            if value is None:
                changed = F.when(F.map_contains_key(members, head), F.create_map(F.lit(head), inner))
                new = F.map_concat(others, F.coalesce(changed, _no_members()))
                return F.when(members.isNull(), here).otherwise(F.to_variant_object(new))
            new = inner if below else value(whole).cast("variant")
            return F.to_variant_object(F.map_concat(F.coalesce(others, _no_members()), F.create_map(F.lit(head), new)))

        return _named(_members(here), rebuilt)

    return _named(doc, lambda d: edit(d, path, d))


def _no_members() -> Column:
    return F.create_map().cast("map<string,variant>")


def set_field(df: DataFrame, path: str, value: Column, where: Column | None = None) -> DataFrame:
    """Set a field, nested ones too, in the rows that meet the condition."""
    parts = path.split(".")
    if is_collection(df):
        new = _with_member(F.col("doc"), parts, lambda _: value)
        return df.withColumn("doc", F.when(where, new).otherwise(F.col("doc")) if where is not None else new)
    root = F.col(f"`{parts[0]}`")
    new = value if len(parts) == 1 else root.withField(".".join(parts[1:]), value)
    if where is not None:
        old = root if parts[0] in df.columns else F.lit(None)
        new = F.when(where, new).otherwise(old)
    return df.withColumn(parts[0], new)


def add_field(
    df: DataFrame, name: str, type_name: str, default: str | None = None,
    required: bool = False, *, now: datetime,
) -> DataFrame:
    """A field for every document: the default, else the empty value of its type
    when it is required, else null. Refused when a document has it already."""
    if not df.where(fields_of(df).present(name)).isEmpty():
        raise ValueError(f'field "{name}" already exists')
    if default is not None:
        value = parse_text(F.lit(default), type_name)
    elif required:
        value = empty_value(type_name, now)
    else:
        value = F.parse_json(F.lit("null")) if is_collection(df) else F.lit(None).cast("string")
    return set_field(df, name, value)


def field_count(df: DataFrame, path: str) -> DataFrame:
    """How many documents hold a field: one row ``documents``."""
    return df.agg(F.count(F.when(fields_of(df).present(path), 1)).alias("documents"))


def remove_field(df: DataFrame, path: str, where: Column | None = None) -> DataFrame:
    """Take a field out of the documents; ``_id`` is refused."""
    if path == "_id":
        raise ValueError("_id cannot be removed")
    parts = path.split(".")
    if is_collection(df):
        new = _with_member(F.col("doc"), parts, None)
        return df.withColumn("doc", F.when(where, new).otherwise(F.col("doc")) if where is not None else new)
    if fields_of(df).data_type(path) is None:
        raise KeyError(f'field "{path}" does not exist')
    if where is not None:
        # a typed frame keeps its columns: the field is null where it is gone
        kind = fields_of(df).data_type(path)
        return set_field(df, path, F.lit(None).cast(kind), where)
    if len(parts) == 1:
        return df.drop(parts[0])
    return df.withColumn(parts[0], F.col(f"`{parts[0]}`").dropFields(".".join(parts[1:])))


def rename_field(df: DataFrame, old: str, new: str, where: Column | None = None) -> DataFrame:
    """Rename a field where it is present; no document may have the new name."""
    fields = fields_of(df)
    if not df.where(fields.present(new)).isEmpty():
        raise ValueError(f'field "{new}" already exists in some documents')
    held = fields.present(old) if where is None else fields.present(old) & where
    if is_collection(df):
        at = variant_path(old.split("."))
        moved = _with_member(F.col("doc"), new.split("."), lambda d: F.try_variant_get(d, at, "variant"))
        gone = _with_member(moved, old.split("."), None)
        return df.withColumn("doc", F.when(held, gone).otherwise(F.col("doc")))
    if where is None and "." not in old + new:
        return df.withColumnRenamed(old, new)
    return remove_field(set_field(df, new, fields.value(old), held), old, where)


class DocumentEdits:
    """Several edits of schema-less documents: one check for all, each document rebuilt once.

    Edits take effect in the order in which they are added. ``add`` and
    ``rename`` are refused when a document has the new name already; that is
    looked at in one pass over the documents when the edits are applied.
    """

    def __init__(self, now: datetime):
        self.now = now
        self._members = F.col("__members")
        # top-level name -> (value, whether the document has it), as far as edits say
        self._fields: dict[str, tuple[Column, Column]] = {}
        self._checks: dict[str, Column] = {}

    def _field(self, name: str) -> tuple[Column, Column]:
        if name not in self._fields:
            here = F.coalesce(F.map_contains_key(self._members, name), F.lit(False))
            return F.try_variant_get("doc", f"$['{name}']", "variant"), here
        return self._fields[name]

    def _free(self, name: str) -> None:
        value, present = self._field(name)
        self._checks[name] = self._checks.get(name, F.lit(False)) | present

    def add(self, name: str, type_name: str, default: str | None = None, required: bool = False) -> DocumentEdits:
        """As :func:`add_field`."""
        self._free(name)
        if default is not None:
            value = parse_text(F.lit(default), type_name)
        else:
            value = empty_value(type_name, self.now) if required else F.parse_json(F.lit("null"))
        return self.set(name, value)

    def set(self, path: str, value: Column) -> DocumentEdits:
        name, *below = path.split(".")
        new = value.cast("variant")
        if below:
            old, present = self._field(name)
            new = _with_member(F.when(present, old), below, lambda _: value)
        self._fields[name] = new, F.lit(True)
        return self

    def remove(self, path: str) -> DocumentEdits:
        if path == "_id":
            raise ValueError("_id cannot be removed")
        name, *below = path.split(".")
        old, present = self._field(name)
        self._fields[name] = (_with_member(old, below, None), present) if below else (old, F.lit(False))
        return self

    def rename(self, old: str, new: str) -> DocumentEdits:
        """A top-level field under another name, where it is present."""
        self._free(new)
        value, present = self._field(old)
        self._fields[old], self._fields[new] = (value, F.lit(False)), (value, present)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """The frame with the edits; raises if a new name was taken."""
        parsed = df.withColumn("__members", _members(F.col("doc")))
        if self._checks:
            taken = parsed.agg(*[F.max(c).alias(f"c{i}") for i, c in enumerate(self._checks.values())]).first()
            if names := [n for n, hit in zip(self._checks, taken or [], strict=False) if hit]:
                raise ValueError(f"fields that some documents have already: {', '.join(names)}")
        rest = F.map_filter(F.coalesce("__members", _no_members()), lambda k, _: ~k.isin(*self._fields))
        parts = [F.when(present, F.create_map(F.lit(n), value)).otherwise(_no_members()) for n, (value, present) in self._fields.items()]
        rebuilt = F.to_variant_object(F.map_concat(rest, *parts))
        # what is no object becomes one only when a field is set in it
        gained = reduce(lambda a, b: a | b, [present for _, present in self._fields.values()], F.lit(False))
        new = F.when(F.col("__members").isNotNull() | gained, rebuilt).otherwise(F.col("doc"))
        return parsed.withColumn("doc", new).drop("__members") if self._fields else df


# ---- rows --------------------------------------------------------------------


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows; fields either side lacks are null."""
    return df.unionByName(rows, allowMissingColumns=True)


def _marked(df: DataFrame, matches: Column, many: bool, key: tuple[str, ...]) -> DataFrame:
    """The rows with ``__matches``: all that match, or exactly one of them.

    The one comes first by key and then by a digest of the row. Of exact copies
    of it one is marked: they are counted and dealt out again, which only that
    one group of copies goes through. Schema-less documents are known by their
    ``_id``, and then by their content.
    """
    matches = F.coalesce(matches, F.lit(False))
    if many:
        return df.withColumn("__matches", matches)
    if not key and not is_collection(df):
        raise ValueError("changing one row needs a key to choose it by")
    content = F.to_json("doc") if is_collection(df) else row_digest(df.schema.fields)
    own = [F.col(f"`{k}`") for k in key] or [F.try_variant_get("doc", "$._id", "string")]
    here = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(own)], content.alias("content"))
    first = df.where(matches).agg(F.min(here)).scalar()
    marked = df.withColumn("__matches", F.coalesce(matches & (here == first), F.lit(False)))
    copies = marked.where("__matches").agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
    dealt = copies.where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("i"))
    return marked.where("NOT __matches").unionByName(dealt.select("row.*", (F.col("i") == 1).alias("__matches")))


def update(
    df: DataFrame, query: dict, changes: dict[str, dict], multi: bool = False,
    key: tuple[str, ...] = (),
) -> DataFrame:
    """``$set``, ``$unset`` and ``$rename`` on the matches: all, or exactly one, the first by key."""
    # the condition is fixed before any of the columns it reads changes
    out = _marked(df, compile_filter(query, fields_of(df)), multi, key)
    for op, args in changes.items():
        if op not in ("$set", "$unset", "$rename"):
            raise ValueError(f"unknown update {op}")
        for path, arg in args.items():
            at = F.col("__matches")
            if op == "$set":
                out = set_field(out, path, _typed(out, path, arg), at)
            elif op == "$unset":
                out = remove_field(out, path, at)
            else:
                out = rename_field(out, path, arg, at)
    return out.drop("__matches")


def _typed(df: DataFrame, path: str, value: Any) -> Column:
    if is_collection(df):
        if isinstance(value, (dict, list)) or value is None:
            return F.parse_json(F.lit(json.dumps(value)))
        return F.lit(value)
    kind = fields_of(df).data_type(path)
    return F.lit(value) if kind is None else F.lit(value).cast(kind)


def delete(df: DataFrame, query: dict | str, many: bool = True, key: tuple[str, ...] = ()) -> DataFrame:
    """Rows that do not match, or all but one match; a condition that is NULL does not delete."""
    matches = F.expr(query) if isinstance(query, str) else compile_filter(query, fields_of(df))
    if many:
        return df.where(negate(matches))
    return _marked(df, matches, many, key).where("NOT __matches").drop("__matches")


def affected(df: DataFrame, query: dict | str) -> tuple[DataFrame, Observation]:
    """The frame with a count of the matching rows riding on its next action."""
    matches = F.expr(query) if isinstance(query, str) else compile_filter(query, fields_of(df))
    seen = Observation()
    return df.observe(seen, F.count(F.when(matches, 1)).alias("affected")), seen


def last_per_key(df: DataFrame, key: tuple[str, ...], order: Column | None = None) -> DataFrame:
    """One row per key, the greatest by ``order``.

    An aggregate, not a window: the rows of a hot key are reduced map-side. A
    row without an order counts as the smallest.
    """
    order = whole_row(df.schema.fields) if order is None else F.struct(order)
    best = df.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.max_by(F.struct("*"), order).alias("__row"))
    return best.select("__row.*")


def _as_type(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """A cast, unless the types only differ in what may be NULL inside them."""
    return col if have.simpleString() == want.simpleString() else col.cast(want)


def upsert(
    df: DataFrame, source: DataFrame, key: tuple[str, ...], replace_row: bool = False,
    order: Column | None = None,
) -> DataFrame:
    """Rows of ``source`` replace those with their key, or are added.

    A column the source has is overwritten even by NULL; one it lacks keeps its
    value, or with ``replace_row`` becomes NULL. The target is only ever the left
    side of a join with the de-duplicated source, so a small source is
    broadcast by the optimizer and the target does not move.
    """
    # reduced once, as it is looked at three times; a key with a NULL part equals no other
    whole = _whole_key(key)
    latest = cut_lineage(last_per_key(source.where(whole), key, order).unionByName(source.where(~whole)))
    carried = [c for c in df.columns if c not in key]
    fresh = F.struct(*[F.col(f"`{c}`") for c in latest.columns]).alias("__new")
    keyed = latest.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in key], fresh)
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"`__{k}`") for k in key])
    hit = F.col("__new").isNotNull()

    def merged(c: str) -> Column:
        old = F.col(f"`{c}`")
        if c in latest.columns:
            new = _as_type(F.col("__new").getField(c), latest.schema[c].dataType, df.schema[c].dataType)
        elif replace_row:
            new = F.lit(None).cast(df.schema[c].dataType)
        else:
            return old
        return F.when(hit, new).otherwise(old).alias(c)

    # columns only the source has are added, as fields are to documents
    extra = [f for f in latest.schema.fields if f.name not in df.columns]
    kept = df.join(keyed, same, "left").select(
        *[F.col(f"`{k}`") for k in key if k in df.columns], *[merged(c) for c in carried],
        *[F.col("__new").getField(f.name).alias(f.name) for f in extra],
    )
    known = df.select(*key).join(latest.select(*key), list(key), "left_semi").distinct()
    added = latest.join(known, list(key), "left_anti").select(*[F.col(f"`{c}`") for c in latest.columns])
    order_of_columns = [*df.columns, *[f.name for f in extra]]
    return kept.select(*[F.col(f"`{c}`") for c in order_of_columns]).unionByName(
        added.select(*[
            _as_type(F.col(f"`{f.name}`"), f.dataType, df.schema[f.name].dataType).alias(f.name)
            if f.name in df.columns else F.col(f"`{f.name}`")
            for f in added.schema.fields
        ]),
        allowMissingColumns=True,
    )


def seed_rows(
    df: DataFrame, rows: DataFrame, keys: list[tuple[str, ...]], order: Column | None = None
) -> DataFrame:
    """The rows a seed adds: those that clash with no row on any unique key.

    Clashes inside the seed go to the first row by ``order``. A key with a NULL
    part clashes with nothing. The target is only searched for the keys of the
    seed, so a small seed is broadcast to it.
    """
    free = rows
    for key in keys:
        taken = df.select(*key).join(rows.select(*key), list(key), "left_semi").distinct()
        free = free.join(taken, list(key), "left_anti")
    rank = whole_row(rows.schema.fields) if order is None else F.struct(order)
    free = free.withColumn("__rank", rank)
    if len(keys) == 1:
        return _first_by_rank(free, keys[0]).drop("__rank")
    return _first_on_every_key(free, keys).drop("__rank")


def _whole_key(key: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in key])


def _first_by_rank(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    keyed = df.where(_whole_key(key))
    first = keyed.groupBy(*key).agg(F.min_by(F.struct("*"), "__rank").alias("__row")).select("__row.*")
    return first.unionByName(df.where(~_whole_key(key)))


def _first_on_every_key(df: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
    """What inserting row by row would let in when there are several unique keys.

    A row that comes first on all its keys goes in and shuts out the rows it
    clashes with; that may free others, so it repeats until all are decided. The
    rounds are as many as the longest chain of rows of which each waits for the
    next; every round decides the smallest rank that is left, so it comes to an end.
    """
    undecided = cut_lineage(df)
    chosen: list[DataFrame] = []
    while not undecided.isEmpty():
        leading = undecided
        for key in keys:
            best = undecided.where(_whole_key(key)).groupBy(*key).agg(F.min("__rank").alias("__best"))
            leading = leading.join(best, list(key), "left").where(
                F.col("__best").isNull() | F.col("__best").eqNullSafe(F.col("__rank"))
            ).drop("__best").select(*undecided.columns)
        keyed = reduce(lambda a, b: a | b, [_whole_key(k) for k in keys])
        # equal rows clash with each other, unless none of their keys counts
        leading = cut_lineage(
            leading.where(keyed).dropDuplicates(["__rank"]).unionByName(leading.where(~keyed))
        )
        chosen.append(leading)
        rest = undecided.join(leading.select("__rank"), "__rank", "left_anti").select(*undecided.columns)
        for key in keys:
            rest = rest.join(leading.select(*key), list(key), "left_anti").select(*undecided.columns)
        undecided = cut_lineage(rest)
    return reduce(DataFrame.unionByName, chosen) if chosen else df


def seed(
    df: DataFrame, rows: DataFrame, keys: list[tuple[str, ...]], order: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """The table with the seed added, and ``(supplied, inserted, total)``."""
    added = seed_rows(df, rows, keys, order)
    out = df.unionByName(added, allowMissingColumns=True)
    report = (
        rows.agg(F.count(F.lit(1)).alias("supplied"))
        .select("supplied", added.agg(F.count(F.lit(1))).scalar().alias("inserted"),
                df.agg(F.count(F.lit(1))).scalar().alias("__before"))
        .select("supplied", "inserted", (F.col("__before") + F.col("inserted")).alias("total"))
    )
    return out, report


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(F.col("deleted_at").isNull())


def soft_delete(df: DataFrame, query: dict, now: datetime) -> DataFrame:
    """Stamp the matches as deleted and changed instead of removing them."""
    matches = F.coalesce(compile_filter(query, fields_of(df)), F.lit(False)) & F.col("deleted_at").isNull()
    out = df.withColumn("__matches", matches)
    for column in ("deleted_at", "updated_at"):
        if column in df.columns:
            stamp = moment(now, df.schema[column].dataType)
            out = out.withColumn(column, F.when(F.col("__matches"), stamp).otherwise(F.col(column)))
    return out.drop("__matches")


# ---- references --------------------------------------------------------------


def _reachable(ts: TableSet, table: str, actions: tuple[str, ...] | None) -> list[Reference]:
    """References met when walking down from a table, nearest first."""
    found: list[Reference] = []
    frontier = [table]
    while frontier:
        step = [
            r for r in ts.references
            if r.parent in frontier and r not in found and (actions is None or r.on_delete in actions)
        ]
        found += step
        frontier = [r.child for r in step]
    return found


def _has_cycle(refs: list[Reference]) -> bool:
    rest = list(refs)
    while rest:
        parents = {r.parent for r in rest}
        leaves = [r for r in rest if r.child not in parents]
        if not leaves:
            return True
        rest = [r for r in rest if r not in leaves]
    return False


class _Reached:
    """Rows of each table that a change to some rows of ``table`` reaches."""

    def __init__(self, ts: TableSet, table: str, matches: Column, refs: list[Reference]):
        self.ts, self.table, self.matches, self.refs = ts, table, matches, refs
        self.values: dict[tuple[str, str], DataFrame] = {}
        if _has_cycle(refs):
            self._until_stable()
        else:
            self._top_down()

    def _incoming(self, table: str) -> list[Reference]:
        return [r for r in self.refs if r.child == table]

    def _pointed_at(self, table: str) -> set[str]:
        return {r.parent_column for r in self.ts.references if r.parent == table}

    def through(self, ref: Reference) -> DataFrame:
        """Child rows whose reference is among the reached parent values."""
        child = self.ts[ref.child]
        values = self.values[(ref.parent, ref.parent_column)]
        return child.join(values, child[ref.column] == values["__value"], "left_semi")

    def rows(self, table: str) -> list[DataFrame]:
        """Frames that together hold the reached rows of a table, overlaps possible."""
        own = [self.ts[table].where(self.matches)] if table == self.table else []
        return own + [self.through(r) for r in self._incoming(table)]

    def _collect(self, table: str) -> None:
        frames = self.rows(table)
        for column in self._pointed_at(table):
            each = [f.select(F.col(column).alias("__value")) for f in frames]
            self.values[(table, column)] = reduce(DataFrame.unionByName, each).distinct()

    def _top_down(self) -> None:
        waiting = [self.table]
        waiting += [t for t in dict.fromkeys(r.child for r in self.refs) if t != self.table]
        done: set[str] = set()
        while waiting:
            ready = next(t for t in waiting if all(r.parent in done for r in self._incoming(t)))
            self._collect(ready)
            done.add(ready)
            waiting.remove(ready)

    def _until_stable(self) -> None:
        """Follow references round and round until no new value turns up; each round writes its new values only."""
        tables = [self.table, *[t for t in dict.fromkeys(r.child for r in self.refs) if t != self.table]]
        spark, folders = self.ts.spark, {}

        def append(slot: tuple[str, str], values: DataFrame, round: int) -> DataFrame:
            """The values of one round, written beside those of the rounds before."""
            folder = folders.setdefault(slot, scratch_path(spark, "reached"))
            values.write.parquet(f"{folder}/round={round}")
            read = spark.read.schema(values.schema)
            self.values[slot] = read.parquet(folder).select("__value")
            return read.parquet(f"{folder}/round={round}")

        fresh: dict[tuple[str, str], DataFrame] = {}
        for t in tables:
            for column in self._pointed_at(t):
                start = self.ts[t].where(self.matches if t == self.table else F.lit(False))
                fresh[(t, column)] = append((t, column), start.select(F.col(column).alias("__value")).distinct(), 0)
        round = 0
        while fresh:
            round += 1
            found: dict[tuple[str, str], DataFrame] = {}
            for ref in self.refs:
                if (ref.parent, ref.parent_column) not in fresh:
                    continue
                child, values = self.ts[ref.child], fresh[(ref.parent, ref.parent_column)]
                hit = child.join(values, child[ref.column] == values["__value"], "left_semi")
                for column in self._pointed_at(ref.child):
                    each = hit.select(F.col(column).alias("__value"))
                    slot = (ref.child, column)
                    found[slot] = found[slot].unionByName(each) if slot in found else each
            fresh = {}
            for slot, values in found.items():
                new = append(slot, values.distinct().join(self.values[slot], "__value", "left_anti"), round)
                if not new.isEmpty():
                    fresh[slot] = new


def impact(ts: TableSet, table: str, where: str) -> DataFrame:
    """Rows a change reaches: the matches, then dependent rows per reference.

    Dependent rows are counted per referenced value before the semi join.
    """
    matches = F.expr(where)
    reached = _Reached(ts, table, matches, _reachable(ts, table, None))
    frames = [
        ts[table].where(matches).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(table).alias("table_name"), F.lit(None).cast("string").alias("reference"),
            F.lit(None).cast("string").alias("on_delete"), "rows",
        )
    ]
    for ref in reached.refs:
        counts = ts[ref.child].groupBy(F.col(ref.column).alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
        values = reached.values[(ref.parent, ref.parent_column)]
        frames.append(
            counts.join(values, counts["__at"] == values["__value"], "left_semi")
            .agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"))
            .select(F.lit(ref.child).alias("table_name"), F.lit(ref.name).alias("reference"),
                    F.lit(ref.on_delete).alias("on_delete"), "rows")
        )
    return reduce(DataFrame.unionByName, frames)


def delete_cascade(ts: TableSet, table: str, where: str) -> TableSet:
    """Delete the matches and act on their references as declared.

    CASCADE deletes children, SET NULL clears their reference; a row that still
    points at a deleted one under any other action is an error.
    """
    matches = F.coalesce(F.expr(where), F.lit(False))
    reached = _Reached(ts, table, matches, _reachable(ts, table, (CASCADE,)))
    gone = {table, *[r.child for r in reached.refs]}
    changed: dict[str, DataFrame] = {}
    for name in sorted(gone):
        df = ts[name].where(~matches) if name == table else ts[name]
        for ref in reached._incoming(name):
            values = reached.values[(ref.parent, ref.parent_column)]
            df = df.join(values, df[ref.column] == values["__value"], "left_anti")
        changed[name] = df
    for ref in ts.references:
        if ref.parent not in gone or ref.on_delete == CASCADE:
            continue
        values = reached.values[(ref.parent, ref.parent_column)]
        df = changed.get(ref.child, ts[ref.child])
        if ref.on_delete == SET_NULL:
            joined = df.join(values, df[ref.column] == values["__value"], "left")
            cleared = F.when(F.col("__value").isNull(), F.col(ref.column)).alias(ref.column)
            changed[ref.child] = joined.select(*[cleared if c == ref.column else F.col(f"`{c}`") for c in df.columns])
        elif not df.join(values, df[ref.column] == values["__value"], "left_semi").isEmpty():
            raise ValueError(f"rows of {ref.child} still refer to deleted rows of {ref.parent}")
    return ts.with_tables(changed)


def drop_table(ts: TableSet, name: str, backup_dir: str | None, now: datetime) -> tuple[TableSet, str | None]:
    """Drop a table, copying it first, and the references that mention it."""
    path = copy_table(ts, name, backup_dir, now) if backup_dir else None
    return ts.without(name), path


def dependent_rows(ts: TableSet, ref: Reference, where: str) -> DataFrame:
    """Child rows that point at the parent rows meeting a condition."""
    return dependents(ts, ref, ts[ref.parent].where(where))


def declared_dependents(ts: TableSet, table: str) -> list[Mapping[str, str]]:
    """Tables that refer to a table, with the reference and its action."""
    return [
        {"table": r.child, "reference": r.name, "on_delete": r.on_delete}
        for r in ts.references if r.parent == table
    ]
