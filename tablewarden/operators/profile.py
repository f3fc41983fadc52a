"""Row counts, column statistics and inferred schemas.

Exact distinct counts never gather the values of a column in one place: equal
values are first combined map-side into ``(column, value, n)``, so a value that
fills a third of the table shuffles as one row per task.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewarden.functions.digests import value_key
from tablewarden.functions.jsontext import DATA_KEY, skeleton
from tablewarden.functions.values import common_type, percent, type_tag
from tablewarden.operators.discovery import discover_references
from tablewarden.operators.predicates import compile_filter, fields_of
from tablewarden.operators.search import check_tables
from tablewarden.runtime import cut_lineage
from tablewarden.sources.sinks import text_form
from tablewarden.sources.tables import TableSet

_MEASURES = {
    "min_length": "int",
    "max_length": "int",
    "avg_length": "double",
    "min_value": "string",
    "max_value": "string",
    "avg_value": "double",
}


def count(df: DataFrame, where: str | dict | None = None) -> DataFrame:
    """One row ``rows``; the condition is SQL text or a filter document."""
    if isinstance(where, dict):
        df = df.where(compile_filter(where, fields_of(df)))
    elif where:
        df = df.where(where)
    return df.agg(F.count(F.lit(1)).alias("rows"))


def count_all(ts: TableSet, total: bool = True) -> DataFrame:
    """Rows of every table and, with ``total``, a row named ``TOTAL``.

    A table that does not open has NULL rows, with a warning; the others are
    counted all the same.
    """
    good, errors = check_tables(ts)
    for name, error in errors.items():
        warnings.warn(f'table "{name}" is not counted: {error}', stacklevel=2)
    nothing = ts.spark.createDataFrame([(n, None) for n in errors], "table_name string, rows bigint")
    frames = [
        good[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name in good.open().names
    ]
    counts = reduce(DataFrame.unionByName, [*frames, nothing] if errors else frames or [nothing])
    if not total:
        return counts
    return counts.rollup("table_name").agg(F.sum("rows").alias("rows")).select(
        F.coalesce("table_name", F.lit("TOTAL")).alias("table_name"), "rows"
    )


def base_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: distinct and null counts and, by type, length or value range.

    With ``exact=False`` distinct counts are sketches and a task shuffles one
    row per column only, the choice for very long tables of mostly unique
    values.
    """
    fields = df.schema.fields
    shape = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), base_type(f.dataType)) for i, f in enumerate(fields)],
        "position int, column_name string, data_type string, base_type string",
    )
    stats = _column_stats(df, exact)
    # one row per column of the schema on either side
    return shape.join(F.broadcast(stats), "column_name", "left").select(
        "column_name", "data_type", "base_type",
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        F.coalesce("null_count", F.lit(0)).alias("null_count"),
        *_MEASURES,
    )


def _family(f: T.StructField) -> tuple[str, Column]:
    """The type a column is grouped under and the column as that type."""
    col = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.IntegralType):
        return "bigint", col.cast("bigint")
    if base_type(f.dataType) != "other":
        return f.dataType.simpleString(), col
    return "other", text_form(f.name, f.dataType)


def _column_stats(df: DataFrame, exact: bool = True, names: list[str] | None = None) -> DataFrame:
    """Statistics of each column, when exact from its distinct values and their counts.

    Columns of one type are unpivoted together, so each family scans only its
    own columns and groups on a narrow typed key; all families make one scan of
    the table. One wide aggregate with a DISTINCT per column would instead
    shuffle a row as wide as the table for every cell.
    """
    families: dict[str, list[Column]] = {}
    for f in df.schema.fields:
        if names is None or f.name in names:
            family, col = _family(f)
            families.setdefault(family, []).append(col.alias(f.name))
    frames = []
    for family, columns in families.items():
        cells = df.select(*columns).unpivot([], ["*"], "column_name", "value")
        if not exact:
            frames.append(_sketched_stats(cells, family))
        elif family in ("string", "other"):
            frames.append(_string_stats(cells))
        else:
            frames.append(_typed_stats(cells))
        if family == "other":
            frames[-1] = frames[-1].select(
                "column_name", "unique_values", "null_count", *_no_measures(*_MEASURES)
            )
    return reduce(DataFrame.unionByName, frames)


def _no_measures(*names: str) -> list[Column]:
    return [F.lit(None).cast(_MEASURES[n]).alias(n) for n in names]


def _null_count() -> Column:
    return F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count")


def _typed_stats(cells: DataFrame) -> DataFrame:
    seen = cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    numeric = isinstance(cells.schema["value"].dataType, T.NumericType)
    ordered = not isinstance(cells.schema["value"].dataType, T.BooleanType)
    value = F.col("value")
    ranged = (
        [F.min(value).cast("string").alias("min_value"), F.max(value).cast("string").alias("max_value")]
        if ordered
        else _no_measures("min_value", "max_value")
    )
    weighted = F.sum(value.cast("double") * F.col("n")) / F.sum(F.when(value.isNotNull(), F.col("n")))
    return seen.groupBy("column_name").agg(
        F.count(value).alias("unique_values"), _null_count(), *ranged,
        weighted.alias("avg_value") if numeric else F.first(F.lit(None).cast("double")).alias("avg_value"),
    ).select("column_name", "unique_values", "null_count",
             *_no_measures("min_length", "max_length", "avg_length"),
             "min_value", "max_value", "avg_value")


def _string_stats(cells: DataFrame) -> DataFrame:
    """As for other types, grouped on short stand-ins for long texts."""
    seen = cells.groupBy(
        "column_name", value_key(F.col("value")).alias("value"), F.length("value").alias("length")
    ).agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("column_name").agg(
        F.count("value").alias("unique_values"), _null_count(),
        F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        (F.sum(F.col("length") * F.col("n")) / F.sum(F.when(F.col("length").isNotNull(), F.col("n")))).alias(
            "avg_length"
        ),
    ).select("column_name", "unique_values", "null_count", "min_length", "max_length", "avg_length",
             *_no_measures("min_value", "max_value", "avg_value"))


def _sketched_stats(cells: DataFrame, family: str) -> DataFrame:
    value = F.col("value")
    dtype = cells.schema["value"].dataType
    measures: dict[str, Column] = {}
    if family == "string":
        size = F.length(value)
        measures = {"min_length": F.min(size), "max_length": F.max(size), "avg_length": F.avg(size)}
    elif base_type(dtype) in ("number", "date"):
        measures = {"min_value": F.min(value).cast("string"), "max_value": F.max(value).cast("string")}
    if isinstance(dtype, T.NumericType):
        measures["avg_value"] = F.avg(value.cast("double"))
    stats = cells.groupBy("column_name").agg(
        F.approx_count_distinct(value).alias("unique_values"),
        F.count(F.when(value.isNull(), 1)).alias("null_count"),
        *[c.alias(n) for n, c in measures.items()],
    )
    return stats.select(
        "column_name", "unique_values", "null_count",
        *[F.col(n) if n in measures else _no_measures(n)[0] for n in _MEASURES],
    )


def distinct_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(column_name, unique_values, null_count)``, exact, NULL not counted."""
    return _column_stats(df, names=names).select("column_name", "unique_values", "null_count")


def exact_medians(df: DataFrame) -> DataFrame:
    """``(column_name, median)`` of number columns, between the two middle values where their count is even; NULL is left out.

    Values are counted first, then dealt by ranges of column and value. The sums
    of the ranges, a row each, say which of them hold the middle, and only these
    are added up in order: no task holds the values of a column. A column
    without values has no row.
    """
    cells = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in df.columns]).unpivot([], ["*"], "column_name", "value")
    seen = cells.where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    dealt = cut_lineage(seen.repartitionByRange("column_name", "value").withColumn("part", F.spark_partition_id()))
    whole = Window.partitionBy("column_name")
    upto = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per column and range
    sums = dealt.groupBy("column_name", "part").agg(F.sum("n").alias("in_part"))
    sums = sums.withColumn("before", F.coalesce(F.sum("in_part").over(upto), F.lit(0))).withColumn("rows", F.sum("in_part").over(whole))
    low, high = F.floor((F.col("rows") - 1) / 2), F.floor(F.col("rows") / 2)
    middle = sums.withColumn("low", low).withColumn("high", high).where("low < before + in_part AND high >= before")
    rows = dealt.join(F.broadcast(middle), ["column_name", "part"])
    end = F.col("before") + F.sum("n").over(Window.partitionBy("column_name", "part").orderBy("value"))
    found = rows.withColumn("end", end).withColumn("begin", F.col("end") - F.col("n"))
    at = lambda place: F.max(F.when((F.col(place) >= F.col("begin")) & (F.col(place) < F.col("end")), F.col("value")))
    found = found.groupBy("column_name").agg(at("low").alias("low"), at("high").alias("high"))
    return found.select("column_name", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0.5 * F.col("low") + 0.5 * F.col("high")).alias("median"))


def profile_documents(df: DataFrame) -> DataFrame:
    """Per top-level field of a VARIANT ``doc``: presence, types and ranges.

    Every document is read, not a sample. ``_id`` is left out. Each distinct
    value of a field is looked at once, with the number of times it occurred.
    """
    entries = F.map_entries(F.try_variant_get("doc", "$", "map<string,variant>"))
    pairs = df.select(F.explode(entries).alias("e")).where(F.col("e.key") != "_id")
    value, tag = F.col("value"), F.col("tag")
    tagged = pairs.select(
        F.col("e.key").alias("field"), F.col("e.value").alias("value"), type_tag(F.col("e.value")).alias("tag")
    )
    typed = tagged.select(
        "field",
        "tag",
        F.to_json(value).alias("json"),
        F.when(tag == "string", F.length(F.try_variant_get(value, "$", "string"))).alias("length"),
        F.when(tag == "number", F.try_variant_get(value, "$", "double")).alias("number"),
        F.when(tag == "date", F.try_variant_get(value, "$", "timestamp")).alias("moment"),
        F.when(tag == "array", F.size(F.try_variant_get(value, "$", "array<variant>"))).alias("items"),
    )
    distinct = typed.groupBy(
        "field", "tag", value_key(F.col("json")).alias("value"), "length", "number", "moment", "items"
    ).agg(F.count(F.lit(1)).alias("n"))

    def weighted(name: str) -> Column:
        col = F.col(name).cast("double")
        return F.sum(col * F.col("n")) / F.sum(F.when(col.isNotNull(), F.col("n")))

    per_field = distinct.groupBy("field").agg(
        F.sum("n").alias("present"),
        F.count(F.lit(1)).alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("tag") == "null", F.col("n"))), F.lit(0)).alias("null_count"),
        F.sort_array(F.collect_set("tag")).alias("types"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        weighted("length").alias("avg_length"),
        F.min("number").alias("min_value"),
        F.max("number").alias("max_value"),
        weighted("number").alias("avg_value"),
        F.min("moment").alias("min_date"),
        F.max("moment").alias("max_date"),
        F.min("items").alias("min_items"),
        F.max("items").alias("max_items"),
        weighted("items").alias("avg_items"),
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    kind = common_type(F.col("types"))
    ranges = {
        "string": ["min_length", "max_length", "avg_length"],
        "number": ["min_value", "max_value", "avg_value"],
        "date": ["min_date", "max_date"],
        "array": ["min_items", "max_items", "avg_items"],
    }
    shown = [F.when(kind == k, F.col(c)).alias(c) for k, names in ranges.items() for c in names]
    return per_field.select(
        "field", kind.alias("common_type"), F.array_join("types", ", ").alias("types"),
        "present", percent(F.col("present"), total).alias("presence_pct"),
        "unique_values", "null_count", *shown,
    )


_PATH_ENTRY = "array<struct<path: string, value: variant, parent: string>>"


def infer_fields(
    df: DataFrame, max_depth: int | None = None, data_key: str | None = DATA_KEY, most_names: int | None = None
) -> DataFrame:
    """Dotted paths of nested documents with their types and presence.

    The objects in an array add their fields under ``path[*]``, wherever in it
    they stand, and an array counts with the types of all its elements. A path
    is counted once per document however often it occurs in it. Without
    ``max_depth`` the depth is found first, in a pass that stops descending
    where the documents end.

    Documents are first reduced to their skeleton, that is keys and nesting with
    the values blanked out, and equal ones are counted map-side: a collection
    has far fewer skeletons than documents. Levels are then unfolded inside the
    row of a skeleton, and only its distinct ``(path, type)`` pairs leave it.

    Keys that are data share one path, ``{*}`` in place of the key: those that
    match ``data_key`` as a whole, which leave the skeletons too, and with
    ``most_names`` all keys of an object that has more different ones than that
    over all documents, whatever they look like (a pass per level).
    """
    counted = cut_lineage(
        # no filter here: it would be pushed down and blank out every document twice
        df.select(skeleton(F.to_json("doc"), data_key).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    )
    shapes = counted.select(F.try_parse_json("text").alias("doc"), "n")
    depth = max_depth or document_depth(shapes)
    frame = _levels(shapes, depth, wide_objects(shapes, depth, most_names) if most_names else [])
    tagged = [
        F.flatten(F.transform(f"l{i}", lambda e: F.transform(
            _shapes(e["value"]), lambda t: F.struct(e["path"].alias("path"), t.alias("type"))
        )))
        for i in range(depth)
    ]
    pairs = frame.select("n", F.array_distinct(F.concat(*tagged)).alias("pairs"))
    # one entry per path of the document, next to one per type of the path
    marks = F.array_distinct(
        F.transform("pairs", lambda p: F.struct(p["path"].alias("path"), F.lit(None).cast("string").alias("type")))
    )
    per_path = (
        pairs.select("n", F.explode(F.concat("pairs", marks)).alias("p"))
        .groupBy("p.path", "p.type")
        .agg(F.sum("n").alias("n"))
        .groupBy("path")
        .agg(
            F.sum(F.when(F.col("type").isNull(), F.col("n"))).alias("documents"),
            F.array_join(F.sort_array(F.collect_set("type")), ", ").alias("types"),
        )
    )
    total = counted.agg(F.sum("n")).scalar()
    return per_path.select(
        "path", "types", "documents", percent(F.col("documents"), total, 0).alias("presence_pct")
    ).orderBy(F.when(F.col("path") == "_id", 0).otherwise(1), F.desc("documents"), "path")


def first_document_fields(df: DataFrame) -> DataFrame:
    """The fields of one document: a quick look, without a claim on the rest."""
    return infer_fields(df.limit(1))


def wide_objects(df: DataFrame, depth: int, most_names: int) -> list[str]:
    """The paths of objects that have more than ``most_names`` different keys over all documents.

    Levels are looked at from the top, with the keys of wide objects already
    taken together, so objects below them are counted as one.
    """
    wide: list[str] = []
    for i in range(depth):
        keys = F.array_distinct(F.transform(f"l{i}", lambda e: F.struct(e["parent"].alias("parent"), e["path"].alias("path"))))
        found = (
            _levels(df, i + 1, wide).select(F.explode(keys).alias("k")).select("k.*").distinct()
            .groupBy("parent").count().where(F.col("count") > most_names)
        )
        wide += [r.parent for r in found.collect()]
    return wide


def _levels(shapes: DataFrame, depth: int, wide: list[str]) -> DataFrame:
    """Columns ``l0``, ``l1``, ...: the fields of each level of a document."""
    frame = shapes.select("n", _children(F.lit(""), F.col("doc"), "", wide).alias("l0"))
    for i in range(1, depth):
        frame = frame.withColumn(f"l{i}", F.flatten(F.transform(f"l{i - 1}", lambda e: _below(e, wide))))
    return frame


def _children(prefix: Column, value: Column, dot: str, wide: list[str]) -> Column:
    """The fields of an object as ``(path, value, parent)``; empty for anything else."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))

    def name(key: Column) -> Column:
        is_data = key.rlike(r"^\{\*\}[0-9]+$")
        return F.when(is_data | prefix.isin(wide) if wide else is_data, F.lit("{*}")).otherwise(key)

    out = F.transform(
        entries,
        lambda e: F.struct(
            F.concat(prefix, F.lit(dot), name(e["key"])).alias("path"), e["value"].alias("value"), prefix.alias("parent")
        ),
    )
    return F.coalesce(out, F.array().cast(_PATH_ENTRY))


def _below(entry: Column, wide: list[str]) -> Column:
    """One level down: the fields of an object, or of the objects in an array."""
    fields = _children(entry["path"], entry["value"], ".", wide)
    elements = F.try_variant_get(entry["value"], "$", "array<variant>")
    opened = F.filter(elements, lambda x: type_tag(x) == "object")
    inner = F.flatten(
        F.transform(
            opened, lambda x: _children(F.concat(entry["path"], F.lit("[*]")), x, ".", wide)
        )
    )
    return F.concat(fields, F.coalesce(inner, F.array().cast(_PATH_ENTRY)))


def _shapes(value: Column) -> Column:
    """The type tag; for an array that holds anything, one with the type of each kind of element."""
    tag = type_tag(value)
    # a null or an array as an element reads as object, as typeof does
    named = lambda x: F.when(type_tag(x).isin("null", "array", "date"), "object").otherwise(type_tag(x))
    elements = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.concat(F.lit("array("), named(x), F.lit(")")))
    return F.when((tag == "array") & (F.size(elements) > 0), F.array_distinct(elements)).otherwise(F.array(tag))


def document_depth(df: DataFrame) -> int:
    """How many levels of fields the deepest document has, at least 1.

    No document is deeper than it has opening braces. Where that bound is small
    it is used as it is; else levels are unfolded, twice as many each time,
    until one is empty everywhere.
    """
    braces = F.length(F.regexp_replace(F.to_json("doc"), "[^{]", ""))
    bound = df.agg(F.max(braces)).first()[0] or 1
    if bound <= 3:
        return max(bound, 1)
    probe = 4
    while True:
        frame = _levels(df.withColumn("n", F.lit(1)), probe + 1, [])
        used = reduce(
            lambda a, b: a + b, [F.when(F.size(f"l{i}") > 0, 1).otherwise(0) for i in range(probe + 1)]
        )
        depth = frame.agg(F.max(used)).first()[0] or 1
        if depth <= probe:
            return max(depth, 1)
        probe *= 2


def inventory(ts: TableSet) -> DataFrame:
    """Name, number of columns, rows, bytes on disk and bytes per row.

    Bytes come from the files that were scanned. A file appears in the rows of
    one or two tasks, so sizes are combined per file before they are added up.
    """
    frames = []
    for name in ts.open().names:
        df = ts[name]
        width = len(df.columns)
        per_file = (
            df.select("_metadata.file_path", "_metadata.file_size")
            .groupBy("file_path", "file_size")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        frames.append(
            per_file.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
            ).select(F.lit(name).alias("table_name"), F.lit(width).alias("columns"), "rows", "bytes")
        )
    return reduce(DataFrame.unionByName, frames).withColumn(
        "avg_row_bytes", F.when(F.col("rows") > 0, F.round(F.col("bytes") / F.col("rows"), 2))
    )


def collection_stats(df: DataFrame) -> DataFrame:
    """Documents, total and average size of their JSON text."""
    size = F.length(F.to_json("doc"))
    return df.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(size).alias("total_size"),
        F.avg(size).alias("avg_size"),
    )


def observed_columns(ts: TableSet, table: str, discover: bool = False) -> DataFrame:
    """Columns as found in the data: nullability, key candidates, references.

    References are the declared ones, or with ``discover`` those that the tables
    of the set allow, several joined by ``;``.
    """
    df = ts[table]
    targets = {r.column: f"{r.parent}.{r.parent_column}" for r in ts.references if r.child == table}
    facts = df.sparkSession.createDataFrame(
        [
            (i + 1, f.name, f.dataType.simpleString(), targets.get(f.name))
            for i, f in enumerate(df.schema.fields)
        ],
        "position int, column_name string, data_type string, references string",
    )
    rows = df.agg(F.count(F.lit(1))).scalar()
    unique = F.coalesce("unique_values", F.lit(0))
    nulls = F.coalesce("null_count", F.lit(0))
    if discover:
        target = F.concat_ws(".", "parent_table", "parent_column")
        found = discover_references(ts).where(F.col("child_table") == table).groupBy(F.col("child_column").alias("column_name"))
        # one row per column, with one entry per column of the set at most
        found = found.agg(F.array_join(F.sort_array(F.collect_list(target)), ";").alias("references"))
        facts = facts.drop("references").join(found, "column_name", "left")
    # one row per column of the schema on either side
    return facts.join(F.broadcast(distinct_counts(df)), "column_name", "left").select(
        "position", "column_name", "data_type", "references", nulls.alias("null_count"),
        (nulls > 0).alias("nullable"), unique.alias("unique_values"),
        ((nulls == 0) & (unique == rows)).alias("key_candidate"),
    ).orderBy("position")
