"""Layouts that let reads skip files, and an inverted text index with positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewarden.functions.digests import row_digest
from tablewarden.operators.integrity import duplicates

# Anything that is neither a letter nor a digit separates terms.
TERM_BREAK = r"[^\p{L}\p{N}]+"


#: Rows are laid out in files of about this many bytes and rows at most. Bytes are those of compressed files, which say
#: little about the memory that sorting short rows takes.
FILE_BYTES, FILE_ROWS = 128 << 20, 1_000_000


def files_for(df: DataFrame, file_bytes: int = FILE_BYTES, file_rows: int = FILE_ROWS) -> int:
    """How many files a frame asks for, from the size the optimizer expects and the number of rows; 1 at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, min(1_000_000, max(-(-size // file_bytes), -(-df.count() // file_rows))))


def cluster(df: DataFrame, columns: list[str], files: int | None = None, where: str | None = None) -> DataFrame:
    """Rows ordered so that each file holds a narrow range of the columns.

    Written as Parquet, a filter on the columns then skips most files by their
    minimum and maximum. A digest of the row comes last in the range, so that a
    value that fills much of the table spreads over several files. ``where``
    keeps a part of the rows, as a partial index does. Without ``files`` their
    number follows from the size of the rows.
    """
    rows = df.where(where) if where else df
    keys = [F.col(f"`{c}`") for c in columns]
    return rows.repartitionByRange(files or files_for(rows), *keys, row_digest(df.schema.fields)).sortWithinPartitions(*keys)


def _place(col: Column, dtype: T.DataType) -> Column:
    """A number in the order of the values; of a text its first six bytes count."""
    if isinstance(dtype, T.StringType):
        return F.conv(F.rpad(F.substring(F.hex(col), 1, 12), 12, "0"), 16, 10).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    return col.cast("int").cast("double") if isinstance(dtype, T.BooleanType) else col.cast("double")


def _rank(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below a value, by halving; NULL is 0."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= cuts[middle], between(low, middle)).otherwise(between(middle + 1, high))

    return F.when(value.isNull(), 0).otherwise(between(0, len(cuts)))


def curve_position(df: DataFrame, columns: list[str], bits: int = 6) -> Column:
    """A place on a space-filling curve: the bits of each column's quantile rank, taken in turn.

    Quantiles of all columns come from one pass, ``2 ** bits`` of each, and are
    all that reaches the driver. Ranks spread skewed values evenly, and every
    column has the same say in the order.
    """
    if len(columns) * bits > 62:
        raise ValueError("the bits of all columns must fit into 62")
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    places = [_place(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]
    found = df.agg(*[F.percentile_approx(p, shares, 10_000).alias(f"q{i}") for i, p in enumerate(places)]).first()
    out = F.lit(0).cast("long")
    for i, (place, cuts) in enumerate(zip(places, found, strict=True)):
        rank = _rank(place, sorted(set(cuts or []))).cast("long")
        for b in range(bits):
            bit = F.shiftright(rank, b).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(columns) + len(columns) - 1 - i))
    return out


def cluster_curve(df: DataFrame, columns: list[str], files: int | None = None, bits: int = 6) -> DataFrame:
    """Rows ordered along a space-filling curve over several columns.

    Where :func:`cluster` serves filters on the first column best, here a filter
    on any of the columns alone skips files: each file holds a box of them. A
    digest of the row comes last, so that rows of one place spread over files.
    """
    at = curve_position(df, columns, bits)
    placed = df.withColumn("__curve", at)
    dealt = placed.repartitionByRange(files or files_for(df), "__curve", row_digest(df.schema.fields))
    return dealt.sortWithinPartitions("__curve", *[F.col(f"`{c}`") for c in columns]).drop("__curve")


def write_hash_index(df: DataFrame, path: str, columns: list[str], distinct: int = 1_000_000) -> None:
    """Parquet with Bloom filters on some columns, for look-ups by equality.

    Rows stay in their order. A row group is skipped when its filter does not
    know the value, wherever the value lies between its smallest and largest.
    ``distinct`` is about how many values of a column a row group has.
    """
    writer = df.write
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    writer.parquet(path)


def write_buckets(df: DataFrame, table: str, path: str, key: list[str], buckets: int) -> DataFrame:
    """A table dealt and sorted by the hash of its key, and the table read back.

    Two tables with the same number of buckets are joined on the key, and each
    is grouped by it, without a shuffle. Each bucket is one file.
    """
    keys = [F.col(f"`{k}`") for k in key]
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *key).sortBy(*key)
    writer.option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def runs(numbers: list[int], most: int) -> list[tuple[int, int]]:
    """Sorted numbers as runs, joined over the smallest gaps until they are few."""
    gaps = sorted(((b - a, i) for i, (a, b) in enumerate(zip(numbers, numbers[1:], strict=False)) if b - a > 1), reverse=True)
    cuts = sorted(i for _, i in gaps[: most - 1])
    starts = [0, *[i + 1 for i in cuts]]
    return [(numbers[a], numbers[b - 1]) for a, b in zip(starts, [*starts[1:], len(numbers)], strict=True)]


def unique_index_ok(df: DataFrame, key: tuple[str, ...]) -> bool:
    """Whether a unique index could be put on the key."""
    return duplicates(df, key).isEmpty()


def build_text_index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(term, key, tf)`` over the whole text of some columns, lower-cased.

    Occurrences are counted map-side; the postings of a term stay separate rows
    and are never gathered, however common the term is.
    """
    text = F.concat_ws(" ", *[F.col(f"`{c}`") for c in columns])
    terms = df.select(F.col(f"`{key}`").alias("key"), F.explode(F.split(F.lower(text), TERM_BREAK)).alias("term"))
    return terms.where(F.col("term") != "").groupBy("term", "key").agg(F.count(F.lit(1)).alias("tf"))


def write_text_index(index: DataFrame, path: str) -> None:
    """Store an index sorted by term and key within its files, which the shuffle
    that counted the postings has dealt evenly, however common a term is.

    A lookup reads the pages of its terms in each file and skips all others.
    """
    index.sortWithinPartitions("term", "key").write.parquet(path)


def text_lookup(index: DataFrame, terms: list[str], every: bool = False) -> DataFrame:
    """Keys that hold any of the terms, or every one, with how often in all."""
    wanted = sorted({t.lower() for t in terms})
    found = index.where(F.col("term").isin(wanted)).groupBy("key").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("score")
    )
    return found.where(F.col("terms") == len(wanted)) if every else found


#: Positions of a term in a document that are one row, and words that are sorted in one go.
POSITIONS, RUN_WORDS = 1024, 4_000_000


def _postings_in_runs(names: list[str], per_block: int, run_words: int):
    """Of documents ``key, words`` the rows ``term, key, block, positions``, sorted by these in runs of about so many words."""

    # all that it needs is local, so it travels to executors by value
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs = pa.Table.from_batches(held).combine_chunks()
            docs = docs.take(pc.sort_indices(docs.column(0))).combine_chunks()
            keys, lists = docs.column(0).combine_chunks(), docs.column(1).combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            position = (np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            words = lists.flatten().dictionary_encode()
            order = pc.sort_indices(words.dictionary).to_numpy()
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            term = rank[words.indices.to_numpy()]
            # words are in the order of keys and positions already
            at = np.argsort(term, kind="stable")
            term, doc, position = term[at], doc[at], position[at]
            block = position // per_block
            new = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])
            starts = np.flatnonzero(np.append(True, new)).astype(np.int32)
            ends, terms = np.append(starts, len(term)).astype(np.int32), words.dictionary.take(pa.array(order))
            for k in range(0, len(starts), 100_000):
                first, cuts = starts[k : k + 100_000], ends[k : k + 100_001]
                places = pa.ListArray.from_arrays(pa.array(cuts - cuts[0]), pa.array(position[cuts[0] : cuts[-1]]))
                columns = [terms.take(pa.array(term[first])), keys.take(pa.array(doc[first])), pa.array(block[first].astype(np.int64)), places]
                yield pa.RecordBatch.from_arrays(columns, names)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += pc.sum(pc.list_value_length(batch.column(1))).as_py() or 0
            if n >= run_words:
                yield from run(held)
                held, n = [], 0
        if n:
            yield from run(held)

    return of


def write_positions(df: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """``<path>/postings``: term, key, block, positions; ``<path>/lengths``: key, length. Words count from 0 over all columns.

    Postings stay in the task that reads their documents and are sorted there,
    in runs of :data:`RUN_WORDS` words: nothing is shuffled, and a lookup reads
    the pages of its terms in each run. A very frequent term of a very long
    document has several blocks, so no row grows with the document. Documents
    that share a key have rows of their own; lookups add them up.
    """
    text = F.concat_ws(" ", *[F.col(f"`{c}`") for c in columns])
    words = F.filter(F.split(F.lower(text), TERM_BREAK), lambda w: w != "")
    rows = df.select(F.col(f"`{key}`").alias("key"), words.alias("words"))
    rows.select("key", F.size("words").cast("long").alias("length")).write.parquet(f"{path}/lengths")
    schema = T.StructType([
        T.StructField("term", T.StringType()), rows.schema["key"], T.StructField("block", T.LongType()),
        T.StructField("positions", T.ArrayType(T.IntegerType(), False)),
    ])
    rows.mapInArrow(_postings_in_runs(schema.names, POSITIONS, RUN_WORDS), schema).write.parquet(f"{path}/postings")


def _terms(text: str, spark: SparkSession) -> list[str]:
    row = spark.range(1).select(F.filter(F.split(F.lower(F.lit(text)), TERM_BREAK), lambda w: w != ""))
    return row.first()[0]


def phrase_lookup(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """``key, occurrences`` of the documents that hold some words one after another.

    Each word's places, moved back by its place in the phrase, are put together
    and counted by document and beginning: a beginning that has all of them is
    an occurrence. Words that come twice in the phrase are told apart.
    """
    terms = _terms(phrase, spark)
    places = F.array(*[F.lit(i) for i in range(len(terms))])
    offsets = F.filter(places, lambda i: F.array(*[F.lit(t) for t in terms])[i] == F.col("term"))
    held = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(terms)).withColumn("offset", F.explode(offsets))
    starts = held.select("key", "offset", F.explode("positions").alias("position")).groupBy("key", (F.col("position") - F.col("offset")).alias("start"))
    whole = starts.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms))
    return whole.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences"))


def ranked_lookup(spark: SparkSession, path: str, words: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key, terms, score`` of the documents with any of the words; rare words in short documents count most.

    BM25 over all documents: a word's weight is ``ln(1 + (N - n + 0.5) / (n + 0.5))``.
    """
    terms = sorted({t for w in words for t in _terms(w, spark)})
    postings, lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    of_term = postings.where(F.col("term").isin(terms)).groupBy("term", "key").agg(F.sum(F.size("positions")).alias("tf"))
    spread = of_term.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    size = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("usual"))
    # one row per word of the search, and one of totals
    found = of_term.join(lengths, "key").join(F.broadcast(spread), "term").join(F.broadcast(size))
    weight = F.log(1 + (F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("usual")))
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("terms"), F.sum(weight * share).alias("score"))
