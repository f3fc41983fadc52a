"""Quality rules: plain rules on a text's statistics, then robust multivariate outliers per language and source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewarden.llm.common import WORD, Placed, Stages, pick, table

#: Sources below this many rows in a language are taken together there; if even these are fewer, all rows are their group.
MIN_ROWS = 50
#: Share of a group that the covariance is fitted to.
SUBSET = 0.75
#: Concentration steps, and the squared distance up to which rows count in the last estimate (chi-squared, 4 degrees, 97.5 %).
STEPS, REWEIGHT = 4, 11.14
#: Squared distance beyond which a row is an outlier: chi-squared with 4 degrees is above it once in about 10^11 rows.
LIMIT = 60.0
#: Smallest standard deviations of the vector's parts: they keep a covariance regular where most rows have one value.
FLOORS = (0.25, 0.08, 0.5, 0.5)
PARTS = tuple(f"v{i}" for i in range(len(FLOORS)))


def statistics(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, all longs; NULL has no words.

    Words are runs of other characters than blank, tab, line feed, vertical tab,
    form feed and carriage return. ``n_dup_lines`` counts lines with a word that
    equal an earlier one, ``n_repeat_words`` the words in 5-word windows that the
    text holds twice or more. Windows are compared by 64-bit hashes. The work is
    n log n in the words of a text at most.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    blanks = "\t\n\x0b\x0c\r"
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.trim(F.translate(x, blanks, " " * len(blanks)))) > 0)
    df = texts.withColumn("__hashes", F.transform(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    df = df.withColumn("__lines", lines)
    df = df.withColumn("n_words", F.size("__hashes").cast("long"))
    hashes = F.col("__hashes")
    window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)])
    windows = F.when(F.col("n_words") >= 6, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), window))
    df = df.withColumn("__windows", windows)
    # only a text with an equal pair of windows is sorted
    pairs = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__pairs", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), pairs))
    equal = lambda i, j: F.get(F.col("__pairs"), i)["h"] == F.get(F.col("__pairs"), j)["h"]
    repeated = F.filter("__pairs", lambda p, i: F.coalesce(equal(i, i - 1), F.lit(False)) | F.coalesce(equal(i, i + 1), F.lit(False)))
    df = df.withColumn("__places", F.array_sort(F.transform(repeated, lambda p: p["i"])))
    # each place covers the words up to the next one, five at most
    covered = F.transform("__places", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("__places", i + 1) - p, F.lit(5))))
    count = F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)
    df = df.withColumn("n_repeat_words", F.coalesce(count, F.lit(0).cast("long")))
    return df.select(
        *texts.columns, "n_words",
        F.length(F.translate(whole, " " + blanks, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def base_failed() -> Column:
    """Too short, or a fifth of the words repeats."""
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def vector() -> tuple[Column, ...]:
    """The statistics as a vector whose parts are about symmetric in ordinary texts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return (
        F.log1p(F.col("n_words").cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(F.lit(1000.0) * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.log1p(F.lit(100.0) * (F.col("n_repeat_words") + F.col("n_dup_lines")) / words),
    )


def _distance() -> Column:
    """The squared Mahalanobis distance of a row to its group, by forward substitution in the Cholesky factor."""
    solved: list[Column] = []
    for i, part in enumerate(PARTS):
        rest = F.col(part) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def _cholesky(groups: DataFrame) -> DataFrame:
    """Factor columns ``lij`` from covariance columns ``cij``."""
    for j in range(len(PARTS)):
        for i in range(j, len(PARTS)):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = F.sqrt(F.greatest(rest, F.lit(FLOORS[j] ** 2))) if i == j else rest / F.col(f"l{j}{j}")
            groups = groups.withColumn(f"l{i}{j}", out)
    return groups


def _moments(rows: DataFrame, by: Sequence[str], scale: Column) -> DataFrame:
    """Mean and covariance of each group, the covariance times ``scale`` and with the floors added to its diagonal."""
    n = range(len(PARTS))
    sums = rows.groupBy(*by).agg(
        *[F.avg(p).alias(f"m{i}") for i, p in enumerate(PARTS)],
        *[F.covar_pop(PARTS[i], PARTS[j]).alias(f"c{i}{j}") for i in n for j in range(i + 1)],
    )
    for i in n:
        for j in range(i + 1):
            sums = sums.withColumn(f"c{i}{j}", F.col(f"c{i}{j}") * scale + F.lit(FLOORS[i] ** 2 if i == j else 0.0))
    return _cholesky(sums)


def _with(rows: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    own = groups.toDF(*[f"__of_{c}" if c in by else c for c in groups.columns])
    match = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by]
    return rows.join(own, match, how).drop(*[f"__of_{c}" for c in by])


def estimates(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Minimum-covariance-determinant estimates: mean ``mi`` and Cholesky factor ``lij`` of each group.

    ``rows`` has the vector's parts and the group columns. From medians and
    median deviations, each concentration step fits mean and covariance to the
    ``SUBSET`` of a group that lies nearest to the estimate before, which never
    raises the determinant; the last estimate takes all rows within the usual
    distance. The nearest rows are found through a histogram of distances, a few
    hundred cells for a group of any size. Every step is a grouping with a
    map-side half, so a group may hold any share of the rows; what is written
    between steps is one row per group.
    """
    stages = Stages(rows.sparkSession, "estimates")
    n = range(len(PARTS))
    large = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(p, F.lit(0.5), F.lit(10_000)).alias(f"m{i}") for i, p in enumerate(PARTS)]
    ).where(F.col("n") >= MIN_ROWS)
    centred, _ = stages.write(large)
    spread = _with(rows, centred, by).groupBy(*by).agg(
        *[F.percentile_approx(F.abs(F.col(p) - F.col(f"m{i}")), F.lit(0.5), F.lit(10_000)).alias(f"s{i}") for i, p in enumerate(PARTS)]
    )
    start = _with(centred, spread, by)
    for i in n:
        for j in range(i):
            start = start.withColumn(f"l{i}{j}", F.lit(0.0))
        start = start.withColumn(f"l{i}{i}", F.greatest(F.lit(FLOORS[i]), F.lit(1.4826) * F.col(f"s{i}")))
    names = [*by, *[f"m{i}" for i in n], *[f"l{i}{j}" for i in n for j in range(i + 1)]]
    now, _ = stages.write(start.select(*names))
    for _ in range(STEPS):
        near = _with(rows, now, by).withColumn("__cell", F.floor(F.lit(32) * F.log1p(_distance())))
        cells = near.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("n"))
        whole = Window.partitionBy(*by)
        cells = cells.withColumn("upto", F.sum("n").over(whole.orderBy("__cell"))).withColumn("all", F.sum("n").over(whole))
        border = cells.where(F.col("upto") >= F.col("all") * SUBSET).groupBy(*by).agg(F.min("__cell").alias("__border"))
        nearest = _with(near, border, by).where(F.col("__cell") <= F.col("__border"))
        # the covariance of the nearest 75 % of a normal sample with 4 parts is this much too small
        now, _ = stages.write(_moments(nearest.select(*by, *PARTS), by, F.lit(1.63)).select(*names))
    near = _with(rows, now, by).where(_distance() <= REWEIGHT).select(*by, *PARTS)
    last, _ = stages.write(_moments(near, by, F.lit(1.05)).select(*names))
    return last


def judge(docs: DataFrame, text: str = "text", by: Sequence[str] = ("lang", "source"), keep: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` columns, the statistics, ``base_failed``, ``distance`` and ``kept`` for each row of ``docs``.

    A row is rejected by the plain rules, or if its vector lies further from its
    group than ``LIMIT``. Estimates leave out rows that the plain rules reject.
    NULL is a language or source like any other. Groups with fewer than
    ``MIN_ROWS`` rows share one estimate with the others of their first group
    column (the language); where these have fewer as well, the estimate of all
    rows of all languages is theirs. Only a table with fewer than ``MIN_ROWS``
    clean rows has no estimate; distances are NULL there and the plain rules
    alone decide. Equal rows count each, empty texts have no words, and an empty
    table gives no rows. Texts of any length are read once and kept with their
    statistics; all else is work on a few numbers per row.
    """
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = statistics(docs, text).select(*dict.fromkeys([*keep, *by]), *stats)
    rows = rows.withColumn("base_failed", base_failed())
    for name, part in zip(PARTS, vector(), strict=True):
        rows = rows.withColumn(name, part)
    stages = Stages(docs.sparkSession, "statistics")
    rows, _ = stages.write(rows, "zstd")  # it may hold the texts
    clean = ~F.col("base_failed")
    sizes, _ = stages.write(rows.where(clean).groupBy(*by).agg(F.count(F.lit(1)).alias("__n")))
    pools, _ = stages.write(sizes.where(F.col("__n") < MIN_ROWS).groupBy(by[0]).agg(F.sum("__n").alias("__pool")))
    rows = _with(_with(rows, sizes, by, "left"), pools, by[:1], "left")
    level = F.when(F.col("__n") >= MIN_ROWS, 0).when(F.col("__pool") >= MIN_ROWS, 1).otherwise(2)
    rows = rows.withColumn("__level", level).withColumn("__by0", F.when(F.col("__level") < 2, F.col(by[0])))
    for i, c in enumerate(by[1:], 1):
        rows = rows.withColumn(f"__by{i}", F.when(F.col("__level") == 0, F.col(c)))
    groups = [*[f"__by{i}" for i in range(len(by))], "__level"]
    fitted_to = rows.where(clean & (F.col("__level") < 2)).select(*groups, *PARTS)
    if not rows.where("__level = 2").isEmpty():
        nothing = [F.lit(None).cast(fitted_to.schema[f"__by{i}"].dataType).alias(f"__by{i}") for i in range(len(by))]
        fitted_to = fitted_to.unionAll(rows.where(clean).select(*nothing, F.lit(2).alias("__level"), *PARTS))
    fitted = estimates(fitted_to, groups)
    judged = _with(rows, fitted, groups, "left").withColumn("distance", _distance())
    return judged.select(*keep, *stats, "base_failed", "distance", (clean & (F.coalesce("distance", F.lit(0.0)) <= LIMIT)).alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; cases as in :func:`judge`.

    Documents are written once with their statistics, and what is joined to them
    afterwards is a row per group.
    """
    placed = Placed(docs)
    judged = judge(placed.df, placed.place("text"), (placed.place("lang"), placed.place("source")), placed.columns)
    return placed.restore(judged.where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    judged = judge(docs, keep=("doc_id",))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
