"""Secret scans with an incremental ledger of blobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewarden.llm.common import as_bytes, pick, ship_package, table
from tablewarden.runtime import cut_lineage, list_dir, path_exists, scratch_path

SPAN = "struct<kind:string,start:bigint,end:bigint>"
LEDGER = f"blob string, version string, spans array<{SPAN}>, n_chars bigint"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts, its least length."""

    kind: str
    pattern: str
    group: int
    least: int
    flags: int = 0


#: The base kinds in the order in which they are listed, then further ones.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, re.IGNORECASE | re.ASCII,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run is looked at from its first character only, which is what leftmost matching does
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: Public forms of keys and tokens. Patterns begin with plain letters, which are found fast, and a
#: run of characters is looked at from one place only, so that none takes more than linear time.
FURTHER = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{22,}", 0, 0),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", 0, 0),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 0),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 0),
    Rule("npm", r"npm_[A-Za-z0-9]{36}", 0, 0),
    Rule("jwt", r"eyJ(?<![A-Za-z0-9_-]eyJ)[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    Rule("url_login", r"://[^\s/:@]{1,256}:[^\s/:@]{1,256}@", 0, 0),
)
RULES = BASE + FURTHER


def version_of(rules: tuple[Rule, ...]) -> str:
    """A name of what the rules find: it changes with any rule, and so asks for a new scan."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scanner(rules: tuple[Rule, ...]) -> Callable[[str], list[tuple[int, int, int]]]:
    """``(start, rule, end)`` of all findings in a text, in code points, sorted by start and then rule."""
    compiled = [(n, re.compile(r.pattern, r.flags), r.group, r.least) for n, r in enumerate(rules)]

    def scan(text: str) -> list[tuple[int, int, int]]:
        found = []
        for n, pattern, group, least in compiled:
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), n, m.end()))
        return sorted(found)

    return scan


def blob_of(text: Column) -> Column:
    """The address of a content: its SHA-256. NULL is the empty text."""
    return F.sha2(as_bytes(text), 256)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The findings known so far, a row per blob and rule version; empty where there is no ledger yet.

    A folder per rule version, so findings of other versions are not read.
    """
    if not path_exists(spark, path) or not list_dir(spark, path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def update(contents: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> str:
    """Scan what the ledger at ``path`` has no findings of yet, and add it; returns the rule version.

    ``contents`` has ``blob`` and ``text``. Each blob is scanned once for a rule
    version, however many versions and paths hold it. The texts meet by blob, so
    copies of one content are reduced where they are read, one row per task, and
    no task gets them all. Every blob gets a row, those without findings too.
    Spark commits the new rows when the scan is complete: a scan that fails adds
    nothing. One update at a time; after two that ran side by side blobs may be
    listed twice with equal findings, which reading allows for.
    """
    spark = contents.sparkSession
    ship_package(spark)
    version, scan, kinds = version_of(rules), scanner(rules), [r.kind for r in rules]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            spans, chars = [], []
            for data in batch.column(1):
                text = unpack(data.as_py()).decode()
                spans.append([{"kind": kinds[n], "start": s, "end": e} for s, n, e in scan(text)])
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([version] * batch.num_rows), pa.array(spans, _SPANS_ARROW), pa.array(chars, pa.int64()),
            ], ["blob", "version", "spans", "n_chars"])

    known = ledger(spark, path).where(F.col("version") == version).select("blob")
    unseen = first_of_each(contents).join(known, "blob", "left_anti")
    unseen.mapInArrow(find, LEDGER).write.mode("append").partitionBy("version").parquet(path)
    return version


def first_of_each(contents: DataFrame) -> DataFrame:
    """Each blob once, its text compressed. Within a task a copy is dropped before anything is shuffled."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            blobs, texts = [], []
            for blob, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if blob not in seen:
                    blobs.append(blob)
                    texts.append(pack(text.as_py()))
                    seen.add(blob)
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(texts, pa.binary())], ["blob", "text"])
            if len(seen) > 200_000:  # what is missed here is dropped after the shuffle
                seen.clear()

    local = contents.select("blob", as_bytes(F.col("text")).alias("text")).mapInArrow(distinct, "blob string, text binary")
    return local.dropDuplicates(["blob"])


def findings(paths: DataFrame, known: DataFrame, version: str) -> DataFrame:
    """``paths`` (with ``blob``) with the ``spans`` of their blobs at a rule version; NULL where a blob was never scanned.

    Of the ledger only rows of these blobs are grouped, whatever its history. The
    findings, a small part of the texts' size, become a table of their own first,
    so that a content under very many paths is a skewed join that Spark can split.
    """
    asked = known.where(F.col("version") == version).join(paths.select("blob").distinct(), "blob", "left_semi")
    own = cut_lineage(asked.groupBy("blob").agg(F.first("spans").alias("spans")))
    return paths.join(own, "blob", "left")


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as text, ``kind:start:end`` joined by commas."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, blob, spans`` for every row of ``docs``: its findings, by way of the ledger at ``path``.

    A NULL text is the empty one. Repeated rows get equal findings, rows are not
    matched by ``doc_id``, so it may be NULL or repeat. An empty table adds
    nothing to the ledger. A text is scanned whole in one task, in time that grows
    with its length. Other columns are not read, whatever their names.
    """
    contents = pick(docs, "doc_id", "text").withColumn("blob", blob_of(F.col("text")))
    version = update(contents, path, rules)
    return findings(cut_lineage(contents.select("doc_id", "blob")), ledger(docs.sparkSession, path), version)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))
    base = tuple(r.kind for r in BASE)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in base], F.sha2(listed(F.col("spans"), base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), "blob",
    )
