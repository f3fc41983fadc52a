"""Substring dedup by relative Lempel-Ziv parsing against the corpus itself.

A reference block is what one task reads at a time, a few MB of documents. It
is indexed by its seeds, the hashes of all its windows of ``window`` words, each
with its place in the smallest document of the block that holds it. The indexes
of all blocks are dealt by hash range, so a seed meets the seeds of every
reference block, and what comes back to a document are its seeds that a smaller
document holds, with that document and the word at which they stand there.

The document is then parsed greedily. A factor starts at such a seed and runs on
while the following ones stand in the same row of the corpus, one word further
each, so the words of a factor stand in one piece in its reference. Seeds across
the boundary of a factor have been looked up like any other: where only another
reference continues, the next factor overlaps this one, and where the next seed of
the same reference and offset is no further than ``window`` words away, the factor
reaches over the boundary. A factor within a longer one is left out. A factor is
``window`` words long at least and becomes a duplicate span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.llm.common import as_bytes, pick, ship_package, table

#: Bytes of text in a reference block, and of text that one bucket of seeds or documents stands for.
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
#: A NULL doc_id counts as larger than any other: its documents are references for nobody.
NO_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, base, np.uint64))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that follow one another in ``data``, and how many words each text has.

    ``starts`` holds where texts begin. A word never goes over the end of its text.
    """
    spaces = _SPACE[data]
    first = ~spaces
    first[1:] &= spaces[:-1]
    at = starts[starts < len(data)]
    first[at] = ~spaces[at]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    inside = np.flatnonzero(~spaces)
    word = np.cumsum(first[inside], dtype=np.int32) - 1
    place = inside - begins[word]
    terms = _BYTE[data[inside]] * _powers(int(place.max()) + 1, _BASE)[place]
    hashes = _mixed(np.add.reduceat(terms, np.flatnonzero(first[inside])))
    ends = np.append(starts[1:], len(data))
    return hashes, np.searchsorted(begins, ends) - np.searchsorted(begins, starts)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """A hash for each window of consecutive words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(_powers(window, _STEP)):
        out += words[k : k + n] * factor
    return _mixed(out)


def seeds(data: bytes, window: int) -> np.ndarray:
    """The seeds of one text, piece by piece, so that a very long text needs little more than its seeds."""
    parts, kept, at = [], np.empty(0, np.uint64), 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words, _ = word_hashes(np.frombuffer(data, np.uint8, end - at, at), np.zeros(1, np.int64))
        words = np.concatenate((kept, words))
        parts.append(window_hashes(words, window))
        kept, at = words[max(0, len(words) - window + 1) :], end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit values, the bytes of each place together, which compresses well where values are sorted."""
    return b"".join(_planes(c) for c in columns)


def _planes(column: np.ndarray) -> bytes:
    return np.ascontiguousarray(column.view(np.uint8).reshape(-1, column.itemsize).T).tobytes()


def _unplanes(data: bytes, kind: type, count: int, offset: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8, count * size, offset).reshape(size, count)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    n = len(data) // (8 * columns)
    return [_unplanes(data, np.uint64, n, 8 * n * k) for k in range(columns)]


def _steps(column: np.ndarray) -> np.ndarray:
    return np.diff(column, prepend=np.zeros(1, column.dtype))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Even buckets by the leading bits of a hash."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(_mixed(docs.view(np.uint64) + _BASE), buckets)


def _split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    borders = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        yield int(bucket[a]), [c[a:b] for c in columns]


def _hits(seed: np.ndarray, doc: np.ndarray, refs: tuple[np.ndarray, ...], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Seeds of documents that a smaller document holds, with document, row and word there, dealt by document."""
    owner, row, word = refs
    order = np.lexsort((word, row, owner, doc))
    columns = (a[order] for a in (seed, doc, owner, row, word))
    for bucket, (s, d, o, r, w) in _split(_doc_bucket(doc[order], buckets), *columns):
        # words ascend within a reference, so steps from one to the next compress well
        yield 1, bucket, _pack(d.view(np.uint64), s, o.view(np.uint64), r, _steps(w.astype(np.int64)).view(np.uint64))


def _owners(seed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pair of seed and document stands first, in order of both, and where its smallest document holds the seed."""
    at = np.lexsort((doc, seed))
    s, d = seed[at], doc[at]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at, s = at[new], s[new]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    return at, at[np.flatnonzero(first)][np.cumsum(first) - 1]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, payloads = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(buckets, pa.int64()), pa.array(payloads, pa.binary())],
        ["kind", "bucket", "payload"],
    )


def _index_blocks(window: int, buckets: int, block_bytes: int):
    """Texts to the index of their reference block, and to the seeds that the block itself shows as repeated."""

    def of_block(ids: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        data = b"".join(texts) if len(texts) > 1 else texts[0]
        # rows of the corpus are told apart by their block and their first word in it
        block = np.uint64(xxhash.xxh3_64_intdigest(data))
        if len(texts) == 1:
            found, starts = seeds(data, window), np.zeros(1, np.uint32)
            word, row = np.arange(len(found), dtype=np.uint32), np.zeros(len(found), np.uint32)
        else:
            words, counts = word_hashes(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)])[:-1])
            found = window_hashes(words, window)
            starts = (np.cumsum(counts) - counts).astype(np.uint32)
            row_of = np.repeat(np.arange(len(texts), dtype=np.uint32), counts)
            last = row_of[window - 1 :]
            word = np.flatnonzero(row_of[: len(last)] == last).astype(np.uint32)
            found, row = found[word], last[word]
        if not len(found):
            return
        names = np.array(ids, np.int64)
        at, lead = _owners(found, names[row])
        repeated = names[row[at]] > names[row[lead]]
        rows = []
        if repeated.any():
            to, of = at[repeated], lead[repeated]
            refs = names[row[of]], block + starts[row[of]], word[of] - starts[row[of]]
            rows += _hits(found[to], names[row[to]], refs, buckets)
        # in order of the text, where the steps between words are small
        at = np.sort(at[~repeated])
        for bucket, (s, r, w) in _split(_bucket(found[at], buckets), found[at], row[at], word[at]):
            # rows as places in a short list, known by their first words
            own = np.unique(r)
            head = np.array([block, len(own)], np.uint64).tobytes()
            rows.append((0, bucket, head + _pack(_steps(names[own]), _steps(starts[own]), _steps(w), s)))
        yield _rows(rows)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                data, doc = text.as_py(), doc.as_py()
                if len(data) >= block_bytes:  # a block of its own, read piece by piece
                    yield from of_block([NO_ID if doc is None else doc], [data])
                    continue
                ids.append(NO_ID if doc is None else doc)
                texts.append(data)
                size += len(data)
                if size >= block_bytes:
                    yield from of_block(ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield from of_block(ids, texts)

    return index


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Iterator]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _match_seeds(buckets: int):
    """The indexes of all blocks, one bucket of seeds at a time, to the seeds whose smallest document is another one."""

    def settle(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        names, tags, starts, rows, words, found, known = [], [], [], [], [], [], 0
        for part in sorted(parts):
            block, n = np.frombuffer(part, np.uint64, 2)
            n = int(n)
            names.append(np.cumsum(_unplanes(part, np.int64, n, 16)))
            starts.append(np.cumsum(_unplanes(part, np.uint32, n, 16 + 8 * n), dtype=np.uint32))
            tags.append(block + starts[-1])
            at = 16 + 12 * n
            count = (len(part) - at) // 12
            word = np.cumsum(_unplanes(part, np.uint32, count, at), dtype=np.uint32)
            rows.append((np.searchsorted(starts[-1], word, "right") + (known - 1)).astype(np.uint32))
            words.append(word)
            found.append(_unplanes(part, np.uint64, count, at + 4 * count))
            known += n
        name, tag, start, row, word, seed = (np.concatenate(a) for a in (names, tags, starts, rows, words, found))
        at, lead = _owners(seed, name[row])
        repeated = name[row[at]] > name[row[lead]]
        if repeated.any():
            to, of = at[repeated], lead[repeated]
            refs = name[row[of]], tag[row[of]], word[of] - start[row[of]]
            yield _rows(list(_hits(seed[to], name[row[to]], refs, buckets)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        now = None
        for kind, bucket, payload in _by_bucket(batches):
            if kind:
                yield _rows([(kind, bucket, payload)])
                continue
            if bucket != now and parts:
                yield from settle(parts)
                parts = []
            now = bucket
            parts.append(payload)
        if parts:
            yield from settle(parts)

    return match


def factors(at: np.ndarray, refs: tuple[np.ndarray, ...], window: int) -> list[tuple[int, int, int, int]]:
    """``(first word, length, reference document, first word there)`` of a greedy parse.

    ``at`` are the words where found seeds start, ascending; ``refs`` the document,
    the row and the word where each stands in its reference.
    """
    if not len(at):
        return []
    owner, row, word = refs
    offset = word - at
    order = np.lexsort((at, offset, row, owner))
    at, owner, row, word, offset = (a[order] for a in (at, owner, row, word, offset))
    new = np.ones(len(at), bool)
    # two windows at one offset that touch stand in one piece in the reference
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]) | (offset[1:] != offset[:-1]) | (np.diff(at) > window)
    first = np.flatnonzero(new)
    start, end = at[first], at[np.append(first[1:], len(at)) - 1] + window
    order = np.lexsort((-end, start))
    first, start, end = first[order], start[order], end[order]
    longest = np.maximum.accumulate(end)
    kept = np.ones(len(end), bool)
    kept[1:] = end[1:] > longest[:-1]
    return [
        (int(s), int(e - s), int(owner[f]), int(word[f])) for f, s, e in zip(first[kept], start[kept], end[kept], strict=True)
    ]


def _parse(data: bytes, doc: int, hits: tuple[np.ndarray, ...], window: int) -> tuple[int, int, bytes, list]:
    """Words, removed words, the kept words, the factors."""
    words = data.split()
    low, high = np.searchsorted(hits[0], [doc, doc + 1] if doc < NO_ID else [doc, doc])
    if doc == NO_ID:
        high = len(hits[0])
    if low == high or len(words) < window:
        return len(words), 0, b" ".join(words), []
    own = hits[1][low:high]
    found = seeds(data, window)
    place = np.minimum(np.searchsorted(own, found), len(own) - 1)
    at = np.flatnonzero(own[place] == found)
    parsed = factors(at, tuple(h[low + place[at]] for h in hits[2:]), window)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, _, _ in parsed:
        edges[start] += 1
        edges[start + length] -= 1
    kept = np.cumsum(edges[:-1]) == 0
    return len(words), int(len(words) - kept.sum()), b" ".join(compress(words, kept.tolist())), parsed


def _sorted_hits(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """Document, seed, and document, row and word of the reference, in order of the first two."""
    parts = [_unpack(p, 5) for p in payloads]
    found = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64) for i in range(4)]
    words = [np.cumsum(p[4].view(np.int64)) for p in parts]
    docs, seed, owner, row = found[0].view(np.int64), found[1], found[2].view(np.int64), found[3]
    order = np.lexsort((seed, docs))
    return docs[order], seed[order], owner[order], row[order], (np.concatenate(words) if words else np.empty(0, np.int64))[order]


_RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
    ("factors", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "reference", "reference_start")]))),
])


def _deal_texts(buckets: int):
    """Documents by the bucket of their id, the text compressed for the way."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column(0)
            known = ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                pa.array(_doc_bucket(known, buckets)), pa.array([2] * len(ids), pa.int32()), pa.nulls(len(ids), pa.binary()), ids,
                pa.array([pack(t.as_py()) for t in batch.column(1)], pa.binary()),
            ], ["bucket", "kind", "payload", "doc_id", "text"])

    return deal


def _parse_documents(window: int, digest: bool):
    """Documents and their hits, bucket by bucket, to the parsed documents."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, payloads, hits = None, [], None
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, kept, n_words, n_removed, spans = [], [], [], [], []
            for bucket, kind, payload, doc, text in _by_bucket([batch]):
                if bucket != now:
                    now, payloads, hits = bucket, [], None
                if kind == 1:
                    payloads.append(payload)
                    continue
                if hits is None:
                    hits, payloads = _sorted_hits(payloads), []
                n, removed, left, parsed = _parse(unpack(text), NO_ID if doc is None else doc, hits, window)
                ids.append(doc)
                n_words.append(n)
                n_removed.append(removed)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
                spans.append([{"start": s, "length": k, "reference": r, "reference_start": w} for s, k, r, w in parsed])
            if ids:
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()), pa.array(spans, _RESULT.field("factors").type),
                ], ["doc_id", "n_words", "n_removed", "kept", "factors"])

    return parse


def deduplicate(docs: DataFrame, window: int = 13, digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, factors`` for every row of ``docs`` (``doc_id, text``).

    A word is removed if a window of ``window`` words that covers it also starts
    in a document with a smaller ``doc_id``, judged on the input. ``kept`` is the
    text that stays, words joined by one space, or with ``digest`` its SHA-256 in
    hex. ``factors`` are the duplicate spans: ``length`` words from ``start`` on,
    which stand in one piece in the document ``reference`` from ``reference_start``
    on. A seed comes with one place, the first in the smallest document of its own
    block or, where its block has no smaller one, of all blocks.

    A NULL text has no words, an empty one neither. Texts of any length are read
    piece by piece. Rows with one ``doc_id`` do not count against one another; as
    references they are told apart, and a factor stands in one of them. A NULL
    ``doc_id`` is larger than any other, and such rows do not count against one
    another either. Windows are compared by 64-bit hashes. Repeated rows come back
    as often as they come; an empty table gives no rows; other columns are not
    read, whatever their names.

    Shuffled are the seeds, about 8 bytes a word, once; the repeated seeds; and
    the texts, once. A passage that many documents share is one entry per block,
    not per document, and a group of copies costs what its documents cost. The
    number of buckets grows with the bytes of text, so a bucket does not.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes(F.col("text")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, 1 << max(0, (int(total) // BUCKET_BYTES - 1)).bit_length())
    index = texts.mapInArrow(_index_blocks(window, buckets, BLOCK_BYTES), "kind int, bucket long, payload binary")
    dealt = index.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    hits = dealt.mapInArrow(_match_seeds(buckets), "kind int, bucket long, payload binary")
    nothing = F.lit(None)

    both = hits.select("bucket", "kind", "payload", nothing.cast("long").alias("doc_id"), nothing.cast("binary").alias("text"))
    own = texts.mapInArrow(_deal_texts(buckets), "bucket long, kind int, payload binary, doc_id long, text binary")
    together = both.unionAll(own).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return together.mapInArrow(
        _parse_documents(window, digest),
        "doc_id long, n_words long, n_removed long, kept string, "
        "factors array<struct<start:bigint,length:bigint,reference:bigint,reference_start:bigint>>",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"), 13, digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
