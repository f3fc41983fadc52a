"""N-gram Jaccard join: size-banded tiles of shingle sets, bounded by hashed bitmaps, decided by exact intersection.

A set is placed in the tiles of its rarest shingles, as many as make sure that
two similar sets share a tile, and in each in the band of its size; only sets of
the same or the next band can be similar. Inside tiles the bit counts of two
bitmaps bound the overlap from above; what the bound lets pass is decided by
intersecting the sorted sets.

Tiles are worked off in two turns, so that a group of copies never becomes all
its pairs: first every set meets the head of its band, which connects most of a
group; then only sets that are not connected yet meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewarden.functions.digests import row_digest
from tablewarden.llm.common import Placed, Stages, as_bytes, pick, ship_package, table, word_lists
from tablewarden.llm.components import components
from tablewarden.llm.simhash import candidate_pairs, fingerprint_of_bytes, keep_first

#: Words in a shingle, and the similarity of a link as a fraction of whole numbers.
SHINGLE = 4
SIMILARITY = (85, 100)
#: Cells of the table of shingle counts, by leading bits of the hash: its size does not depend on the data.
COUNT_BITS = 18
#: Counts that travel as one row.
COUNTS_PER_ROW = 256
#: Bits of the bitmaps of small sets: 64 bytes.
LEAST_BITS = 512
#: Sets of one tile that meet in one go; larger tiles are dealt into cells.
CELL = 2048

#: Sets whose texts are fetched by a broadcast of their names, 10 MB of them; more are fetched by a join that shuffles.
FEW_SETS = 200_000
#: Odd numbers that spread the hashes of words over those of shingles.
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

_PAIR = ["a", "b"]


def shingles_of(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a text's shingles with A-Z as a-z, sorted, each once; a text of fewer words is one shingle, one without words none.

    Words are hashed once each, and a shingle's hash is made from those of its words in their order.
    """
    parts, tail, digest = [], np.empty(0, np.uint64), xxhash.xxh64_digest
    for words in word_lists(data.lower()):
        of = np.concatenate([tail, np.frombuffer(b"".join([digest(w) for w in words]), np.uint64)])
        if (n := len(of) - shingle + 1) > 0:
            hashes = np.zeros(n, np.uint64)
            for k in range(shingle):
                hashes = hashes * _FACTOR + of[k : k + n]
            parts.append(np.unique(_mixed(hashes)))
            tail = of[n:]
        else:
            tail = of
    if not parts:
        return _mixed(np.frombuffer(xxhash.xxh64_digest(tail.tobytes(), len(tail)), np.uint64)) if tail.size else tail
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return hashes ^ (hashes >> np.uint64(29))


def name_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    raw = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(raw[0]), int(raw[1])


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, set if an odd number of shingles fall on it.

    There are between half as many bits as shingles and as many, but at least
    ``LEAST_BITS``, and always a power of two: the bitmap of twice the size is
    twice as long at most, and folding its halves gives the shorter one.
    """
    bits = max(LEAST_BITS, 1 << max(0, (len(shingles) - 1).bit_length() - 1 if len(shingles) else 0))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to fewer of them."""
    while maps.shape[-1] > words:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def may_link(n: np.ndarray | int, differing: np.ndarray | int, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray | bool:
    """Whether sets with ``n`` shingles together may be similar: differing bits bound the shingles that only one has from below.

    ``overlap <= (n - differing) / 2``, and similar sets have ``overlap >= n * some / (some + whole)``.
    """
    some, whole = similarity
    return (some + whole) * (n - differing) >= 2 * some * n


def linked(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> bool:
    """Exact: the intersection of two sorted sets against their union."""
    some, whole = similarity
    both = np.intersect1d(a, b, assume_unique=True).size
    return both > 0 and whole * both >= some * (len(a) + len(b) - both)


def prefix(n: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    """How many of its shingles, in an order common to all, a set has to be found by."""
    some, whole = similarity
    return n - -(-some * n // whole) + 1


def band(n: Column, similarity: tuple[int, int] = SIMILARITY) -> Column:
    """A number for the size, such that sizes of similar sets have the same number or neighbouring ones."""
    some, whole = similarity
    # a little wider than the ratio, so that rounding never moves two similar sizes two bands apart
    return F.floor(F.log(n.cast("double")) / float(np.log(whole / some) * 1.000001)).cast("long")


def _read(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, print, n, s1, s2, bits`` for each document: name, size and bitmap of its set; and ``part, counts`` once a task.

    ``counts`` says how often the task's shingles fall into each cell of the table of counts.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, print long, n long, s1 long, s2 long, bits binary, part long, counts binary"
    names = ["doc_id", "print", "n", "s1", "s2", "bits", "part", "counts"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(1 << COUNT_BITS, np.int64), None
        for batch in batches:
            kind = batch.schema.field(0).type
            rows, cells = [], []
            for text in batch.column(2):
                own = shingles_of(text.as_py(), shingle)
                rows.append((len(own), *name_of(own), bitmap(own)))
                cells.append(own >> np.uint64(64 - COUNT_BITS))
            n = batch.num_rows
            if n:
                counts += np.bincount(np.concatenate(cells).astype(np.int64), minlength=len(counts))
                sizes, s1, s2, bits = zip(*rows, strict=True)
                longs = [pa.array(c, pa.int64()) for c in (sizes, s1, s2)]
                nothing = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, pa.array(bits, pa.binary()), *nothing], names)
        if kind is not None:
            parts = counts.astype("<u4").reshape(-1, COUNTS_PER_ROW)
            n = len(parts)
            nothing = [pa.nulls(n, kind), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.binary())]
            own = [pa.array(range(n), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, *own], names)

    return docs.select("doc_id", "print", "text").mapInArrow(of, schema)


def _summed_counts(counts: DataFrame) -> np.ndarray:
    """The table of counts over all documents; one number per cell comes to the driver, however many documents there are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(own, "<u4").astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "counts"])

    out = np.zeros(((1 << COUNT_BITS) // COUNTS_PER_ROW, COUNTS_PER_ROW), np.uint64)
    for row in counts.repartition("part").mapInArrow(add, "part long, counts binary").collect():
        out[row.part] = np.frombuffer(row.counts, "<u8")
    return out.reshape(-1)


def count_classes(counts: np.ndarray) -> np.ndarray:
    """0 for cells up to twice the mean count, then one more for each doubling: which shingles are common, at any size of the data."""
    mean = max(1.0, float(counts.mean()))
    return np.where(counts > 2 * mean, np.ceil(np.log2(np.maximum(counts, 1) / mean)), 0).astype(np.uint8)


def _postings(docs: DataFrame, classes: np.ndarray, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """``key, s1, s2, common``: a set under each of its rarest shingles; equal sets of one task once."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, names, many, common = [], [], [], []
            for text in batch.column(0):
                own = shingles_of(text.as_py(), shingle)
                if not own.size or (name := name_of(own)) in seen:
                    continue
                seen.add(name)
                of = classes[(own >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                first = np.lexsort((own, of))[: prefix(len(own), similarity)]
                keys.append(own[first].view(np.int64))
                common.append(of[first] > 0)
                names.append(name)
                many.append(len(first))
            if keys:
                of_set = np.repeat(np.array(names, np.int64), many, axis=0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys)), pa.array(of_set[:, 0]), pa.array(of_set[:, 1]), pa.array(np.concatenate(common)),
                ], ["key", "s1", "s2", "common"])

    return docs.select("text").mapInArrow(post, "key long, s1 long, s2 long, common boolean")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``key, s1, s2, common`` sorted by key and name, each once, those whose key has several sets or is common."""
    held, out = None, False  # the last row so far, and whether its key is known to have several sets
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
        before = 0 if held is None else 1
        rows = rows if held is None else np.concatenate([held, rows])
        if len(rows) == before:
            continue
        rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(1))]
        starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        sizes = np.diff(np.append(starts, len(rows)))
        many = np.repeat(sizes > 1, sizes)
        take = many | (rows[:, 3] > 0)
        if before and out:
            take[: sizes[0]] = True
            take[0] = False  # went out with the batch before
        last_out = bool(take[-1]) or (len(rows) == 1 and out)
        held, out = rows[-1:].copy(), last_out
        if take.any():
            found = rows[take]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(3)], ["key", "s1", "s2"])


def _passes(similarity: tuple[int, int]):
    @F.arrow_udf("boolean")
    def passes(n1: pa.Array, bits1: pa.Array, n2: pa.Array, bits2: pa.Array) -> pa.Array:
        out = []
        for n, a, m, b in zip(n1.to_pylist(), bits1.to_pylist(), n2.to_pylist(), bits2.to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            words = min(len(x), len(y))
            differing = int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum())
            out.append(bool(may_link(n + m, differing, similarity)))
        return pa.array(out, pa.bool_())

    return passes


def _with(pairs: DataFrame, sets: DataFrame, end: str) -> DataFrame:
    """What is known of the sets at one end of pairs, under names that begin with it."""
    return pairs.join(sets.withColumnsRenamed({c: end if c == "id" else f"{end}_{c}" for c in sets.columns}), end)


def _verified(stages: Stages, pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose sets are similar, by exact intersection.

    Only texts of sets that are in a pair are fetched, one for each set, and travel compressed.
    """

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.array([pack(t.as_py()) for t in texts], pa.binary())

    @F.arrow_udf("boolean")
    def similar(ones: pa.Array, others: pa.Array) -> pa.Array:
        unpack, held, own, out = zstandard.ZstdDecompressor().decompress, None, None, []
        for one, other in zip(ones.to_pylist(), others.to_pylist(), strict=True):
            if one != held:  # pairs with one first end come one after another
                held, own = one, shingles_of(unpack(one), shingle)
            out.append(linked(own, shingles_of(unpack(other), shingle), similarity))
        return pa.array(out, pa.bool_())

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted, _ = stages.write(sets.join(ends, "id").select("id", "first.doc_id", "first.print"))
    if wanted.count() <= FEW_SETS:
        wanted = F.broadcast(wanted)
    left, right = docs.select("doc_id", "print", packed("text").alias("text")).alias("l"), wanted.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.print") == F.col("r.print"))
    texts, _ = stages.write(left.join(right, same).select("r.id", "l.text").dropDuplicates(["id"]))
    both = _with(_with(pairs, texts, "a"), texts, "b")
    return both.where(similar("b_text", "a_text")).select(*_PAIR)


def _cells(members: DataFrame) -> DataFrame:
    """Deals the sets of large tiles into cells of two chunks each, in which every two of them meet."""
    large = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("long").alias("chunks")).where("chunks > 1")
    chunk = F.pmod(F.xxhash64("id", "key"), F.col("chunks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: j != F.col("chunk"))
    cells = F.transform(others, lambda j: F.least(j, F.col("chunk")) * F.col("chunks") + F.greatest(j, F.col("chunk")))
    return (
        members.join(large, "key", "left").withColumn("chunk", F.when(F.col("chunks").isNotNull(), chunk))
        .withColumn("cell", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells)))
        .select("key", "cell", "id", "root")
    )


def meet(n: np.ndarray, maps: list[np.ndarray], groups: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Places of the pairs of a tile, ordered by size, that are of different groups and may be similar."""
    some, whole = similarity
    found = []
    widths = np.array([len(m) for m in maps])
    folded: dict[int, np.ndarray] = {}
    for words in np.unique(widths):  # similar sizes differ by one doubling at most
        of = np.flatnonzero((widths == words) | (widths == 2 * words))
        folded[int(words)] = np.zeros((len(maps), words), np.uint64)
        for k in of:
            folded[int(words)][k] = fold(maps[k], int(words))
    for i in range(len(n)):
        end = int(np.searchsorted(n, n[i] * whole // some, "right"))
        if end <= i + 1:
            continue
        others = np.arange(i + 1, end)
        others = others[groups[others] != groups[i]]
        if not others.size:
            continue
        rows = folded[int(widths[i])]
        differing = np.bitwise_count(rows[others] ^ rows[i]).sum(1, dtype=np.int64)
        found.extend((i, int(j)) for j in others[may_link(n[i] + n[others], differing, similarity)])
    return found


def _meeting(similarity: tuple[int, int]):
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: list) -> pa.RecordBatch:
            ends = np.array(pairs, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k])) for k in range(2)], _PAIR)

        def work(rows: list[tuple]) -> list:
            ids, sizes, maps, roots = (list(c) for c in zip(*[r[2:] for r in rows], strict=True))
            groups = np.array(roots, np.int64)
            if (groups == groups[0]).all():
                return []
            pairs = meet(np.array(sizes, np.int64), [np.frombuffer(m, np.uint64) for m in maps], groups, similarity)
            return [(max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in pairs]

        held, found = [], []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][:2] != row[:2]:
                    found += work(held)
                    held = []
                held.append(row)
            if len(found) > 10_000:
                yield out(found)
                found = []
        if held:
            found += work(held)
        if found:
            yield out(found)

    return tiles


def _near(stages: Stages, docs: DataFrame, sets: DataFrame, shingle: int, distance: int) -> DataFrame:
    """Pairs of sets whose SimHash fingerprints are within the distance, directly or by others; one text stands for a set."""
    prints = docs.select("doc_id", "print", fingerprint_of_bytes(F.col("text"), shingle).alias("fp")).alias("l")
    first = sets.select("id", "first.doc_id", "first.print").alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.print") == F.col("r.print"))
    return candidate_pairs(stages, prints.join(first, same).select("r.id", "l.fp").dropDuplicates(["id"]), distance)


def _classes(
    stages: Stages, docs: DataFrame, shingle: int, similarity: tuple[int, int], distance: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Of ``doc_id, print, text``: each row's ``doc_id, print, n, s1, s2``, and each set's ``s1, s2, first`` of all it is linked with.

    ``first`` has the smallest ``doc_id``, then the smallest ``print``; ids before NULL.
    With ``distance``, sets whose SimHash fingerprints differ in so many bits are
    verified first, and the tiles link what these have left apart.
    """
    read, _ = stages.write(_read(docs, shingle))
    rows = read.where("part IS NULL").select("doc_id", "print", "n", "s1", "s2", "bits")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first")
    sets = rows.where("n > 0").groupBy("s1", "s2").agg(first, F.first("n").alias("n"), F.first("bits").alias("bits"))
    # a number for each set, as one attempt of each task wrote it
    sets, _ = stages.write(sets.withColumn("id", F.monotonically_increasing_id()))
    sized = sets.select("id", "n", "bits")

    classes = count_classes(_summed_counts(read.where("part IS NOT NULL").select("part", "counts")))
    postings = _postings(docs, classes, shingle, similarity)
    # keys of common shingles are dealt by set, as all of them are kept
    dealt = postings.repartition("key", F.when(F.col("common"), F.col("s1"))).sortWithinPartitions("key", "s1", "s2")
    shared = dealt.mapInArrow(_shared, "key long, s1 long, s2 long")
    of_band = sets.select("s1", "s2", "id", "n", band(F.col("n"), similarity).alias("band"))
    share = F.count(F.lit(1)).over(Window.partitionBy("s1", "s2")) / F.col("n")
    shared, _ = stages.write(shared.join(of_band, ["s1", "s2"]).select("key", "id", "band", share.alias("share")))
    # of tiles with the same sets, such as those of one passage, one is enough
    hashes = [F.bit_xor(F.xxhash64(F.lit(salt), "id")).alias(salt) for salt in ("x", "y")]
    content = shared.groupBy("key").agg(F.count(F.lit(1)).alias("many"), *hashes).where("many > 1")
    one = content.groupBy("many", "x", "y").agg(F.min("key").alias("key")).select("key")
    tiles, _ = stages.write(shared.join(one, "key"))

    # The head of each band of a tile meets the sets of its band and of the next one. It is the set that shares most of
    # its shingles with any other: in a group of copies the one that was changed least.
    heads = tiles.groupBy("key", "band").agg(F.max(F.struct("share", "id"))["id"].alias("head")).withColumn("of", F.col("band"))
    heads = heads.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    tiles = tiles.drop("share")
    met = tiles.join(heads, ["key", "band"]).where("id <> head")
    # of each band a set meets the one it shares most tiles with; all others wait for the second turn
    tally = met.groupBy("id", "of", "head").agg(F.count(F.lit(1)).alias("tiles"))
    star = tally.groupBy("id", "of").agg(F.max(F.struct("tiles", "head"))["head"].alias("head"))
    star = star.select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")).distinct()
    bound = _passes(similarity)("a_n", "a_bits", "b_n", "b_bits")
    tried = found = None
    if distance is not None:
        near = _near(stages, docs, sets, shingle, distance)
        tried, _ = stages.write(_with(_with(near, sized, "a"), sized, "b").where(bound).select(*_PAIR))
        found, _ = stages.write(_verified(stages, tried, sets, docs, shingle, similarity))
        groups, _ = stages.write(components(found).withColumnRenamed("node", "id"))
        for end in _PAIR:
            star = star.join(groups.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
        star = star.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select(*_PAIR).join(tried, _PAIR, "left_anti")
    star, _ = stages.write(_with(_with(star, sized, "a"), sized, "b").where(bound).select(*_PAIR))
    linked_by_star, _ = stages.write(_verified(stages, star, sets, docs, shingle, similarity))
    found = linked_by_star if found is None else found.unionAll(linked_by_star)
    tried = star if tried is None else tried.unionAll(star)
    groups, _ = stages.write(components(found).withColumnRenamed("node", "id"))

    # sets that share a tile with one of another group in their own band or beside it
    members = tiles.join(groups, "id", "left").select("key", "band", "id", F.coalesce("root", "id").alias("root"))
    members, _ = stages.write(members)
    bands = members.groupBy("key", "band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    around = bands.select("key", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "low", "high")
    split = around.groupBy("key", "band").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("key", "band")
    members = members.join(split, ["key", "band"]).select("key", "id", "root")
    dealt = _cells(members).join(sized, "id").select("key", "cell", "id", "n", "bits", "root")
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", "n", "id")
    rest = dealt.mapInArrow(_meeting(similarity), "a long, b long").distinct().join(tried, _PAIR, "left_anti")
    rest, _ = stages.write(rest)
    if not rest.isEmpty():
        more, _ = stages.write(_verified(stages, rest, sets, docs, shingle, similarity))
        groups, _ = stages.write(components(found.unionAll(more)).withColumnRenamed("node", "id"))

    by_root = sets.join(groups, "id")
    linked_first = by_root.groupBy("root").agg(F.min("first").alias("linked"))
    linked_first = by_root.join(linked_first, "root").select("id", "linked")
    # as a table of its own, so that a set many rows share is a skewed join that Spark can split
    classes_of, _ = stages.write(sets.join(linked_first, "id", "left").select("s1", "s2", F.coalesce("linked", "first").alias("first")))
    return rows.drop("bits"), classes_of


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``, which has ``doc_id, text``.

    A document's set is its distinct ``shingle``-word shingles, A-Z as a-z; a
    text with fewer words is one shingle. Two documents are linked if the
    Jaccard similarity of their sets is at least ``similarity``;
    ``component_id`` is the smallest ``doc_id`` that links lead to. A text that
    is NULL, empty or without words has no set and is linked with nothing. Rows
    that repeat an id or a text each come back; a NULL id is never the smallest
    one and a group with no other has a NULL component. An empty table gives no
    rows. Texts of any length are read whole, in parts; extra columns are not
    read, whatever their names.

    Equal sets are one, by 128 bits. Shingles are compared by 64 bits. No pair
    at or above the similarity is lost: two such sets share one of their
    rarest shingles, and only the bound, which never underestimates, and the
    exact test leave pairs out.

    A common shingle never makes a large tile of unlike sets: shingles are
    ordered by how often their hash cell was counted over all documents, so a
    common one is only used by sets that have little else. A tile of any
    size is first joined with one set of each band, a join Spark can split;
    sets left in several groups meet in cells of at most 4,096.
    """
    spark = docs.sparkSession
    ship_package(spark)
    raw = pick(docs, "doc_id", "text")
    docs = raw.select("doc_id", F.xxhash64("text").alias("print"), as_bytes(F.col("text")).alias("text"))
    rows, sets = _classes(Stages(spark, "jaccard"), docs, shingle, similarity)
    named = rows.where("n > 0").join(sets, ["s1", "s2"]).withColumn("component_id", F.col("first.doc_id"))
    alone = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return named.select(*columns).unionAll(alone.select(*columns))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (4, 5), distance: int = 3) -> DataFrame:
    """The documents of which one stays in each group of near copies: the smallest ``doc_id``, then the smallest row digest.

    Texts within ``distance`` bits of each other's SimHash fingerprints are found
    by its byte-position index and verified by exact intersection; what these
    leave apart, as most pairs near 0.8, goes on to the tiles. Groups are those of :func:`jaccard_groups`; texts without words are copies of
    one another here. Rows with a NULL ``doc_id`` come last in their group, of
    rows that are equal in all columns one stays, and all columns come back
    unchanged, whatever their names. An empty table stays empty.
    """
    ship_package(docs.sparkSession)
    placed = Placed(docs)
    texts = placed.df.select(
        placed.col("doc_id").alias("doc_id"), row_digest(list(placed.df.schema.fields)).alias("print"), as_bytes(placed.col("text")).alias("text")
    )
    rows, sets = _classes(Stages(docs.sparkSession, "near-copies"), texts, shingle, similarity, distance)
    wordless = rows.where("n = 0").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first")).where("first IS NOT NULL")
    stay = sets.select("first").distinct().unionAll(wordless)
    return keep_first(placed, stay.select(F.struct("first.doc_id", F.col("first.print").alias("digest")).alias("first")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and all that links reach: for tables of some thousand documents.
SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
    ), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
    ), r(doc_id, node) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node)
    SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(node) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
