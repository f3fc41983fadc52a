"""Token ids in binary files: documents compressed one by one with a shared zstandard dictionary.

A data set is a folder:

* ``dictionary/`` a Parquet table of one row: the dictionary, its SHA-256, the
  bytes per id and the tokenizer's SHA-256;
* ``data/<name>.tok`` the documents in ascending order, each a frame of its own:
  header ``TOKZ1``, bytes per id, SHA-256 of the dictionary; the frames; the
  offset index; the length of the index and ``TOKZ``. The index has a row of
  four 64-bit numbers per document: id, offset, length of the frame, tokens;
* ``files/`` a Parquet table with a row per file that counts: name, order, first
  document, documents, tokens.

All numbers are little-endian. A file's name holds a random part, so a task that
runs twice writes two files, and only the one whose task Spark commits is listed
in ``files``; the other is not part of the data set. A short document is read
with two small reads of its file: the end of the index and the frame.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tablewarden.llm.common import as_bytes, pick, ship_package, table, word_lists
from tablewarden.runtime import scratch_path

MAGIC, END = b"TOKZ1", b"TOKZ"
HEAD = len(MAGIC) + 1 + 32
#: The dictionary is trained on the token ids of this many documents, of each at most so many bytes.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16_384, 65_536
#: Words whose ids a worker remembers have so many bytes of memory, twice as many at most.
RECENT_BYTES = 40 << 20
#: What a word takes in a dictionary besides itself and its ids.
ENTRY_BYTES = 40
#: Texts that are split into words at once have so many bytes, a longer one is split part by part.
GROUP_BYTES = 8 << 20
#: Words that go to the tokenizer in one call, and their letters; a longer word goes alone.
CALL_WORDS, CALL_LETTERS = 256, 1 << 16
#: An id above all others stands for a NULL doc_id, which comes last.
NO_ID = int(np.iinfo(np.int64).max)

#: The letters of byte-level models: printable bytes are themselves, the others follow one another from 256.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_BEYOND_LATIN = chr(0x250)
#: ASCII letters and digits, or Latin letters whose small form is one letter, with full stops and commas after them.
_PLAIN = "^(?:[A-Za-z0-9]+|[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+)[.,]*$"

_ENCODERS: dict[str, Encoder] = {}


class _Recent:
    """A bounded memory: what has not been asked for while new entries of ``size`` bytes came in is forgotten."""

    def __init__(self, size: int):
        self.size, self.used, self.now, self.before = size, 0, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.now.get(key)
        if found is None and (found := self.before.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        own = key.__sizeof__() + value.__sizeof__() + ENTRY_BYTES
        if self.used + own > self.size:
            self.before, self.now, self.used = self.now, {}, 0
        if own <= self.size:
            self.now[key] = value
            self.used += own


def _calls(places: list[int], names: list[str]) -> Iterator[list[int]]:
    """The places in parts, each of few names that are not long together."""
    some, letters = [], 0
    for i in places:
        if some and (len(some) == CALL_WORDS or letters + len(names[i]) > CALL_LETTERS):
            yield some
            some, letters = [], 0
        some.append(i)
        letters += len(names[i])
    if some:
        yield some


class Encoder:
    """Ids of texts by a tokenizer, with the ids of recent words kept.

    Where the tokenizer drops the six ASCII space characters and joins nothing
    over them, which is tried out first, texts are split into words many at a time
    and each different word is encoded once; any other tokenizer gets each text
    whole. Where it treats them so, which is tried out too, words of ASCII or Latin
    letters count without case and without full stops and commas at their end, and
    plain letters go to the tokenizer's model at once, many words in a call if the
    model marks the ends of words.
    """

    def __init__(self, path: str):
        # tasks run side by side already
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        self.recent = _Recent(RECENT_BYTES)
        self.parted = all(
            self.ids(f"{a}{s}{b}{s}{s}{a}{s}") == [*self.ids(a), *self.ids(b), *self.ids(a)] and self.ids(s + a) == self.ids(a)
            for s in " \t\n\v\f\r" for a, b in (("a", "the"), ("New", "York"), ("x.", "(1)"), ("ab12", "é"), ("-", "'s"))
        )
        self.plain = self.parted and all(
            self.ids(w) == self.ids(w.lower()) == self._letters(w.lower())
            and self.ids(f"{w}.,") == [*self.ids(w), *self.ids(".,")] and self.ids(f"{w} {w}") == [*self.ids(w), *self.ids(w)]
            for w in ("a", "Zq", "the", "Tokenization", "xqzjkvbwp", "AAAAaaaaAAAA", "Élève", "größer", "CIÓN", "Łódźž", "ñ", "ªÿ")
        )
        # a space is a letter among these letters, which no word has
        self.speller = Tokenizer(self.model)
        self.speller.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(chr(_BYTE_LETTERS[32]))
        self.last = None
        if suffix := getattr(self.model, "end_of_word_suffix", None):
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[n for token, n in vocabulary.items() if token.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_LETTERS))]

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _spelled(self, words: list[str]) -> list[bytes]:
        """The ids of words of small Latin letters, by the model alone."""
        if self.last is not None:
            letters = " ".join(words).encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = np.array(self.speller.encode_batch_fast([letters], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words):
                data, ends = ids.tobytes(), (ends * self.width).tolist()
                return [data[a:b] for a, b in zip([0, *ends], ends)]
        return [self._packed(self._letters(w)) for w in words]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _known(self, words: pa.Array) -> pa.Array:
        """The ids of words, each different one asked for once."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        found = list(map(self.recent.now.get, names))
        spelled, whole = [], []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            name = names[i]
            found[i] = self.recent.get(name)
            if found[i] is None:
                letters = self.plain and name.isalpha() and name.islower() and (name.isascii() or max(name) < _BEYOND_LATIN)
                (spelled if letters else whole).append(i)
        for places, encode in ((spelled, self._spelled), (whole, self._whole)):
            for some in _calls(places, names):
                for i, ids in zip(some, encode([names[i] for i in some]), strict=True):
                    found[i] = ids
                    self.recent.put(names[i], ids)
        return pa.array(found, pa.binary()).take(coded.indices)

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of words."""
        coded = words.dictionary_encode()
        names = coded.dictionary
        if self.plain:
            # special tokens are known by their very spelling, so no word with other characters is changed
            plain = pc.match_substring_regex(names, _PLAIN)
            cores = pc.utf8_rtrim(names, characters=".,")
            ids = self._known(pc.if_else(plain, pc.utf8_lower(cores), names))
            tailed = pc.and_(plain, pc.less(pc.binary_length(cores), pc.binary_length(names)))
            tails = pc.replace_substring_regex(names.filter(tailed), pattern="^.*[^.,]", replacement="")
            joined = pc.binary_join_element_wise(ids.filter(tailed), self._known(tails), b"")
            ids = pc.replace_with_mask(ids, tailed, joined)
        else:
            ids = self._known(names)
        return ids.take(coded.indices)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, ``width`` bytes each."""
        if not self.parted:
            yield from (self._packed(self.ids(t.as_py().decode())) for t in texts)
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = done = 0
        while at < len(texts):
            to = int(np.searchsorted(ends, done + GROUP_BYTES, "right"))
            if to == at:
                to = at + 1
                lists = word_lists(texts[at].as_py())
                yield b"".join(b"".join(self._words(pa.array(words, pa.binary()).view(pa.string())).to_pylist()) for words in lists)
            else:
                lists = pc.ascii_split_whitespace(texts.slice(at, to - at).cast(pa.binary()).view(pa.string()))
                ids = self._words(lists.flatten())
                places = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                edges = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)[places].tolist()
                data = memoryview(ids.buffers()[2] or b"")
                yield from (bytes(data[a:b]) for a, b in zip(edges, edges[1:]))
                # what is free goes back, as a worker that waits for its next task keeps it otherwise
                del lists, ids, data
                pa.default_memory_pool().release_unused()
            at, done = to, int(ends[to - 1])

    def encode(self, data: bytes) -> bytes:
        """The ids of a text, ``width`` bytes each."""
        return next(self.encode_all(pa.array([data], pa.binary())))


def _tokenizer(path: str) -> tuple[str, bytes]:
    with open(path, "rb") as f:
        return path, hashlib.sha256(f.read()).digest()


def _sample(texts: DataFrame, path: str) -> list[bytes]:
    """Serialised ids of the documents with the smallest hashes, the beginning of each.

    Rows below a hash that about twice as many lie below are sorted, not all.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            texts = pa.array([t.as_py().rpartition(b" ")[0] for t in batch.column(0)], pa.binary())
            ids = [i[:SAMPLE_BYTES] for i in encoder.encode_all(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    # the beginning of a text is enough for a sample, so the sort carries no long texts
    chosen = texts.select(F.substring("text", 1, 4 * SAMPLE_BYTES).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    share = min(1.0, 2 * SAMPLE_DOCUMENTS / max(1, texts.count()))
    below = chosen.where(F.col("h") <= F.lit(min(NO_ID, int(-(1 << 63) + share * (1 << 64)))))
    rows = below.orderBy("h").limit(SAMPLE_DOCUMENTS).select("text").mapInArrow(cut, "ids binary").collect()
    return [bytes(r.ids) for r in rows if len(r.ids) >= 8]


def train_dictionary(texts: DataFrame, path: str) -> bytes:
    """A dictionary from a bounded sample of ids; empty where there is too little to train on."""
    sample = _sample(texts, path)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _frames(dictionary: bytes):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (
        zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=False),
        zstandard.ZstdDecompressor(dict_data=data),
    )


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, documents_per_file: int = 20_000) -> None:
    """Write the ids of all texts, each with ``end_id`` after it, in ascending ``doc_id`` order.

    Rows are dealt to files by range and sorted within, so the files in their
    order hold all documents in order. Rows with one ``doc_id`` are ordered by a
    hash of the text; rows without one come last. A NULL text is an empty one, and
    a repeated row is written as often as it comes. A text of any length is one
    frame, made in one task. An empty table makes a data set without documents.
    Columns other than ``doc_id`` and ``text`` are not read, whatever their names. Only the dictionary's sample,
    bounded by ``SAMPLE_DOCUMENTS`` and ``SAMPLE_BYTES``, goes through the driver.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes(F.col("text")).alias("text"))
    texts = texts.withColumn("tie", F.xxhash64("text"))
    encoder = Encoder.of(tokenizer)
    width, digest = encoder.width, _tokenizer(tokenizer)[1]
    dictionary = train_dictionary(texts, tokenizer)
    head = MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest()
    spark.createDataFrame(
        [(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest(), width, digest.hex())],
        "dictionary binary, sha256 string, width int, tokenizer_sha256 string",
    ).coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    target = f"{path}/data"

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = index = name = None
        encoder = Encoder.of(tokenizer)
        last = np.array([end_id], f"<u{width}").tobytes()
        compress = _frames(shared.value)[0].compress
        store, folder = fs.FileSystem.from_uri(target)
        at = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0), encoder.encode_all(batch.column(1)), strict=True):
                if out is None:
                    store.create_dir(folder)
                    name, index, at = f"{uuid.uuid4().hex}.tok", [], HEAD
                    out = store.open_output_stream(f"{folder}/{name}")
                    out.write(head)
                ids += last
                frame = compress(ids)
                out.write(frame)
                key = doc.as_py()
                index.append((NO_ID if key is None else key, at, len(frame), len(ids) // width))
                at += len(frame)
        if out is not None:
            rows = np.array(index, "<i8")
            out.write(rows.tobytes() + np.array([rows.nbytes], "<i8").tobytes() + END)
            out.close()
            yield pa.RecordBatch.from_arrays([
                pa.array([name]), pa.array([int(rows[0, 0])]), pa.array([len(rows)]), pa.array([int(rows[:, 3].sum())]),
            ], ["name", "first", "documents", "tokens"])

    files = max(1, -(-texts.count() // documents_per_file))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    dealt = texts.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    saved = dealt.mapInArrow(save, "name string, first long, documents long, tokens long")
    # the number of a range partition is the order of its file
    saved.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/files")


def files(spark: SparkSession, path: str) -> DataFrame:
    """``name, part, documents, tokens, start``: the files in order; ``start`` counts the ids in the files before."""
    listed = spark.read.schema("name string, first long, documents long, tokens long, part int").parquet(f"{path}/files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def _open(store: fs.FileSystem, name: str, sha256: bytes) -> tuple[pa.NativeFile, np.ndarray, np.dtype]:
    """An open file, its index, the kind of its ids."""
    file = store.open_input_file(name)
    head = file.read_at(HEAD, 0)
    end = file.read_at(12, file.size() - 12)
    if head[:5] != MAGIC or end[8:] != END:
        raise ValueError(f"{name} is no complete file of token ids")
    if head[6:] != sha256:
        raise ValueError(f"{name} was written with another dictionary")
    size = int(np.frombuffer(end, "<i8", 1)[0])
    index = np.frombuffer(file.read_at(size, file.size() - 12 - size), "<i8").reshape(-1, 4)
    return file, index, np.dtype(f"<u{head[5]}")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` for every document of a data set.

    ``start`` counts the ids of all documents before, ``ids_crc32`` is the CRC-32
    of the ids as unsigned 32-bit numbers. Without ``ids`` these stay where they
    are read. Raises if a file is broken or was written with another dictionary.
    """
    ship_package(spark)
    dictionary = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(dictionary)
    folder = f"{path}/data"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = shared.value
        decompress, sha256 = _frames(dictionary)[1].decompress, hashlib.sha256(dictionary).digest()
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, index, kind = _open(store, f"{base}/{name}", sha256)
                with file:
                    for at in range(0, len(index), 512):
                        rows = index[at : at + 512]
                        first = int(rows[0, 1])
                        block = file.read_at(int(rows[-1, 1] + rows[-1, 2]) - first, first)
                        crcs, lists = [], []
                        for _, offset, length, _ in rows.tolist():
                            raw = decompress(block[offset - first : offset - first + length])
                            wide = np.frombuffer(raw, kind).astype("<u4")
                            crcs.append(zlib.crc32(wide.tobytes()))
                            lists.append(wide.astype(np.int32) if ids else None)
                        starts = start + np.concatenate(([0], np.cumsum(rows[:-1, 3])))
                        start += int(rows[:, 3].sum())
                        keys = pa.array(rows[:, 0], mask=rows[:, 0] == NO_ID)
                        yield pa.RecordBatch.from_arrays([
                            keys, pa.array(starts.astype(np.int64)), pa.array(np.ascontiguousarray(rows[:, 3])),
                            pa.array(crcs, pa.int64()), pa.array(lists, pa.list_(pa.int32())),
                        ], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    listed = files(spark, path).select("name", "start")
    # the list is small; it is dealt out so that files are read side by side
    dealt = listed.repartition(max(1, listed.count()))
    return dealt.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document, of each row with that id: two reads of a file, not the whole of it."""
    dictionary = _dictionary(spark, path)
    store, base = fs.FileSystem.from_uri(f"{path}/data")
    decompress = _frames(dictionary)[1].decompress
    found = []
    ordered = files(spark, path).withColumn("next", F.lead("first").over(Window.orderBy("part")))
    for row in ordered.where((F.col("first") <= doc_id) & (F.coalesce("next", F.lit(NO_ID)) >= doc_id)).collect():
        file, index, kind = _open(store, f"{base}/{row.name}", hashlib.sha256(dictionary).digest())
        with file:
            for _, offset, length, _ in index[index[:, 0] == doc_id].tolist():
                found.append(np.frombuffer(decompress(file.read_at(length, offset)), kind).tolist())
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query needs these files; the operator takes a path

    path = scratch_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
