"""Benchmark decontamination with a generalised suffix automaton of the items' words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewarden.llm.common import Placed, as_bytes, pick, ship_package, table
from tablewarden.runtime import cut_lineage

#: Letters, digits and everything beyond ASCII; texts are lower-cased before.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of benchmark items in one automaton; more items make more automata, used one after the other.
BLOCK_WORDS = 1_000_000
#: Bytes of a document that are taken apart at a time.
PIECE = 1 << 20

FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<bigint>>"
_FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.int64())),
])


class Automaton:
    """All substrings of some word sequences; a state stands for substrings that end at the same places.

    States are numbers and their properties are flat arrays: most of them lead
    to one state only, which is kept in ``word`` and ``target``; ``many`` has what
    else the others lead to. ``place`` is the place of a state among those that
    hold a ``window``-word substring, whose items are ``window_items`` from
    ``window_at`` on. ``own`` maps a state to the items that are shorter than a
    window and are what it holds, with their lengths, and ``nearest`` is the next
    such state among a state and its suffixes.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.word, self.target = array("i", [-1]), array("i", [-1])
        self.many: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.items: list[object] = []
        coded = []
        for item, words in items:
            ids = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
            if ids:
                coded.append(ids)
                self.items.append(item)
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min([window, *map(len, coded)])
        self._mark(coded)

    def _next(self, state: int, c: int) -> int:
        """The state that a word leads to, or -1."""
        if self.word[state] == c:
            return self.target[state]
        return self.many[state].get(c, -1) if state in self.many else -1

    def _lead(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.target[state] = c, to
        else:
            self.many.setdefault(state, {})[c] = to

    def _state(self, link: int, length: int) -> int:
        self.word.append(-1)
        self.target.append(-1)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state of its own for what is reached from ``p`` by ``c``, the shorter strings of ``q``."""
        copy = self._state(self.link[q], self.length[p] + 1)
        self.word[copy], self.target[copy] = self.word[q], self.target[q]
        if q in self.many:
            self.many[copy] = dict(self.many[q])
        while p >= 0 and self._next(p, c) == q:
            self._lead(p, c, copy)
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        known = self._next(last, c)
        if known >= 0:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, c)
        new = self._state(0, self.length[last] + 1)
        p = last
        while p >= 0 and (q := self._next(p, c)) < 0:
            self._lead(p, c, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _holder(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _mark(self, coded: list[array]) -> None:
        states, numbers = array("i"), array("i")
        self.own: dict[int, list[tuple[int, object]]] = {}
        for n, ids in enumerate(coded):
            state = 0
            for at, c in enumerate(ids, 1):
                state = self._next(state, c)
                if at >= self.window:
                    states.append(self._holder(state, self.window))
                    numbers.append(n)
            if len(ids) < self.window:
                self.own.setdefault(self._holder(state, len(ids)), []).append((len(ids), self.items[n]))
        pairs = np.unique(np.array(states, np.int64) << 32 | np.array(numbers, np.int64))
        held, first = np.unique(pairs >> 32, return_index=True)
        place = np.full(len(self.link), -1, np.int32)
        place[held] = np.arange(len(held))
        self.place = array("i", place.tobytes())
        self.window_at = np.append(first, len(pairs)).astype(np.int32)
        self.window_items = (pairs & 0xFFFFFFFF).astype(np.int32)
        self.nearest = array("i", [-1]) * len(self.link)
        if self.own:
            for s in np.argsort(np.array(self.length), kind="stable")[1:].tolist():
                self.nearest[s] = s if s in self.own else self.nearest[self.link[s]]

    def scan(self, words: Iterator[list[bytes]]) -> tuple[int, list[list[int]], set]:
        """The number of words, the merged spans of words in occurrences, the items that occur.

        Matching states are tracked along the words. A word of no item ends
        every match, so runs of known words that are shorter than any window
        are passed over. What a window needs of the list before is carried over.
        """
        spans: list[list[int]] = []
        items: set = set()
        held: set[int] = set()
        total, carried = 0, np.empty(0, np.int64)
        unknown = [-1]
        for batch in words:
            ids = np.fromiter(map(self.vocabulary.get, batch, unknown * len(batch)), np.int64, len(batch))
            ids, at = np.concatenate((carried, ids)), total - len(carried)
            borders = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
            carried = carried[:0]
            for start, end in borders.reshape(-1, 2).tolist():
                if end - start >= self.shortest:
                    self._track(ids[start:end].tolist(), at + start, spans, items, held)
                if end == len(ids):
                    carried = ids[max(start, end - self.window + 1) : end]
            total += len(batch)
        for p in held:
            items.update(self.items[k] for k in self.window_items[self.window_at[p] : self.window_at[p + 1]])
        return total, merged(spans), items

    def _track(self, run: list[int], at: int, spans: list[list[int]], items: set, held: set[int]) -> None:
        state = matched = 0
        word, target, many, link, length, window = self.word, self.target, self.many, self.link, self.length, self.window
        for i, c in enumerate(run, at + 1):
            while True:
                if word[state] == c:
                    state = target[state]
                    matched += 1
                    break
                if (to := many[state].get(c, -1) if state in many else -1) >= 0:
                    state = to
                    matched += 1
                    break
                if not state:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            reach = 0
            if matched >= window:
                reach = window
                held.add(self.place[self._holder(state, window)])
            short = self.nearest[state]
            while short >= 0:
                for n, item in self.own[short]:
                    if n <= matched:
                        reach = max(reach, n)
                        items.add(item)
                short = self.nearest[link[short]]
            if reach:
                if spans and spans[-1][0] <= i - reach <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], i)
                else:
                    spans.append([i - reach, i])


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, list by list."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            while end < len(data) and _WORDS.match(data, end, end + 1):
                end += 1
        yield _WORDS.findall(data, at, end)
        at = end


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in lists of about ``limit`` words."""
    size = F.length("text")
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // (limit * 6)))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r.item_id, _WORDS.findall(r.text.encode().lower())) for r in own.toLocalIterator()]
        # an empty block still counts the words of the documents
        if rows or not b:
            yield rows


def _scanner(shared: Broadcast) -> Column:
    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array, known: pa.Array) -> pa.Array:
        automaton: Automaton = shared.value
        out = []
        for text, before in zip(texts, known, strict=True):
            n, spans, items = automaton.scan(_pieces(text.as_py().lower()))
            before = before.as_py()
            spans = merged(spans + [[s["start"], s["end"]] for s in before["spans"]])
            items = sorted((items | set(before["items"])) - {None})
            out.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": items})
        return pa.array(out, _FOUND_ARROW)

    return scan


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items, spans``: what of the benchmark each document holds.

    ``docs`` has the column ``text``, ``benchmark`` has ``item_id`` and
    ``text``. A window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window. ``items`` are the ids of the items
    of which a window occurs, ``spans`` the merged places ``[start, end)`` in
    words, ``n_hit`` the words in them.

    Only the benchmark goes through the driver, in blocks of about
    ``block_words`` words: one automaton is broadcast at a time, and where there
    are several the documents are written in between with what was found so far.
    NULL texts have no words. Items without text are passed over, an item
    without id hits but is not listed, repeated items are one, and an empty
    benchmark finds nothing.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = pick(benchmark, "item_id", "text").where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    nothing = "named_struct('n_words', 0L, 'spans', array(), 'items', array())"
    done = docs.withColumn("__found", F.expr(nothing).cast(FOUND))
    for n, rows in enumerate(_blocks(items, block_words)):
        if n:
            done = cut_lineage(done)
        shared = spark.sparkContext.broadcast(Automaton(rows, window))
        done = done.withColumn("__found", _scanner(shared)(as_bytes(F.col("text")), F.col("__found")))
    found = F.col("__found")
    lengths = F.transform(found["spans"], lambda s: s["end"] - s["start"])
    return done.select(
        *docs.columns, found["n_words"].alias("n_words"),
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_hit"),
        found["items"].alias("items"), found["spans"].alias("spans"),
    )


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the words of the spans; what stands between words stays."""
    out = []
    for text, found in zip(texts, spans, strict=True):
        data, found = text.as_py(), found.as_py()
        if data is None or not found:
            out.append(data)
            continue
        raw = data.encode()
        places = [m.span() for m in _WORDS.finditer(raw.lower())]
        kept, at = [], 0
        for s in found:
            start, end = places[s["start"]][0], places[s["end"] - 1][1]
            if start > at:
                kept.append(raw[at:start])
            at = max(at, end)
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pa.array(out, pa.string())


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.0,
) -> DataFrame:
    """The documents without benchmark passages; all columns stay.

    A document of whose words more than the share ``max_coverage`` are hit is
    left out; with 0, any document with a hit is. Of the others the hit words
    are cut out of the text, and ``n_chars`` is counted anew where there is such
    a column. Documents without hits are unchanged, NULL texts stay NULL.
    """
    placed = Placed(docs)
    named = placed.df.withColumn("text", placed.col("text"))
    found = occurrences(named, benchmark, window)
    small = found.where(F.col("n_hit") <= F.col("n_words") * F.lit(float(max_coverage)))
    cut = F.arrow_udf(_without, "string")(F.col("text"), F.col("spans")) if max_coverage > 0 else F.col("text")
    kept = small.withColumn(placed.place("text"), cut)
    if "n_chars" in placed.names and max_coverage > 0:
        chars = placed.place("n_chars")
        kind = placed.df.schema[chars].dataType
        kept = kept.withColumn(chars, F.when(F.size("items") > 0, F.length(placed.col("text")).cast(kind)).otherwise(F.col(chars)))
    return placed.restore(kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = occurrences(docs, pick(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
