"""The document operators against brute force on awkward rows, empty tables and clashing names."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import (
    decontaminate, jaccard_join, licenses, mixing, quality, secrets, sharding, simhash, substring, token_files,
)
from tests.llm import data

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return data.frame(spark).repartition(5, "source")


@pytest.fixture(scope="module")
def none(spark):
    return data.frame(spark).limit(0)


@pytest.fixture(scope="module")
def pairs():
    return [r[:2] for r in data.rows()]


def bag(rows):
    return Counter(tuple(r) for r in rows)


def whole(df):
    """All rows, maps as text, by place: names may clash."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return bag(plain.select([F.to_json(c) if t.startswith("map") else F.col(c) for c, t in plain.dtypes]).collect())


# --- token files

def test_token_files(spark, docs, pairs, scratch):
    from tokenizers import Tokenizer

    token_files.write(docs, f"{scratch}/t", TOKENIZER, documents_per_file=7)
    got = token_files.read(spark, f"{scratch}/t").orderBy("start").collect()
    encoder = Tokenizer.from_file(TOKENIZER)
    ids = {t: [*encoder.encode(t or "", add_special_tokens=False).ids, 2] for _, t in pairs}
    assert bag((r.doc_id, tuple(r.ids), r.ids_crc32) for r in got) == bag((i, tuple(ids[t]), data.crc(ids[t])) for i, t in pairs)
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in got][-2:] == [None, None]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert token_files.files(spark, f"{scratch}/t").count() > 3
    assert bag(map(tuple, token_files.lookup(spark, f"{scratch}/t", 94))) == bag(tuple(ids[t]) for i, t in pairs if i == 94)
    assert token_files.lookup(spark, f"{scratch}/t", 12345) == []


def test_words_are_tokens_of_their_own():
    from tokenizers import Tokenizer

    plain, encoder = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER)
    for text in [t for t in data.texts() if t] + ["a<|endoftext|>b <|STARTOFTEXT|>", "don't  I'LL　x", "́ é ͅ"]:
        got = np.frombuffer(encoder.encode(text.encode()), encoder.kind).tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids


def test_different_words_of_many_texts_go_to_the_tokenizer_together(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    letters = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
    texts = [t or "" for t in data.texts()] + ["", letters, *[f"a{c}b {c}, {c}1" for c in letters], "x" * 9000 + " y. " * 3000]
    plain, encoder = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER)
    ids = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    array = pa.array([t.encode() for t in texts], pa.binary())
    for size in (1 << 24, 4096, 1):
        monkeypatch.setattr(token_files, "GROUP_BYTES", size)
        got = list(token_files.Encoder(TOKENIZER).encode_all(array.slice(1)))
        assert [np.frombuffer(g, encoder.kind).tolist() for g in got] == ids[1:]
    calls, spelled = [], encoder._spelled
    monkeypatch.setattr(encoder, "_spelled", lambda words: calls.append(words) or spelled(words))
    monkeypatch.setattr(token_files, "GROUP_BYTES", 1 << 24)
    list(encoder.encode_all(pa.array([b"one two, One", b"two one. three"] * 1000, pa.binary())))
    assert [sorted(c) for c in calls] == [["one", "three", "two"]]


def test_encoding_many_texts_needs_little_memory():
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain, encoder = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER)
    texts = [" ".join(f"Word {i * j % 9973}," for j in range(150)) for i in range(500)]
    ids = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    array = pa.array([t.encode() for t in texts] * 24, pa.binary())
    assert array.nbytes > 16 << 20
    usual = pa.default_memory_pool()
    counted = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(counted)
    try:
        for n, got in enumerate(encoder.encode_all(array)):
            assert got == encoder._packed(ids[n % 500])
    finally:
        pa.set_memory_pool(usual)
    assert n == len(array) - 1 and counted.max_memory() < 48 << 20


def test_long_words_are_not_kept_by_their_number(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "RECENT_BYTES", 100_000)
    plain, encoder = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER)
    words = [("\u4e2d\u6587" if i % 2 else "ab1") * (i % 300 + 1) + str(i) for i in range(600)] + ["\u6587" * 80_000]
    calls, whole = [], encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda some: calls.append(some) or whole(some))
    monkeypatch.setattr(token_files, "CALL_LETTERS", 5_000)
    for _ in range(2):
        got = list(encoder.encode_all(pa.array([w.encode() for w in words], pa.binary())))
        assert got == [encoder._packed(plain.encode(w, add_special_tokens=False).ids) for w in words]
    kept = [*encoder.recent.now.items(), *encoder.recent.before.items()]
    assert 0 < sum(k.__sizeof__() + v.__sizeof__() for k, v in kept) < 200_000
    assert all(len(c) == 1 or sum(map(len, c)) <= 5_000 for c in calls) and max(map(len, calls)) > 1


def test_a_tokenizer_that_joins_over_white_space_gets_whole_texts(spark, docs, pairs, scratch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    assert not encoder.parted and token_files.Encoder(TOKENIZER).parted
    token_files.write(docs, f"{scratch}/t", path, end_id=50256)
    got = token_files.read(spark, f"{scratch}/t").collect()
    ids = {t: plain.encode(t or "", add_special_tokens=False).ids + [50256] for _, t in pairs}
    assert bag((r.doc_id, tuple(r.ids)) for r in got) == bag((i, tuple(ids[t])) for i, t in pairs)


def test_token_files_of_nothing(spark, none, scratch):
    token_files.write(none, f"{scratch}/t", TOKENIZER)
    assert token_files.read(spark, f"{scratch}/t").collect() == []


def test_other_dictionary_is_refused(spark, docs, scratch):
    token_files.write(docs.limit(3), f"{scratch}/a", TOKENIZER)
    other = spark.createDataFrame([(bytearray(b"x" * 300), "", 2, "")], "dictionary binary, sha256 string, width int, tokenizer_sha256 string")
    other.write.mode("overwrite").parquet(f"{scratch}/a/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read(spark, f"{scratch}/a").collect()


# --- substring dedup

def test_repeated_passages(docs, pairs):
    got = substring.deduplicate(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert bag(got) == bag(data.removed_words(pairs))
    assert sum(r.n_removed for r in got) > 1000


def stands(text, own, f):
    """Whether the words of a factor are those of its reference, in one piece."""
    span = own[f.start : f.start + f.length]
    return len(span) == f.length and any(w[f.reference_start : f.reference_start + f.length] == span for w in text[f.reference])


@pytest.mark.parametrize("window,block", [(13, 2 << 20), (13, 3000), (3, 500)])
def test_factors_stand_in_one_piece(docs, pairs, monkeypatch, window, block):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    text = {}
    for i, t in pairs:
        text.setdefault(i, []).append(data.words(t))
    seen = 0
    for r in substring.deduplicate(docs, window).where("n_removed > 0 AND doc_id IS NOT NULL").collect():
        covered = {k for f in r.factors for k in range(f.start, f.start + f.length)}
        assert len(covered) == r.n_removed
        for f in r.factors:
            seen += 1
            assert f.reference < r.doc_id and f.length >= window
            assert any(stands(text, own, f) for own in text[r.doc_id])
        ends = [f.start + f.length for f in r.factors]
        assert ends == sorted(set(ends)), "a factor lies within another one"
    assert seen >= 10


def parsed(spark, window, *texts):
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").coalesce(1)
    rows = substring.deduplicate(df, window).orderBy("doc_id").collect()
    return [[tuple(f) for f in r.factors] for r in rows], [r.kept for r in rows]


def test_factors_do_not_join_separate_places(spark):
    w = [f"w{i}" for i in range(14)]
    reference = " ".join(["x", *w[:13], "y", "z", *w[1:]])
    found, kept = parsed(spark, 13, reference, " ".join(w))
    assert found == [[], [(0, 13, 1, 1), (1, 13, 1, 16)]] and kept == [reference, ""]


def test_factors_reach_over_what_another_reference_holds(spark):
    w = [f"w{i}" for i in range(40)]
    # the first document holds the middle, the second one all of it
    found, _ = parsed(spark, 5, " ".join(w[10:17]), " ".join(["a", *w]), " ".join(["b", "c", *w, "d"]))
    assert found[1] == [(11, 7, 1, 0)] and found[2] == [(2, 40, 2, 1)]
    # its windows are too far apart to be sure of what stands between
    found, kept = parsed(spark, 5, " ".join(w[10:30]), " ".join(["a", *w]), " ".join(w))
    assert found[2] == [(0, 14, 2, 1), (10, 20, 1, 0), (26, 14, 2, 27)] and kept[2] == ""


def test_factors_with_one_id_twice(spark):
    w = [f"w{i}" for i in range(8)]
    df = spark.createDataFrame([(1, " ".join(w[:5])), (1, " ".join(["x", *w[1:6]])), (2, " ".join(w[:6]))], "doc_id long, text string").coalesce(1)
    last = substring.deduplicate(df, 5).where("doc_id = 2").first()
    assert [tuple(f) for f in last.factors] == [(0, 5, 1, 0), (1, 5, 1, 1)] and last.n_removed == 6


def test_small_blocks_and_buckets(docs, pairs, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_BYTES", 1 << 12)
    got = substring.deduplicate(docs, window=3, digest=True).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert bag(got) == bag(data.removed_words(pairs, 3))


def test_long_text_in_pieces(monkeypatch):
    text = data.prose(9, 5000).encode()
    at_once = substring.seeds(text, 13)
    monkeypatch.setattr(substring, "BLOCK_BYTES", 1000)
    assert np.array_equal(at_once, substring.seeds(text, 13)) and len(at_once) == 5000 - 12


# --- decontamination

ITEMS = [
    (1, data.PASSAGE), (2, "Three SHORT words"), (3, None), (None, "another text with this id"), (4, ""), (5, " ".join(data.PASSAGE.split()[20:40])),
    (5, "one"), (6, "same line same line other line same line"), (2, "Three SHORT words"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, TEXT string")


def test_occurrences(docs, items, pairs):
    from tablewarden.llm.common import pick

    want = bag((i, n, h, tuple(x)) for i, n, h, x in data.contaminated(pairs, ITEMS))
    mine, theirs = pick(docs, "doc_id", "text"), pick(items, "item_id", "text")
    for words in (decontaminate.BLOCK_WORDS, 10):  # in one automaton, and in one per few words
        got = decontaminate.occurrences(mine, theirs, block_words=words).collect()
        assert bag((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want


def test_long_runs_go_over_lists(monkeypatch):
    automaton = decontaminate.Automaton([(1, [b"a", b"b", b"a", b"b", b"c"]), (2, [b"b", b"c"])], 3)
    words = [b"a", b"b", b"a", b"b", b"c", b"x", b"b", b"c", b"a", b"b", b"a"]
    for n in range(1, 12):
        total, spans, found = automaton.scan(words[k : k + n] for k in range(0, len(words), n))
        assert (total, spans, found) == (11, [[0, 5], [6, 11]], {1, 2})


def test_full_block_of_items_is_small():
    import tracemalloc

    rng = np.random.default_rng(3)
    words = [f"w{k}".encode() for k in range(60_000)]
    drawn = np.minimum(rng.zipf(1.2, decontaminate.BLOCK_WORDS) - 1, len(words) - 1).reshape(-1, 100)
    items = [(n, [words[k] for k in row]) for n, row in enumerate(drawn.tolist())]
    tracemalloc.start()
    automaton = decontaminate.Automaton(items, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20, peak
    total, spans, found = automaton.scan([[b"other", *items[77][1][5:30]]])
    assert (total, spans) == (26, [[1, 26]]) and 77 in found


def test_automaton_against_all_substrings():
    import random

    pick = random.Random(3)
    for _ in range(40):
        items = [(k, [bytes([97 + pick.randrange(3)]) for _ in range(pick.randrange(1, 9))]) for k in range(5)]
        text = [bytes([97 + pick.randrange(4)]) for _ in range(60)]
        windows = {(k, tuple(w[j : j + 4])) for k, w in items for j in range(max(1, len(w) - 3))}
        hit, found = set(), set()
        for k, w in windows:
            for j in range(len(text) - len(w) + 1):
                if tuple(text[j : j + len(w)]) == w:
                    hit.update(range(j, j + len(w)))
                    found.add(k)
        _, spans, got = decontaminate.Automaton(items, 4).scan([text])
        assert {x for a, b in spans for x in range(a, b)} == hit and got == found


def test_decontaminate(spark, docs, items, pairs):
    clean = {i for i, (_, _, h, _) in enumerate(data.contaminated(pairs, ITEMS)) if not h}
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert whole(kept) == whole(spark.createDataFrame([r for k, r in enumerate(data.rows()) if k in clean], docs.schema))
    cut = decontaminate.decontaminate(docs, items, max_coverage=0.99)
    left = bag(r[:2] for r in cut.toDF(*[f"c{i}" for i in range(9)]).select("c0", "c1").collect())
    assert all(not h for _, _, h, _ in data.contaminated([(i, t) for i, t in left], [x for x in ITEMS if x[0] == 1]))
    assert not [t for _, t in left if t and "passage30" in t.lower()]


def test_no_documents_or_no_items(docs, none, items):
    assert decontaminate.decontaminate(none, items).collect() == []
    assert whole(decontaminate.decontaminate(docs, items.limit(0))) == whole(docs)


# --- SimHash

def test_near_duplicates(docs, pairs):
    got = simhash.near_duplicates(docs).collect()
    assert bag((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == bag(data.linked(pairs))


def test_keep_one(docs, pairs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.toDF(*[f"c{i}" for i in range(9)]).select("c0").collect()]
    assert sorted(ids) == sorted({c for _, _, c in data.linked(pairs)})


def test_crowded_posting_lists(spark, monkeypatch):
    """Thousands of fingerprints around one centre go through several cells and stay one group."""
    rng = np.random.default_rng(5)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(600)]
    prints = [0x0123456789ABCDEF ^ f for f in flips] + [int(x) for x in rng.integers(0, 1 << 63, 100)]
    signed = [(int(np.uint64(p).view(np.int64)),) for p in sorted(set(prints))]
    monkeypatch.setattr(simhash, "CELL", 50)
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    from tablewarden.llm.components import components

    root = {r.node % (1 << 64): r.root for r in components(edges).collect()}
    want = {p: c for _, p, c in data.grouped(range(len(prints)), prints)}
    mine: dict = {}
    for p in want:
        mine.setdefault(root.get(p, ("alone", p)), set()).add(want[p])
    assert all(len(v) == 1 for v in mine.values()) and len(mine) == len(set(want.values()))


def test_components_of_a_chain(spark):
    from tablewarden.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 100), (60, 61), (61, 62), (62, 60), (None, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 50, 50: 50, 60: 60, 61: 60, 62: 60}


# --- near copies

def planted(spark):
    """Texts with one copy each, whose 5-word Jaccard similarity lies around and above 0.8."""
    rng, rows, alike = np.random.default_rng(8), [], {}
    for i in range(120):
        words = data.prose(5000 + i, 400).split()
        copy = list(words)
        for at in rng.choice(400, 1 + i % 12, replace=False):
            copy[at] = f"edited{i}x{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in ([x.lower() for x in words], [x.lower() for x in copy]))
        alike[2 * i + 1] = len(a & b) / len(a | b)
    return spark.createDataFrame(rows, "doc_id long, text string"), alike


@pytest.mark.parametrize("cell", [jaccard_join.CELL, 4])
def test_planted_copies_go_by_similarity(spark, monkeypatch, cell):
    import corpus_pipeline

    monkeypatch.setattr(jaccard_join, "CELL", cell)
    docs, alike = planted(spark)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert min(alike.values()) < 0.79 and sum(0.8 <= s < 0.85 for s in alike.values()) > 9
    assert kept == {2 * i for i in range(120)} | {i for i, s in alike.items() if s < 0.8}


def test_near_copies_come_from_simhash_first(spark, monkeypatch):
    """The stage takes candidates from the fingerprint index; those that are no near copies by their shingles stay apart."""
    import corpus_pipeline
    from tablewarden.llm import simhash

    seen, pairs_of = [], simhash.candidate_pairs

    def spy(stages, prints, distance=3):
        pairs, _ = stages.write(pairs_of(stages, prints, distance))
        seen.extend((tuple(r), distance) for r in pairs.collect())
        return pairs

    monkeypatch.setattr(jaccard_join, "candidate_pairs", spy)
    long = data.prose(77, 600).split()
    chant = "one two three four five " * 60
    rows = [
        (1, " ".join(long)), (2, " ".join([*long[:-1], "other"])),  # near copies by both
        (3, chant + data.prose(78, 12)), (4, chant + data.prose(79, 12)),  # one fingerprint, unlike sets
        (None, " ".join(long)), (6, ""), (7, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [r[0] for r in docs.where("doc_id IN (1, 2, 3, 4)").orderBy("doc_id").select(simhash.fingerprint(docs.text, 5)).collect()]
    apart = lambda a, b: bin((a ^ b) % (1 << 64)).count("1")
    assert apart(*prints[:2]) <= 3 and apart(*prints[2:]) <= 3
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {1, 3, 4, 6}
    assert len(seen) == 2 and all(d == 3 for _, d in seen)


def test_keep_one_of_near_copies(docs, none):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and jaccard_join.keep_one(none).collect() == []
    ids = [r[0] for r in kept.toDF(*[f"c{i}" for i in range(9)]).select("c0").collect()]
    rows = [(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w)) for i, t in [r[:2] for r in data.rows()] for w in [data.words((t or "").lower())]]
    group = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                group = [group[j] if g == group[i] else g for g in group]
    least: dict = {}
    for (i, _), g in zip(rows, group, strict=True):
        least.setdefault(g, []).append(i)
    assert sorted(ids) == sorted(min(x for x in v if x is not None) for v in least.values())


# --- quality rules

def test_statistics(docs, pairs):
    got = quality.judge(docs.toDF(*[f"c{i}" for i in range(9)]), "c1", ("c2", "c3"), ("c0",)).collect()
    want = []
    for i, t in pairs:
        s = data.statistics(t)
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        want.append((i, *s, failed))
    assert bag(tuple(r)[:7] for r in got) == bag(want)
    assert all(not r.kept for r in got if r.base_failed)


def outlier_frame(spark, n=400):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        text = data.prose(1000 + i, int(rng.integers(20, 200)))
        junk = i % 10 == 0
        rows.append((i, " ".join(w + "#$%&" for w in text.split()) if junk else text, "en", ["a", "a", "b"][i % 3]))
    rows.append((n, data.prose(7, 30), "xx", "alone"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_ordinary_texts_stay(spark):
    kept = {r.doc_id for r in quality.filter_documents(outlier_frame(spark)).collect()}
    assert kept == {i for i in range(400) if i % 10} | {400}


def test_a_rare_language_is_judged_by_all(spark):
    """Forty rows have no estimate of their own; the one of all languages lets ordinary texts of theirs pass."""
    rare = [(1000 + i, data.prose(5000 + i, 60), "zz", "rare") for i in range(36)]
    junk = [(2000 + i, " ".join(w + "#$%&" for w in data.prose(6000 + i, 60).split()), "zz", None) for i in range(4)]
    frame = outlier_frame(spark)
    more = spark.createDataFrame(rare + junk, frame.schema)
    kept = {r.doc_id for r in quality.filter_documents(frame.unionAll(more)).collect()}
    assert kept == {i for i in range(400) if i % 10} | {400} | {r[0] for r in rare}
    few = quality.judge(more, keep=("doc_id", "lang")).collect()
    assert len(few) == 40 and all(r.distance is None and r.kept for r in few)


def test_estimates_against_numpy(spark):
    """The robust covariance of a clean normal sample is near the true one, with a tenth of it far away."""
    rng = np.random.default_rng(2)
    true = np.array([[2.0, 0.6, 0, 0], [0.6, 1.0, 0.3, 0], [0, 0.3, 1.5, 0], [0, 0, 0, 3.0]])
    sample = rng.multivariate_normal([1, 2, 3, 4], true, 4000)
    sample[:400] += 50
    frame = spark.createDataFrame([("g", *map(float, r)) for r in sample], "g string, v0 double, v1 double, v2 double, v3 double")
    r = quality.estimates(frame, ["g"]).first()
    factor = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    found = factor @ factor.T - np.diag(np.square(quality.FLOORS))
    assert np.allclose([r.m0, r.m1, r.m2, r.m3], [1, 2, 3, 4], atol=0.15) and np.allclose(found, true, atol=0.35)


def test_quality_keeps_columns(docs, none):
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and not whole(kept) - whole(docs)
    assert quality.filter_documents(none).collect() == []


# --- shards

def test_shards(docs, pairs):
    got = sharding.assign(docs, 4)
    assert got.columns == [*docs.columns, "_shard", "slot", "grown_shard"]
    rows = got.toDF(*[f"c{i}" for i in range(len(got.columns))]).select("c0", "c1", "c9", "c10", "c11", F.xxhash64("c0").alias("key")).collect()
    assert bag((r.c0, r.c1) for r in rows) == bag(pairs)
    for r in rows:
        assert (r.c9, r.c11) == (data.jump(r.key % (1 << 64), 4), data.jump(r.key % (1 << 64), 5))
        assert r.c11 in (r.c9, 4)
    for s in range(4):
        assert sorted(r.c10 for r in rows if r.c9 == s) == list(range(sum(r.c9 == s for r in rows)))


def test_slots_go_over_cells(spark, monkeypatch):
    from tablewarden.llm import common

    df = spark.range(500).selectExpr("id", "xxhash64(id) AS h", "id % 3 AS g", "id % 7 AS v").unionAll(
        spark.range(500).selectExpr("id", "xxhash64(id) AS h", "CAST(NULL AS LONG) AS g", "id % 7 AS v")
    )
    got = common.running_sum(df, ["g"], "h", ["id"], F.col("v"), "before", rows_per_cell=20).collect()
    assert len(got) == 1000
    for g in (0, 1, 2, None):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.h):
            assert r.before == total
            total += r.v


def test_written_shards(spark, docs, none, scratch):
    sharding.write(docs.toDF(*[f"c{i}" for i in range(9)]).select(F.col("c0").alias("doc_id"), F.col("c1").alias("text")), f"{scratch}/s", 3, rows_per_file=5)
    back = spark.read.parquet(f"{scratch}/s")
    assert back.count() == docs.count() and set(back.columns) == {"doc_id", "text", "shard", "slot", "grown_shard"}
    assert sharding.assign(none, 3).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(docs, 0)


# --- mixing

def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long, target string")


def targets_by_rounds(sizes, weights=(5, 2, 1), cap=3.0):
    """Shared by weight again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mix(spark):
    rng = np.random.default_rng(4)
    sources = ["b", "a", "c", None, "é", "Z", "empty"]
    rows = [(i, sources[i % 6] if i % 5 else "a", int(rng.integers(0, 50)), None) for i in range(300)]
    rows += [(None, "a", 7, None), rows[1], rows[1], (900, "empty", 0, None), (901, "empty", None, None), (902, "c", 5000, None)]
    got = mixing.mix(sized(spark, rows), "size")
    assert got.columns == ["doc_id", "source", "size", "target", "source_size", "_target", "taken", "copies"]
    got = got.collect()
    sizes: dict = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want = targets_by_rounds(sizes)
    assert bag((r.doc_id, r.source, r.size) for r in got) == bag(r[:3] for r in rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r._target - want[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.5
    for r in got:
        assert 0 <= r.taken <= 3 * (r.size or 0) and sum(c["size"] for c in r.copies) == r.taken
        assert all(0 <= c.position <= 1 for c in r.copies)
    again = mixing.mix(sized(spark, rows[::-1]).repartition(7), "size").collect()
    assert bag((r.doc_id, r.size, r.taken, str(r.copies)) for r in again) == bag((r.doc_id, r.size, r.taken, str(r.copies)) for r in got)


def test_positions_follow_the_schedule(spark):
    """Up to a time a source has given the share of its demand that its integrated weight says."""
    curriculum = mixing.Curriculum((1.0, 1.0), ((2.0, 0.0), (0.0, 2.0)))
    rows = [(i, "ab"[i % 2], 1, None) for i in range(4000)]
    got = mixing.training_order(sized(spark, rows), "size", curriculum).collect()
    assert len(got) == 4000 and [r.position for r in got] == sorted(r.position for r in got)
    for time in (0.1, 0.5, 0.8):
        early = Counter(r.source for r in got if r.position < time)
        assert abs(early["a"] / 2000 - (2 * time - time * time)) < 0.01 and abs(early["b"] / 2000 - time * time) < 0.01


def test_mix_of_nothing(spark):
    assert mixing.mix(sized(spark, []), "size").collect() == []
    assert [r.taken for r in mixing.mix(sized(spark, [(1, "a", 0, None), (2, None, None, None)]), "size").collect()] == [0, 0]
    with pytest.raises(ValueError):
        mixing.Curriculum(weights=(0.0,))
    with pytest.raises(ValueError):
        mixing.Curriculum(shapes=((1.0,),))


# --- secrets

def test_secrets(spark, docs, pairs, scratch):
    got = secrets.scan_documents(docs, f"{scratch}/ledger").collect()
    base = {r.kind for r in secrets.BASE}
    mine = bag((r.doc_id, r.blob, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind in base)) for r in got)
    assert mine == bag((i, hashlib.sha256((t or "").encode()).hexdigest(), tuple(data.secrets(t))) for i, t in pairs)
    assert sum(len(r.spans) for r in got) == 4


def test_only_unseen_blobs_are_scanned(spark, docs, none, pairs, scratch):
    path = f"{scratch}/ledger"
    secrets.scan_documents(docs, path)
    blobs = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in pairs}
    assert secrets.ledger(spark, path).count() == len(blobs)
    more = spark.createDataFrame([(1, "fresh"), (2, data.texts()[6])], "doc_id long, text string")
    secrets.scan_documents(more, path)
    assert secrets.ledger(spark, path).count() == len(blobs) + 1
    assert secrets.scan_documents(none, path).collect() == []
    # findings of an older content are not made again: a ledger that says otherwise is believed
    forged = f"{scratch}/forged"
    version = secrets.version_of(secrets.RULES)
    row = (hashlib.sha256(data.SECRET.encode()).hexdigest(), version, [], 0)
    spark.createDataFrame([row], secrets.LEDGER).write.parquet(forged)
    text = spark.createDataFrame([(1, data.SECRET)], "doc_id long, text string")
    assert secrets.scan_documents(text, forged).first().spans == []
    # other rules are another version, for which everything is unseen
    assert len(secrets.scan_documents(text, forged, secrets.BASE[:1]).first().spans) == 1


# --- licenses

def test_licenses(spark, docs, pairs):
    mit = "Copyright 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated " \
        "documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, " \
        "modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished " \
        "to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or " \
        "substantial portions of the Software."
    rows = [
        (1, mit, "x"), (2, None, "x"), (3, "", "x"), (4, "Some text |\nReleased under the MIT License.", "x"), (4, "Some text |\nReleased under the MIT License.", "x"),
        (5, mit.split("\n\n")[2], "x"), (6, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0. Words between. Released under the MIT license!", "x"),
        (None, "We licensed under the Apache License, Version 2.0 something", "x"), (7, "word " * 200_000, "x"),
    ]
    got = licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string, Licenses string")).collect()
    assert bag((r.doc_id, r.licenses, r.n_unexplained) for r in got) == bag([
        (1, "MIT", 0), (2, "", 0), (3, "", 0), (4, "MIT", 0), (4, "MIT", 0), (5, "", 1), (6, "MIT,Apache-2.0", 0), (None, "", 0), (7, "", 0),
    ])
    assert {r.sentences for r in got if r.doc_id == 6} == {"apache-notice,mit-notice"}
    assert licenses.recognise(docs.limit(0)).collect() == []
    assert licenses.recognise(docs).count() == len(pairs)


def test_license_rules_are_in_order():
    names = set(licenses.ALL_SENTENCES) | {"bsd-neither"}
    assert all(set(n) <= names for _, n in licenses.ALL_RULES)
    assert len(set(licenses.ALL_SENTENCES.values())) == len(licenses.SENTENCES) + len(licenses.HEADER_SENTENCES)
    tried = [licenses._pattern(n) for _, n in licenses.ALL_RULES]
    # a rule that holds another one's sentences comes first
    assert not [(a, b) for i, a in enumerate(tried) for b in tried[i + 1 :] if a in b]


GNU = """This {what} is free software{mark} you can redistribute it and/or modify it under the
terms of the GNU {name} as published by the Free Software Foundation{version}
of the License, or (at your option) any later version.
"""
NOTICES = {
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not "
    "distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "LGPL-2.1-or-later": GNU.format(what="library", mark=";", name="Lesser General Public License", version="; either version 2.1"),
    "LGPL-3.0-or-later": GNU.format(what="program", mark=":", name="Lesser General Public License", version=", either version 3"),
    "AGPL-3.0-or-later": GNU.format(what="program", mark=":", name="Affero General Public License", version=", either version 3"),
    "GPL-2.0-or-later": GNU.format(what="program", mark=";", name="General Public License", version="; either version 2"),
    "ISC": "Copyright 2020 X\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND "
    "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
    "software to the public domain worldwide. This software is distributed without any warranty.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Copyright (c) 2020 Foo\n# Licensed under the MIT License.", "Apache-2.0": "x = 1;\n// Licensed under the Apache License, Version 2.0",
}


def test_a_notice_of_each_license(spark):
    got = licenses.recognise(spark.createDataFrame(list(NOTICES.items()), "doc_id string, text string")).collect()
    assert {r.doc_id: (r.licenses, r.n_unexplained) for r in got} == {name: (name, 0) for name in NOTICES}


def test_license_sql_is_the_query(spark):
    """On texts that hold every known sentence and header, in and out of order."""
    import duckdb

    sentences = list(licenses.ALL_SENTENCES.values())
    texts = [*NOTICES.values(), APACHE, GPL, BSD, *[f"{s}." for s in sentences], ". ".join(sentences), "\n\n".join(reversed(sentences)), "a\n" + "\n".join(sentences)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = licenses.recognise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert bag(tuple(r) for r in got) == bag(con.execute(licenses.SQL).fetchall())


APACHE = """Copyright 2020 X

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NEITHER = """3. Neither the name of Foo nor the names of its contributors may be used to endorse or
   promote products derived from this software without specific prior written permission.
"""


def test_license_headers_as_they_are_written(spark):
    texts = [APACHE, APACHE.replace("http:", "https:"), APACHE.split("You may obtain")[0], GPL, GPL.split("\n\n")[0], BSD, BSD + NEITHER, (BSD + NEITHER).replace("1.", "*").replace("2.", "*").replace("3.", "*")]
    got = licenses.recognise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    names = ["Apache-2.0", "Apache-2.0", "Apache-2.0", "GPL-3.0-or-later", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause"]
    assert [(r.licenses, r.n_unexplained) for r in got] == [(n, 0) for n in names]


def test_further_kinds_of_secrets():
    scan, kinds = secrets.scanner(secrets.RULES), [r.kind for r in secrets.RULES]
    a = "aB3" * 20
    planted = {
        "github": f"ghp_{a[:36]}", "github_pat": f"github_pat_{a[:30]}", "gitlab": f"glpat-{a[:20]}", "slack": f"xoxb-{a[:24]}",
        "google": f"AIza{a[:35]}", "stripe": f"sk_live_{a[:24]}", "npm": f"npm_{a[:36]}", "jwt": f"eyJ{a[:12]}.eyJ{a[:15]}.{a[:9]}",
        "url_login": "://me:pa55@", "pem": "-----BEGIN RSA PRIVATE KEY-----",
    }
    assert set(planted) == {r.kind for r in secrets.FURTHER}
    for kind, text in planted.items():
        found = [(kinds[n], s, e) for s, n, e in scan(f"see {text} there")]
        assert found == [(kind, 4, 4 + len(text))], kind
    clean = "https://host:8080/path?x=y @me ghp_short eyJhbGciOi.x sk_live_ AIza npm_run ratio 3:4@home"
    assert [kinds[n] for _, n, _ in scan(clean)] == []
    # time grows with the length of the text, not with its square
    import time

    for unit in ("eyJ", "://a:", "xoxb-", "ghp_", "-----BEGIN ", "a://b"):
        at = time.perf_counter()
        scan(unit * 300_000)
        assert time.perf_counter() - at < 20, unit


def test_other_rule_versions_are_not_read(spark, docs, scratch):
    path = f"{scratch}/ledger"
    secrets.scan_documents(docs, path, secrets.BASE)
    secrets.scan_documents(docs, path)
    wanted = secrets.version_of(secrets.RULES)
    files = secrets.ledger(spark, path).where(F.col("version") == wanted).select("blob", "spans").inputFiles()
    plan = secrets.ledger(spark, path).where(F.col("version") == wanted)._jdf.queryExecution().executedPlan().toString()
    assert files and "PartitionFilters: [isnotnull(version" in plan
    counts = {r.version: r["count"] for r in secrets.ledger(spark, path).groupBy("version").count().collect()}
    assert len(set(counts.values())) == 1 and set(counts) == {wanted, secrets.version_of(secrets.BASE)}
