"""Every query without SQL, and the pipeline, against brute force over the smallest tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tablewarden.llm import quality
from tablewarden.llm.queries import QUERIES, SQL
from tests.conftest import SMALL
from tests.llm import data


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    read = lambda t: con.execute(f"SELECT * FROM '{SMALL}/{t}.parquet' ORDER BY 1").fetchall()
    return {t: read(t) for t in ("documents", "benchmark")}


@pytest.fixture(scope="module")
def pairs(tables):
    return [r[:2] for r in tables["documents"]]


def run(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 0
    return {r.doc_id: r.asDict() for r in rows}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) == {"op5_chat_formatting", "op10_license_sentences", "op11_jaccard_join", "op13_burst_trie"}


def test_op1(spark, pairs):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = run(spark, "op1_token_files"), 0
    for i, text in pairs:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[i] == {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": data.crc(ids)}
        start += len(ids)


def test_op2(spark, pairs):
    got = run(spark, "op2_repeated_passages")
    assert Counter(tuple(r.values()) for r in got.values()) == Counter(data.removed_words(pairs))


def test_op3(spark, pairs, tables):
    got = run(spark, "op3_benchmark_decontamination")
    for i, n, hit, items in data.contaminated(pairs, tables["benchmark"]):
        names = ",".join(sorted(map(str, items)))
        assert tuple(got[i].values()) == (i, n, hit, len(items), sha(names), hit > 0)


def test_op4(spark, pairs):
    got = run(spark, "op4_simhash_near_duplicates")
    assert {i: tuple(r.values()) for i, r in got.items()} == {i: (i, f"{p:016x}", c) for i, p, c in data.linked(pairs)}


def vectors(stats):
    """The vector of each row, from its statistics."""
    n, chars, symbols, lines, repeated = np.array(stats, float).T
    words = np.maximum(n, 1)
    return np.stack([
        np.log1p(n), np.log(np.maximum(chars, 1) / words), np.log1p(1000 * symbols / np.maximum(chars, 1)),
        np.log1p(100 * (repeated + lines) / words),
    ], axis=1)


def robust(x):
    """Location and covariance by concentration steps, in numpy."""
    floors = np.square(quality.FLOORS)
    lower = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    mean = lower(x)
    cov = np.diag(np.square(np.maximum(quality.FLOORS, 1.4826 * lower(np.abs(x - mean)))))
    distance = lambda: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    moments = lambda part, scale: (part.mean(0), np.cov(part.T, bias=True) * scale + np.diag(floors))
    for _ in range(quality.STEPS):
        cells = np.floor(32 * np.log1p(distance()))
        border = np.sort(cells)[int(np.ceil(quality.SUBSET * len(x))) - 1]
        mean, cov = moments(x[cells <= border], 1.63)
    mean, cov = moments(x[distance() <= quality.REWEIGHT], 1.05)
    return mean, cov


def judged(docs):
    """Per document: id, statistics, base verdict, distance or None, verdict."""
    stats = [data.statistics(r[1]) for r in docs]
    failed = [s[0] < 10 or 100 * s[4] > 20 * s[0] for s in stats]
    groups = Counter((r[2], r[3]) for r, f in zip(docs, failed, strict=True) if not f)
    pools = Counter()
    for (lang, _), n in groups.items():
        pools[lang] += n if n < quality.MIN_ROWS else 0
    kind = lambda r: 0 if groups[r[2], r[3]] >= quality.MIN_ROWS else 1 if pools[r[2]] >= quality.MIN_ROWS else 2
    key = [[(r[2], r[3], 0), (r[2], None, 1), (None, None, 2)][kind(r)] for r in docs]
    x, far = vectors(stats), [None] * len(docs)
    for k in set(key):
        own = [j for j in range(len(docs)) if key[j] == k]
        clean = [j for j in (own if k[2] < 2 else range(len(docs))) if not failed[j]]
        if len(clean) >= quality.MIN_ROWS:
            mean, cov = robust(x[clean])
            for j in own:
                far[j] = float((x[j] - mean) @ np.linalg.inv(cov) @ (x[j] - mean))
    return [
        (r[0], *s, f, d, not f and (d is None or d <= quality.LIMIT))
        for r, s, f, d in zip(docs, stats, failed, far, strict=True)
    ]


def near_groups(docs):
    """The first id of each group of texts whose sets of 5-word shingles are similar to 0.8, by all pairs that share a shingle."""
    sets = {}
    for i, text in docs:
        w = data.words((text or "").lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in holders[x] if j < i).items():
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in sets}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_near_duplicates_of_the_pipeline(spark, scale):
    """The stage keeps exactly what all pairs keep."""
    folder = f"/root/testdata/{scale}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, folder).select("doc_id").collect()}
    assert kept == near_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_op6(spark, tables):
    got, want = run(spark, "op6_quality_rules"), judged(tables["documents"])
    assert any(d is not None for *_, d, _ in want)
    for i, n, chars, symbols, lines, repeated, failed, distance, kept in want:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert (r["base_failed"], r["kept"]) == (failed, kept)
        assert (r["distance"] is None) == (distance is None) and (distance is None or abs(r["distance"] - distance) < 1e-6 * (1 + distance))


def test_op7(spark, pairs):
    from pyspark.sql import functions as F

    keys = {r.id: r.h % (1 << 64) for r in spark.createDataFrame([(i,) for i, _ in pairs], "id long").select("id", F.xxhash64("id").alias("h")).collect()}
    got = run(spark, "op7_jump_shards")
    for i, text in pairs:
        raw, r = (text or "").encode(), got[i]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (data.jump(keys[i], 8), data.jump(keys[i], 9))
    for s in range(8):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Shared by weight again and again until no source is above its cap."""
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: s.encode()))}
    left, out, open_ = float(sum(sizes.values())), {}, set(sizes)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s], left = cap * sizes[s], left - cap * sizes[s]
            open_.discard(s)
    return out


def test_op8(spark, tables):
    got = run(spark, "op8_curriculum_mix")
    sizes: dict = {}
    for r in tables["documents"]:
        assert got[r[0]]["size"] == len(data.words(r[1]))
        sizes[r[3]] = sizes.get(r[3], 0) + len(data.words(r[1]))
    want = targets(sizes)
    for s in sizes:
        own = [got[r[0]] for r in tables["documents"] if r[3] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * want[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 0.5 and all(r["taken"] <= 3 * r["size"] for r in own)
    assert got == run(spark, "op8_curriculum_mix")


def test_op9(spark, pairs):
    got = run(spark, "op9_secret_ledger")
    for i, text in pairs:
        found = data.secrets(text)
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        counts = Counter(k for k, *_ in found)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (counts["assign"], counts["access"], counts["hex"], sha(base))
        assert set(base.split(",")) - {""} <= set(r["spans"].split(","))


def test_pipeline(spark, tables):
    """What the first three stages keep is known document by document; the mix and the shards by their laws."""
    from pyspark.sql import functions as F

    docs = tables["documents"]
    good = {i for i, *_, kept in judged(docs) if kept}
    docs = [r for r in docs if r[0] in good]
    firsts = near_groups([r[:2] for r in docs])
    docs = [r for r in docs if r[0] in firsts]
    leaked = {i for i, _, hit, _ in data.contaminated([r[:2] for r in docs], tables["benchmark"]) if hit}
    docs = [r for r in docs if r[0] not in leaked]
    assert 0 < len(docs) < len(good) < len(tables["documents"]) and leaked

    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "shard", "slot"]
    rows = out.withColumn("key", F.xxhash64("doc_id")).collect()
    source, words = {r[0]: r[3] for r in docs}, {r[0]: len(data.words(r[1])) for r in docs}
    assert {r.doc_id for r in rows} <= set(source)
    sizes: dict = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + words[i]
    copies, want = Counter(r.doc_id for r in rows), targets(sizes)
    assert max(copies.values()) <= 4
    for s in sizes:
        longest = max(words[i] for i in source if source[i] == s)
        assert abs(sum(copies[i] * words[i] for i in source if source[i] == s) - want[s]) <= longest
    for r in rows:
        assert r.shard == data.jump(r.key % (1 << 64), 8)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_stages_take_empty_and_awkward_tables(spark, tmp_path):
    """Each stage gives the columns it got, but the last, whatever the rows hold."""
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for n in (0, 1):
        docs = data.frame(spark, n).drop("tags") if n else data.frame(spark).drop("tags").limit(0)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns
            if n == 0:
                assert after.count() == 0
            else:
                assert after.count() > 0
