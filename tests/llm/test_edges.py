"""Odd rows in the training-data operators, and brute force for those that SQL cannot express."""

import hashlib
import math
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wayfare.llm import fingerprint, langid, licenses, matroska, quality_fm, sharding

BIG = 2**53 + 1  # an id that a float cannot hold
LONG = "a long text of plain words that goes on and on " * 20_000


def test_language_by_brute_force_and_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("the dog ran", "en"), ("die katze sass", "de"), ("der hund lief", "de"), ("die maus", "de"), (None, "en"), ("", "de"), ("123", None)] * 3)]
    rows += [(1, "the cat sat", "en"), (None, "the cat", "en"), (BIG, LONG, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    params = langid.LangIdParams()
    learn = [r for r in rows if r[0] is not None and r[2] is not None and __import__("zlib").crc32(str(r[0]).encode()) % 5]
    counts, sizes = {}, Counter(r[2] for r in learn)
    for _, text, lang in learn:
        if text:
            counts.setdefault(lang, Counter()).update(langid.ngram_buckets(text, params).tolist())

    def naive(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        grams = Counter(langid.ngram_buckets(text, params).tolist())
        logs = {}
        for lang in sorted(sizes):
            total = sum(counts[lang].values()) + params.smoothing * (1 << params.bucket_bits)
            logs[lang] = math.log(sizes[lang] / len(learn)) + sum(n * math.log((counts[lang][g] + params.smoothing) / total) for g, n in grams.items())
        best = max(sorted(logs), key=logs.get)
        cooled = min(1.0, params.evidence / sum(grams.values()))
        return best, 1 / sum(math.exp((x - logs[best]) * cooled) for x in logs.values())

    got = langid.language_of(docs).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    text = {r[0]: r[1] for r in rows}
    for r in got:
        lang, score = naive(text[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3
    assert langid.language_of(docs.limit(0)).count() == 0


def test_a_tie_goes_to_the_language_that_sorts_first():
    model = langid.LangIdModel(("aa", "bb"), np.log([0.5, 0.5]), np.full((1 << 15, 2), -3.0, dtype=np.float32), langid.LangIdParams())
    assert langid.classify("any text", model) == ("aa", 0.5)


def test_files_that_cannot_be_read_give_nulls(spark):
    good = matroska.mux(b"x" * 192)
    df = spark.createDataFrame([(1, 192, good), (2, 0, None), (3, 0, b"junk"), (4, 192, good[:80])], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in matroska.read_back(df).collect()}
    assert got[1].payload_sha256 == hashlib.sha256(b"x" * 192).hexdigest()
    assert all(got[i].payload_sha256 is None and got[i].feature is None for i in (2, 3)) and got[2].media_bytes is None and got[3].media_bytes == 4


def test_license_scan_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (None, "MIT License"), (BIG, None)], "doc_id long, text string")
    got = licenses.scan(docs).collect()
    assert [r.labels for r in got].count("mit") == 3 and {r.doc_id for r in got} == {1, None, BIG}


def test_fingerprints_of_long_texts_and_named_ids(spark):
    rows = [("b", LONG), ("a", LONG.upper()), ("c", "x"), ("aa", "abcdefgh"), (None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r for r in fingerprint.edited_pairs(docs).collect()}
    assert got["a"].fingerprint == got["b"].fingerprint and got["b"].near_next == 0.0 and got["a"].n_chars == len(LONG)
    assert got["aa"].edited_sha256 == hashlib.sha256(("abcdef" + LONG[:2]).encode()).hexdigest()  # after "aa" comes "b"
    assert sorted(fingerprint._ranges_of_names(docs, 4, 3))[0] == "a"


def test_equal_digests_of_different_forms_are_not_alike(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda form: F.when(F.length(form) >= 0, F.lit("0" * 32)))
    got = fingerprint.edited_pairs(spark.createDataFrame([(1, "abcdefgh"), (2, "qrstuvwx")], "doc_id long, text string")).collect()
    assert all(r.near_edited == 0.0 and r.near_next == 0.0 for r in got)


def test_fit_equals_a_naive_factorisation_machine():
    """Two epochs of one batch each, with pair sums over all pairs and gradients row by row."""
    rng = np.random.default_rng(2)
    params = quality_fm.FmParams(word_bits=3, rank=2, epochs=2, batch=10, decay=0.0, seed=4)
    n = quality_fm.n_features(params)
    rows = [(np.sort(rng.choice(n, 4, replace=False)).astype(np.int32), rng.normal(size=4), int(i % 3 == 0)) for i in range(6)]
    got = quality_fm.fit(rows, params)
    bias, w, v = 0.0, np.zeros(n), np.random.default_rng(4).normal(0, 0.05, (n, 2))
    sums = [1e-8, np.full(n, 1e-8), np.full((n, 2), 1e-8)]
    share = np.mean([r[2] for r in rows])
    for _ in range(2):
        g = [0.0, np.zeros(n), np.zeros((n, 2))]
        for at, x, label in rows:
            z = bias + w[at] @ x + sum(v[at[i]] @ v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
            d = (1 / (1 + math.exp(-z)) - label) * (0.5 / share if label else 0.5 / (1 - share)) / len(rows)
            g[0] += d
            for i in range(4):
                g[1][at[i]] += d * x[i]
                g[2][at[i]] += d * x[i] * sum(v[at[j]] * x[j] for j in range(4) if j != i)
        for s, part in zip(range(3), g):
            sums[s] = sums[s] + part**2
        bias -= params.rate * g[0] / math.sqrt(sums[0])
        w = w - params.rate * g[1] / np.sqrt(sums[1])
        v = v - params.rate * g[2] / np.sqrt(sums[2])
    used = np.unique(np.concatenate([r[0] for r in rows]))
    assert abs(got.bias - bias) < 1e-9 and np.allclose(got.linear[used], w[used]) and np.allclose(got.factors[used], v[used])


def test_quality_of_odd_rows(spark):
    good, bad = "a calm sentence about the garden and its beds.", "$$$ BUY NOW!!! ### 999 @@@"
    rows = [(i, good if i % 2 else bad, 40) for i in range(200)] + [(BIG, LONG, None), (7, good, 40), (7, bad, 40), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("score", F.lit("clash"))
    labels = [(i, i % 2) for i in range(200)] + [(7, 0), (7, None), (7, 1), (8, 3), (None, 1)]
    got = quality_fm.quality_of(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200 and r.doc_id != 7]
    assert held and all(r.predicted == r.doc_id % 2 for r in held)


def _drawn(doc_id, node, path=""):
    """A descent by hand: hashes chain from seed 42, the least draw wins."""
    if isinstance(node, sharding.Leaf):
        return node.shard
    here = f"{path}/{node.name}"
    children = [c for c in node.children if c.weight > 0]

    def draw(c):
        h = xxhash.xxh64_intdigest(f"{here}/{c.name}".encode(), 42)
        h = xxhash.xxh64_intdigest(("" if doc_id is None else str(doc_id)).encode(), h)
        return -math.log(((h >> 11) + 0.5) / float(1 << 53)) / c.weight

    return _drawn(doc_id, min(children, key=draw), here)


def test_shards_by_hand_and_odd_rows(spark):
    rows = [(i, f"t{i}") for i in range(400)] + [(3, "t3")] * 50 + [(None, None), (BIG, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs).collect()
    root = sharding.tree(16)
    grown = sharding.grow(root)
    assert all(r.shard == _drawn(r.doc_id, root) and r.grown_shard == _drawn(r.doc_id, grown) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
