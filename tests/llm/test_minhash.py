import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm import minhash as m


def brute(rows, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("params", [m.MinHashParams(), m.MinHashParams(percent=85, small=2, block_bytes=9_000, star=7, count_at_once=500, broadcast_rows=0)])
def test_components_equal_brute_force(spark, params):
    texts = variants(1, 60, 200, 5) + variants(2, 40, 40, 2) + variants(3, 10, 3, 1)
    texts += ["A b C d e f", "a B c d E f", "one two", "One  two", "", None, " \t\n", "é É " * 9] * 2
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.link_components(docs, params).collect()}
    assert got == brute(rows, params.percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_lose_fewer_links_than_bands(percent):
    params = m.MinHashParams(percent=percent)
    same = percent / 100 + (1 - percent / 100) / 2**m.BITS
    dropped = sum(math.comb(params.hashes, k) * same**k * (1 - same) ** (params.hashes - k) for k in range(params.least_equal))
    assert dropped < (1 - (percent / 100) ** params.rows) ** params.bands


def test_kept_is_the_smallest_and_rows_survive(spark):
    docs = spark.createDataFrame([(7, "a b c d e f"), (3, "a b c d e f"), (9, "other words here and so on"), (9, "other words here and so on")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in m.link_components(docs).collect())
    assert got == [(3, 3, True), (7, 3, False), (9, 9, True), (9, 9, True)]


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert m.link_components(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in m.link_components(docs).collect()}
    assert got == {(None, 2): (4, False), (4, 2): (4, True), (None, 0): (None, True)}


def test_estimate_from_packed_minima(spark):
    params = m.MinHashParams()
    a, b = variants(5, 2, 400, 0)
    words = b.split()
    b = " ".join(words[:300] + [f"z{i}" for i in range(100)])
    (x, _), (y, _) = (m.signature(m.shingles(t), params) for t in (a, b))
    row = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<long>, b array<long>")
    equal = row.select(m.equal_minima(F.col("a"), F.col("b"), params).alias("e")).first()["e"]
    nib = lambda v: np.stack([(v.view(np.uint8) & 15), (v.view(np.uint8) >> 4)], 1).ravel()
    assert equal == int((nib(x) == nib(y)).sum())
    s, t = set(m.shingles(a).tolist()), set(m.shingles(b).tolist())
    assert abs((equal / 160 - 1 / 16) / (15 / 16) - len(s & t) / len(s | t)) < 0.15


def test_components_of_a_long_chain(spark):
    rows = [(bytes([0, i]), bytes([0, i + 1])) for i in range(60)] + [(b"\x09\x01", b"\x09\x02")]
    edges = spark.createDataFrame(rows, "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in m.components(edges).collect()}
    assert len(got) == 63 and set(got.values()) == {b"\x00\x00", b"\x09\x01"}


def test_a_passage_in_a_third_of_all_rows(spark):
    """Nodes that share one passage leave its buckets by the bound on shared shingles; near copies beside them are found."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    words = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    texts = [f"{words(5)} {passage} {words(5)}" for _ in range(400)] + variants(9, 300, 60, 4) + [words(60) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    params = m.MinHashParams(percent=85, small=8, block_bytes=20_000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.link_components(docs, params).collect()}
    assert got == brute(list(enumerate(texts)), 85)


def test_shared_sizes(spark):
    texts = {b"a" * 16: "a b c d e f g h", b"b" * 16: "a b c d e f x y", b"c" * 16: "q"}
    rows = [(k, len(m.shingles(t)), t) for k, t in texts.items()]
    df = spark.createDataFrame(rows, "node binary, n_shingles long, text string")
    for at_once in (1, 3, 1000):
        got = {bytes(r.node): r.alone for r in m.shared_sizes(df.drop("text"), df, m.MinHashParams(count_at_once=at_once)).collect()}
        assert got == {b"a" * 16: 2, b"b" * 16: 2, b"c" * 16: 1}


def test_one_row_of_each_group(spark):
    t, u = "a b c d e f", "some other words that stand here alone"
    rows = [(1, t, "x"), (5, t, "y"), (5, u, "z"), (None, t, "n"), (None, t, "n"), (7, u, "q"), (None, None, "e"), (8, "", "e"), (9, u, "b"), (9, u, "a"), (2**53 + 1, "one more text of its own", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of_ string").withColumn("id_", F.lit(1)).withColumn("TEXT_KEY", F.lit(2))
    kept = m.one_of_each(docs, m.MinHashParams(broadcast_rows=0))
    assert kept.columns == docs.columns
    got = sorted((tuple(r)[:3] for r in kept.collect()), key=repr)
    assert got == sorted([(1, t, "x"), (5, u, "z"), (None, None, "e"), (8, "", "e"), (2**53 + 1, "one more text of its own", "k")], key=repr)
    twice = [(4, t, "x"), (4, t, "y"), (4, t, "y")]
    got = [m.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, c string")).collect() for rows in (twice, twice[::-1])]
    assert len(got[0]) == 1 and got[0] == got[1]


def test_very_long_texts_and_a_hot_group(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(i, "the same words in every one of these rows") for i in range(3000)] + [(5000, long), (5001, long + " end"), (5002, long[: len(long) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in m.link_components(docs).collect()}
    assert all(got[i] == 0 for i in range(3000)) and (got[5000], got[5001], got[5002]) == (5000, 5000, 5002)


def test_recall_of_every_fiftieth_document(spark):
    """Documents whose id is divisible by 50 against all rows, by brute force: every link's two ends are in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    component = {r.doc_id: r.component_id for r in m.link_components(docs, m.MinHashParams(percent=85)).collect()}
    sets = {r.doc_id: m.shingles(r.text) for r in rows}
    links = [(q, d) for q in sets if q % 50 == 0 for d in sets if d != q and len(sets[q]) and len(sets[d]) and m.similar(sets[q], sets[d], 85)]
    assert links and all(component[q] == component[d] for q, d in links)
