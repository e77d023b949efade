"""Matroska, Re-Pair and byte-pair encoding."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfare.llm import bpe, matroska, repair

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "   ", "Hello<|endoftext|>World <|startoftext|> x", "ΣΊΣΥΦΟΣ Σ", "İstanbul", "é É café", "日本語 漢字", "😀 ok!!", "a\x1cb\x85d\xa0e", "½ ² Ⅷ ٣",
    "don't WE'LL i'm ''", "a" * 3000, "th" * 500, "_under__ 12345", "ﬁ ß ẞ", "<|endoftext|><|endoftext|>", "x\t\ty  \n", "×÷ é", "\x00a", "a  b\n\n c ",
]


def _random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdehinorst'! 12\né.") for _ in range(rng.randrange(120))) for _ in range(n)]


# ---- Matroska --------------------------------------------------------------------


@pytest.mark.parametrize("n", [192, 384, 960, 1152, 7680, 8640, 300_096])
def test_mux_round_trip(n):
    payload = bytes(random.Random(n).randrange(256) for _ in range(n))
    data = matroska.mux(payload)
    media = matroska.parse(data)
    assert matroska.samples(data, media, 1) == payload
    assert [c[0] for c in media.cues] == sorted(c[0] for c in media.cues) and len(media.cues) == media.clusters
    assert all(data[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in media.cues)
    stamps = [p.timestamp_ns for p in media.packets]
    assert stamps == [i * 120_000_000 for i in range(len(stamps))]


def _block(flags, body, track=1, time=0):
    return matroska.element(matroska.SIMPLE_BLOCK, matroska.write_vint(track) + time.to_bytes(2, "big", signed=True) + bytes([flags]) + body)


def _file(cluster):
    head = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"webm"))
    return head + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + cluster


def test_lacing_kinds_unknown_sizes_and_groups():
    frames = [b"a" * 300, b"b" * 5, b"c" * 40]
    xiph = bytes([2]) + b"\xff\x2d" + b"\x05" + b"".join(frames)
    ebml = bytes([2]) + matroska.write_vint(300) + matroska.write_vint(5 - 300 + 8191, 2) + b"".join(frames)
    fixed = bytes([2]) + b"xxyyzz"
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, matroska.write_vint(2) + b"\x00\x07\x00" + b"solo") + matroska.element(matroska.REFERENCE_BLOCK, b"\x01"))
    body = matroska.element(matroska.TIMESTAMP, b"\x0a") + _block(0x82, xiph) + _block(0x06, ebml, time=-3) + _block(0x04, fixed) + group
    unknown = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + body
    data = _file(unknown + matroska.element(matroska.CLUSTER, matroska.element(matroska.TIMESTAMP, b"\x64") + _block(0x80, b"end")))
    media = matroska.parse(data)
    got = [(data[p.offset : p.offset + p.size], p.track, p.timestamp_ns // 10**6, p.cluster, p.keyframe) for p in media.packets]
    assert [g[0] for g in got] == [*frames, *frames, b"xx", b"yy", b"zz", b"solo", b"end"]
    assert got[0][1:] == (1, 10, 0, True) and got[3][2] == 7 and got[9][1:] == (2, 17, 0, False) and got[10][2:4] == (100, 1)


def test_broken_files_give_errors(spark):
    good = matroska.mux(b"x" * 9600)
    rng = random.Random(2)
    files = [good, b"", b"junk", good[:100], None]
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(3):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        files.append(bytes(bad[: rng.randrange(len(bad) + 1)]))
    df = spark.createDataFrame(list(enumerate(files)), "doc_id int, media binary")
    rows = {r.doc_id: r for r in matroska.packet_table(df).collect()}
    assert len(rows) == len(files) and rows[0].error is None and len(rows[0].packets) == 10
    assert all(rows[i].error for i in (1, 2, 3, 4))


def test_stored_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, "q" * 100_000), (99, "q" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = matroska.read_back(matroska.store_texts(docs)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 99}) == 1
    assert matroska.read_back(matroska.store_texts(docs.limit(0))).count() == 0


# ---- Re-Pair ---------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 7, 500, 40_000])
@pytest.mark.parametrize("least", [2, 8])
def test_grammar_round_trip_and_spans(n, least):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50257).astype(np.uint32)
    starts = np.unique(np.concatenate([[0], rng.integers(1, n + 1, max(1, n // 90)), [n]]))
    block = repair.Block(repair.write_block(ids, starts, repair.RePairParams(least_uses=least)))
    assert [x.tolist() for x in block.documents()] == [ids[a:z].tolist() for a, z in zip(starts, starts[1:])]
    assert all((block.document(i) == ids[starts[i] : starts[i + 1]]).all() for i in range(0, block.n_docs, 7))
    for _ in range(20):
        a, z = sorted(rng.integers(0, n + 1, 2))
        assert (block.span(a, min(z, a + 300)) == ids[a : min(z, a + 300)]).all()
    if len(block.grammar):
        flat, at = repair.symbol_table(block.grammar, block.lengths, block.first)

        def expand(x):
            return [x] if x < block.first else [y for part in block.grammar[x - block.first].tolist() for y in expand(part)]

        for x in rng.integers(0, block.first + len(block.grammar), 50).tolist():
            assert flat[at[x] : at[x + 1]].tolist() == expand(x)


def test_repeats_compress():
    ids = np.tile(np.arange(1, 9, dtype=np.uint32), 2000)
    block = repair.Block(repair.write_block(ids, np.array([0, len(ids)])))
    assert len(block.symbols) < len(ids) / 20 and (block.document(0) == ids).all()


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(3)
    passage = rng.integers(1, 40_000, 3_000).astype(np.uint32)
    ids, starts = np.concatenate([np.tile(passage, 40), (rng.zipf(1.2, 200_000) % 40_000).astype(np.uint32), np.full(999, 7, dtype=np.uint32)]), np.arange(0, 120_001, 3_000)
    starts = np.append(starts, len(ids))
    symbols, places, grammar, lengths, first = repair.compress(ids, starts)
    assert (np.diff(places)[:40] == 1).all()
    uses = {}
    for a, z in zip(places, places[1:]):
        last = None
        for pair in zip(symbols[a : z - 1].tolist(), symbols[a + 1 : z].tolist()):
            if pair == last:
                last = None  # the middle of three alike
                continue
            last = pair if pair[0] == pair[1] else None
            uses[pair] = uses.get(pair, 0) + 1
    assert max(uses.values()) < repair.RePairParams().least_uses
    assert (repair.Block(repair.write_block(ids, starts)).document(40) == ids[120_000:]).all()


def _recounted(ids, starts, params):
    """Re-Pair as ``compress`` defines it, but all pairs are counted anew every round."""
    docs = [ids[a:z].tolist() for a, z in zip(starts, starts[1:])]
    first, rules, want = int(ids.max()) + 1, [], params.rules_per_round
    while True:
        uses = {}
        for d, doc in enumerate(docs):
            for i, pair in enumerate(zip(doc, doc[1:])):
                if pair[0] != pair[1] or i == 0 or doc[i - 1] != pair[0] or (d, i - 1) not in uses.get(pair, [])[-1:]:
                    uses.setdefault(pair, []).append((d, i))
        ranked = sorted((p for p in uses if len(uses[p]) >= params.least_uses), key=lambda p: (-len(uses[p]), p))[:want]
        ranked = [p for p in ranked if len(uses[p]) * params.spread >= len(uses[ranked[0]])]
        if not ranked:
            return [x for doc in docs for x in doc], rules
        places = {at: p for p in ranked for at in uses[p]}
        taken = {}
        for d, i in sorted(places):
            if (d, i - 1) not in taken:
                taken[d, i] = places[d, i]
        count = {p: sum(q == p for q in taken.values()) for p in ranked}
        kept = [p for p in ranked if count[p] >= min(max(3, params.least_uses // 2), params.least_uses)]
        if not kept:
            want = 1
            continue
        want = params.rules_per_round
        number = {p: first + len(rules) + k for k, p in enumerate(kept)}
        rules += kept
        for d, doc in enumerate(docs):
            drop = {i + 1 for i in range(len(doc)) if taken.get((d, i)) in number}
            docs[d] = [number.get(taken.get((d, i)), x) for i, x in enumerate(doc) if i not in drop]


@pytest.mark.parametrize("kind", ["words", "few", "runs", "copies"])
def test_grammar_is_that_of_counting_anew(kind):
    rng = np.random.default_rng(len(kind))
    for least, wide, spread in ((2, 3_000, 16), (8, 3_000, 16), (4, 2, 3)):
        n = int(rng.integers(300, 900))
        ids = {
            "words": rng.zipf(1.3, n) % 60,
            "few": rng.integers(0, 3, n),
            "runs": np.repeat(rng.integers(0, 5, n // 4), rng.integers(1, 9, n // 4)),
            "copies": np.tile(rng.integers(0, 40, 70), n // 70 + 1),
        }[kind].astype(np.uint32)
        starts = np.unique(np.concatenate([[0], rng.integers(1, len(ids), 9), [len(ids)]]))
        params = repair.RePairParams(least_uses=least, rules_per_round=wide, spread=spread)
        symbols, _, grammar, _, _ = repair.compress(ids, starts, params)
        want = _recounted(ids, starts, params)
        assert (symbols.tolist(), [tuple(r) for r in grammar.tolist()]) == want


def test_pairs_are_not_counted_anew_every_round(monkeypatch):
    """Rounds look up the places beside new symbols: little of a block is sorted, in one round or many."""
    sorted_, unique = [], np.unique
    monkeypatch.setattr(repair.np, "unique", lambda a, *args, **more: (sorted_.append(np.size(a)), unique(a, *args, **more))[1])
    rng = np.random.default_rng(5)
    words = [rng.integers(1, 3_000, rng.integers(2, 6)) for _ in range(900)]
    ids = np.concatenate([words[i] for i in np.minimum(rng.zipf(1.25, 60_000) - 1, 899)]).astype(np.uint32)
    repair.compress(ids, np.array([0, len(ids)]))
    assert sum(sorted_) < len(ids) / 2


def test_byte_coder_equals_the_library():
    library = Tokenizer.from_file(BYTES)
    texts = [t or "" for t in ODD] + _random_texts(500, 3)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in repair.ByteCoder(BYTES).encode_batch(texts)] == want


def test_rounds_compress_nearly_as_one_pair_at_a_time():
    """Replacing many pairs a round costs little against the most frequent pair alone each time."""
    rng = np.random.default_rng(8)
    words = [rng.integers(1, 3_000, rng.integers(2, 6)) for _ in range(900)]
    ids = np.concatenate([words[i] for i in np.minimum(rng.zipf(1.25, 9_000) - 1, 899)]).astype(np.uint32)
    starts = np.array([0, len(ids)])
    sizes = [len(repair.compress(ids, starts, repair.RePairParams(rules_per_round=n))[0]) for n in (1, 3_000)]
    assert sizes[1] <= 1.03 * sizes[0]


def test_damaged_lengths_are_noticed():
    block = repair.Block(repair.write_block(np.tile(np.arange(1, 9, dtype=np.uint32), 200), np.array([0, 800, 1600])))
    block.lengths = block.lengths + np.uint32(1)
    with pytest.raises(ValueError):
        block.documents()


def test_key_table_is_emptied_and_stays_right():
    from wayfare.llm.wordtable import KeyTable

    rng = np.random.default_rng(1)
    table = KeyTable(limit=50, limit_ids=120)
    for _ in range(60):
        keys = np.unique(rng.integers(0, 400, 30).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        numbers = table.number(keys, lambda new: (np.full(len(new), 2), np.repeat(keys[new] >> np.uint64(40), 2).astype(np.uint32)))
        assert (table.ids(numbers) == np.repeat(keys >> np.uint64(40), 2).astype(np.uint32)).all() and (table.lengths(numbers) == 2).all()
        table.trim()


def test_shards_read_back(spark):
    rows = [(i * 2, t) for i, t in enumerate(ODD + _random_texts(60, 4))] + [(0, "again"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    files = repair.write_shards(docs, BYTES, repair.RePairParams(block_tokens=400))
    got = sorted(repair.read_shards(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    library = Tokenizer.from_file(BYTES)
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert files.count() > 4
    assert repair.read_shards(repair.write_shards(docs.limit(0), BYTES)).count() == 0


# ---- byte pairs --------------------------------------------------------------------


def test_backtracking_equals_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    texts = ODD + _random_texts(300, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(0))
    for r in bpe.tokenize(docs, WORDS, with_ids=True).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert list(r.ids) == ids and r.decoded == decoded and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.tokenize(docs.limit(0), WORDS).count() == 0


def test_backtracking_on_any_rules():
    """Against merging by rank, over random rule sets in which greedy longest matches fail."""
    rng = random.Random(6)
    for _ in range(150):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        for _ in range(rng.randrange(1, 12)):
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        coder = bpe.BacktrackingBpe(vocab, merges)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            parts = list(word)
            for a, b in merges:
                out = []
                for p in parts:
                    if out and out[-1] == a and p == b:
                        out[-1] = (a + b, None)
                    else:
                        out.append(p)
                parts = [p[0] if isinstance(p, tuple) else p for p in out]
            assert coder.encode_word(word) == [vocab[p] for p in parts], (merges, word)
