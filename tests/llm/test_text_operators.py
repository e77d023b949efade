"""Language ID, quality, mixing, sharding, licenses and fingerprints."""

import hashlib
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from wayfare.llm import fingerprint, langid, licenses, mixing, quality_fm, sharding

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_accuracy(spark, docs):
    rows = langid.language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, docs):
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !! 😀"), (None, "a"), (5, "der " * 200_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[5][0] == "de" and got[None][0] in model.languages
    nothing = langid.train(docs.limit(0), F.lit(True))
    assert [r.lang_pred for r in langid.predict(odd, nothing).collect()] == ["und"] * 5


def test_sum_of_squares_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    params = quality_fm.FmParams(word_bits=4, rank=3)
    n = quality_fm.n_features(params)
    model = quality_fm.FmModel(0.3, rng.normal(size=n), rng.normal(size=(n, 3)), params)
    at, x = quality_fm.features("some words and some more words", 30.0, params)
    pairs = sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i + 1, len(at)))
    assert quality_fm.raw_score(at, x, model) == pytest.approx(model.bias + model.linear[at] @ x + pairs)


def test_quality_held_out_accuracy(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_fm.quality_of(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_quality_edge_cases(spark, docs):
    none = quality_fm.fit([])
    odd = spark.createDataFrame([(1, None, None), (2, "", 0), (None, "x", 1)], "doc_id long, text string, n_chars long")
    assert [r.score for r in quality_fm.score(odd, none).collect()] == [0.5] * 3
    empty = docs.limit(0)
    assert quality_fm.quality_of(empty, spark.read.parquet(f"{SF}/labels.parquet")).count() == 0


def _fill(sizes):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        more = {s for s in order if s not in full and target[s] > 3 * sizes[s] + 1e-9}
        if not more:
            return target
        full |= more


def test_mix_targets_and_bounds(spark):
    rows = [(i, f"{'w ' * (1 + i % 40)}", ["a", "b", "é", None, "Z"][i % 5] if i > 30 else "a") for i in range(2000)]
    rows += [(9000, None, "empty"), (9001, "  ", "empty"), (None, "x", "b"), (5, "again", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = _fill(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 40 for s in want)
    assert sorted(got, key=str) == sorted(mixing.mix(docs).collect(), key=str)
    copies = {}
    for r in got:
        copies[r.doc_id] = max(copies.get(r.doc_id, 0), r.copies)
    clash = docs.withColumns({"of": F.lit(1), "copy": F.lit(2), "seed": F.lit(3), "rate": F.lit("x")})
    assert mixing.emit(clash).columns == clash.columns
    emitted = mixing.emit(clash).groupBy("doc_id").count().collect()
    rows_of = {}
    for i, _, _ in rows:
        rows_of[i] = rows_of.get(i, 0) + 1
    assert {r.doc_id: r["count"] for r in emitted} == {i: n * rows_of[i] for i, n in copies.items() if n}


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    only = spark.createDataFrame([(1, "", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(only).collect()] == [(0.0, 0)]


def test_shards(spark):
    rows = [(i, "é" * (i % 7)) for i in range(3000)] + [(1, "dup"), (1, "dup"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard_documents(docs).collect()
    text = {}
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        text.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in text.values())
    assert {r.shard for r in got if r.doc_id == 1}.__len__() == 1
    assert sum(r.grown_shard == 16 for r in got) == pytest.approx(len(rows) / 17, rel=0.3)
    by = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert by == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}


def test_weight_changes_move_rows_only_in_their_subtree(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    root = sharding.tree(16)
    heavy = sharding.Node("root", (root.children[0], sharding.Node("region1", (root.children[1].children[0], sharding.Node("rack3", (*root.children[1].children[1].children[:-1], sharding.Leaf("shard15", 15, 0.0)))))))
    got = ids.select(sharding.descend(F.col("doc_id"), root).alias("a"), sharding.descend(F.col("doc_id"), heavy).alias("b")).collect()
    assert all(r.b != 15 for r in got)
    assert all(r.a == r.b for r in got if r.a < 8), "rows of the unchanged region stay"
    assert all(r.b < 12 or r.a == r.b or r.a == 15 for r in got)


_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _places(text):
    w = _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        found += at
        labels |= {label} if at else set()
    return len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


ODD = [
    "mit license", "MIT License mit license", "CC BY cc by CC-BY-NC-SA 4.0 cc by", "Licensed under the Apache License, Version 2.0", None, "", " .. ", "xmit license",
    "SPDX-License-Identifier: Apache-2.0", "é mit license é", "\x00mit\x00license", "İmit license K mit license", "BSD 3-Clause License; gnu lesser general public license version 2.1",
    "released under the mit license. " * 700, "gnu gnu general public license license",
]


def test_license_places_equal_brute_force(spark, docs):
    rows = list(enumerate(ODD))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _places(ODD[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    whole = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for d in docs.collect():
        r = whole[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _places(d.text)


def test_license_scan_of_nothing_and_of_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(empty).count() == 0
    long = "plain words here " * 40_000 + "MIT License"
    r = licenses.scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (120_002, 1, 120_000, 120_000, "mit")


def test_license_rules_and_suppression(spark):
    texts = ["licensed under the gnu general public license, version 3.0", "spdx-license-identifier: mit", "apache license and apache license 2.0", "nothing"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].labels == "gpl,gpl-3.0" and len(got[0].spans) == 1
    assert got[1].labels == "mit" and got[1].score == 1.0
    assert got[2].labels == "apache,apache-2.0" and [s.first_word for s in got[2].spans] == [0, 3]
    assert got[3].labels == "" and got[3].score == 0.0
    table = licenses.rules()
    assert len(table) >= 200
    assert [r.tier for r in table] == sorted(r.tier for r in table)


LICENSED = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-3-clause",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-4-clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.": "zlib",
    "you may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl,gpl-2.0-or-later",
    "GNU General Public License version 2 as published by the Free Software Foundation": "gpl,gpl-2.0-only",
    "the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": "lgpl-2.1-or-later",
    "the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version": "agpl-3.0-or-later",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "made available under the terms of the Eclipse Public License v1.0": "epl-1.0",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa-4.0",
    "Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa-4.0",
    "see https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0",
    "released as CC0, or CC0 1.0 Universal": "cc0,cc0-1.0",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "This work is in the public domain": "public-domain",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0-or-later",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause": "apache-2.0,bsd-3-clause,mit",
    "SPDX-License-Identifier: MIT\n// the apache helicopter": "mit",
    "a licence to practise, the warranty of the car, permission to land; the isc group and a bsd box": "",
    "gnu are antelopes, apache is a people, cc me by mail": "",
}


def test_license_texts_and_notices(spark):
    rows = list(enumerate(LICENSED))
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {text: got[i] for i, text in rows} == LICENSED


def _samples(tree, whole):
    """Texts that a rule's pattern matches: with every optional part, or without, by each branch."""
    import re._constants as c

    out = [""]
    for kind, value in tree:
        if kind is c.LITERAL:
            parts = [chr(value)]
        elif kind is c.NOT_LITERAL:
            parts = ["a"]
        elif kind is c.IN:
            parts = [chr(v) for k, v in value if k is c.LITERAL]
        elif kind is c.MAX_REPEAT or kind is c.MIN_REPEAT:
            low, high, inside = value
            n = max(low, 1) if whole else low
            parts = _samples(inside, whole) if n else [""]
        elif kind is c.SUBPATTERN:
            parts = _samples(value[3], whole)
        elif kind is c.BRANCH:
            parts = [x for branch in value[1] for x in _samples(branch, whole)]
        else:
            parts = [""]  # what may not follow
        out = [a + b for a in out for b in parts][:12]
    return out


def _brute_spans(spaced):
    """Every rule's matches, and of those the ones that no other of the same or a stronger tier holds."""
    import regex

    found = []
    for number, r in enumerate(licenses.rules()):
        for m in regex.finditer(licenses._pattern(r.pattern), spaced):
            first = spaced.count(" ", 0, m.start()) - 1
            found.append((first, first + m[0].count(" "), r.tier, number, r.label))
    held = lambda m, o: o is not m and o[0] <= m[0] and o[1] >= m[1] and o[2] <= m[2] and (o[:2] != m[:2] or (o[2], o[3]) < (m[2], m[3]))
    return sorted((m[0], m[1] - m[0] + 1, m[4], m[2]) for m in found if not any(held(m, o) for o in found))


def test_every_rule_and_suppression_by_brute_force(spark):
    import re._parser as parser
    import random

    import regex

    from wayfare.llm import license_rules

    texts = []
    for r in licenses.rules():
        tag = r.tier == license_rules.TAG
        words = r.pattern.split("(?:(?<=")[0][3:-1] if tag else r.pattern
        for whole in (True, False):
            for text in _samples(parser.parse(words), whole):
                text = f"spdx license identifier {text}" if tag else text
                assert r.keyword in text and any(s in f" {text} " for s in license_rules.STEMS), (r, text)
                assert regex.search(licenses._pattern(r.pattern), f" {text} "), (r, text)
                texts.append(text)
    rng = random.Random(3)
    texts += [" and ".join(rng.sample(texts, 6)) for _ in range(150)] + [" ".join(rng.sample(texts, 3)) for _ in range(150)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        spans = sorted((s.first_word, s.words, s.label, s.tier) for s in got[i].spans)
        assert spans == _brute_spans(f" {text} "), text


def _canon(t):
    n = lambda x: unicodedata.normalize("NFKC", x)
    return " ".join(n(n(t or "").casefold()).split())


def test_canonical_digests(spark):
    texts = ["ﬁ Café  A", "fi café a", "FI CAFÉ A ", "Straße", "STRASSE", None, "", " \t\n", "a b", "A B", "x y", "Σίσυφος", "ΣΊΣΥΦΟΣ", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("form", F.lit(0))
    got = {r.doc_id: r for r in fingerprint.exact_groups(docs).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i].fingerprint == got[j].fingerprint) == (_canon(a) == _canon(b)), (a, b)
    assert got[4].group_id == 3


def test_forced_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda form: F.when(F.length(form) >= 0, F.lit("0" * 32)))
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "A"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert got[0] == got[2] and len(set(got.values())) == 3


@pytest.mark.parametrize("per_range", [3, 2000])
def test_edited_texts(spark, monkeypatch, per_range):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", per_range)
    rows = [(i * 3, "".join(chr(97 + (i * j) % 26) + ("é" if j % 9 == 0 else " ") for j in range(i * 5 % 60))) for i in range(40)] + [(200, None), (201, "same text"), (202, "SAME  text")]
    got = {r.doc_id: r for r in fingerprint.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        t, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(_canon(t) == _canon(edited)) and r.near_next == float(_canon(t) == _canon(after))


def test_edited_texts_of_tiny_tables(spark):
    d = spark.createDataFrame([(1, "abcdefgh"), (1, "abcdefgh"), (None, "zz")], "doc_id long, text string")
    assert fingerprint.edited_pairs(d.limit(0)).count() == 0
    assert fingerprint.edited_pairs(d.limit(1)).first().near_next == 1.0
    assert fingerprint.edited_pairs(d).count() == 3
