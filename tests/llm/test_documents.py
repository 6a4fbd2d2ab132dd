"""Operators over documents against brute force, on odd, repeated and empty inputs."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, licenses, lines, minhash, substrings
from tests.llm import brute

SCHEMA = "doc_id long, text string, rep string, pos int, key long, h1 string, item string"


def corpus(n=60, seed=0):
    """Documents with exact and near copies, shared passages and lines, and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "the", "é"]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, line = some(70), "Shared " + " ".join(some(8))
    docs = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and docs:
            text = docs[rng.randrange(len(docs))][1]
        elif kind == 2 and docs:
            w = (docs[rng.randrange(len(docs))][1] or "").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(some(rng.randrange(40)) + passage + some(rng.randrange(40)))
        elif kind == 4:
            text = "\n".join([line, " ".join(some(6)), "  " + line.upper() + "\t", " ".join(some(30))])
        else:
            text = " ".join(some(rng.randrange(1, 200)))
        docs.append((i, text))
    return docs + [(n + i, t) for i, t in enumerate(brute.ODD)]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "rep", 1, 2, "h", "i") for d, t in docs], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("tile", [4, 1024])
def test_near_duplicates(spark, seed, tile):
    docs = corpus(seed=seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, docs), tile=tile).collect()}
    assert got == brute.components(docs)


def test_near_duplicates_without_rows_and_ids(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    got = minhash.near_duplicates(frame(spark, [(None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a b c")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (7, 7), (7, 7)]


def test_pairs_come_from_their_first_bucket_whatever_the_kept_bytes():
    """Kept bytes agree in all bands, but only the second band's key does."""
    import pyarrow as pa

    bands = [[64, 129], [0, 129]]
    n = len(bands)
    row = {"key": [129] * n, "i": [0] * n, "j": [0] * n, "rep": [1, 2], "comp": [1, 2], "side": [0] * n, "bands": bands, "sig": [bytes(8)] * n, "fine": [bytes(minhash.FINE // 2)] * n}
    (batch,) = pa.table(row, schema=pa.schema([(c, pa.list_(pa.int64()) if c == "bands" else pa.binary() if c in ("sig", "fine") else pa.int64()) for c in row])).to_batches()
    (found,) = minhash._across(0.58, 0.677)(iter([batch]))
    assert found.to_pydict() == {"a": [1], "b": [2]}


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for size, overlap in ((1, 1), (3, 1), (40, 30), (1500, 1000)):
        a, b = pool[:size], pool[size - overlap : 2 * size - overlap]
        sig = minhash.super_minhash([np.unique(a), np.unique(b), np.zeros(0, np.uint64)], 250)
        true = overlap / (2 * size - overlap)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.13
        assert (sig[0] != sig[2]).all()


def test_super_minhash_follows_its_definition():
    """Registers against a direct run of the algorithm, permutation by permutation."""
    from tessera.llm import _text

    m, sets = 16, [np.array(x, np.uint64) for x in ([5], [1, 2, 3], list(range(100, 160)))]
    for s, got in zip(sets, minhash.super_minhash(sets, m), strict=True):
        want = [(1 << 64) - 1] * m
        for e in s:
            p = list(range(m))
            for j in range(m):
                x = int(_text.mix(np.array([e + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))], np.uint64))[0])
                k = j + (x & 0xFFFFFFFF) % (m - j)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j << 32 | x >> 32)
        assert got.tolist() == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(20, 60)]
    random.Random(1).shuffle(path)
    star = [(500, i) for i in range(501, 540)]
    links = spark.createDataFrame([*path, *star, (None, 3), (9, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, **{i: 500 for i in range(500, 540)}, 9: 9}
    assert components.components(links.limit(0)).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    for n, m in ((40, 25), (60, 70)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100, 100 + i) for i in range(1, 20)] + [(300 - i, 300) for i in range(1, 20)]
        up = {x: x for p in pairs for x in p}
        for _ in up:
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == up


@pytest.mark.parametrize("heavy_rows", [3, 2000])
def test_line_dedup(spark, heavy_rows):
    docs = corpus(seed=2)
    want = brute.line_dedup(docs)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(frame(spark, docs), heavy_rows=heavy_rows).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 10


def test_line_bitmaps_past_a_word_and_without_broadcast(spark):
    line = "a line of more than twenty characters"
    docs = [(i, "\n".join([*(["x"] * 70), line, line, "y"])) for i in range(4)] + [(None, line)]
    for how in ({}, {"heavy_rows": 2, "broadcast_rows": 0}):
        found = {r["doc_id"]: r for r in lines.line_bitmaps(frame(spark, docs), **how).collect()}
        assert set(found) == {None, 0, 1, 2} and found[0]["n_dropped"] == 2 and [w["word"] for w in found[0]["keep"]] == [1]
        texts = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(spark, docs), **how).collect()}
        assert texts[0] == "\n".join(["x"] * 70 + ["y"]) and texts[3] == docs[3][1] and texts[None] == ""
    assert lines.dedup_lines(frame(spark, [])).count() == 0


ITEMS = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (2, "Short ITEM"), (10, None), (11, "..."), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (4, "ab ab ab ab ab ab ab ab ab ab ab ab"), (5, "never seen before")]


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_contamination(spark, broadcast_rows):
    seven = "W1, w2-w3 w4 w5 (w6) w7"
    docs = [
        (0, f"before {seven} w8 w9 w10 after"),
        (1, f"{seven} w8 w9 w10 w11 w12 short... item!"),
        (2, f"{seven} w8 w9 w11"),
        (3, "ab " * 25),
        (4, "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w1"),
        *[(10 + i, t) for i, t in enumerate(brute.ODD)],
        *[(100 + d, t) for d, t in corpus(20)],
    ]
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, term string")
    want = brute.contamination(docs, ITEMS)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.contamination(frame(spark, docs), items, broadcast_rows=broadcast_rows).collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) >= 4


def test_near_matches(spark):
    """Windows of ITEMS against a search of every place, for replaced, missing, added and moved words."""
    first = ITEMS[0][1].split()
    texts = [
        " ".join([*first[:4], "q", *first[5:]]), " ".join(["x", *first[:6], "q", *first[6:]]), " ".join([*first[:5], *first[6:]]), ITEMS[0][1], " ".join(first[::-1]),
        " ".join([*first[:2], "q", "q", "q", *first[5:]]), "w2 " * 30, " ".join([*first[:3], "q", *first[4:8], "zz", *first[9:]]), None, "", " ".join(first[1:9]), " ".join(["ab"] * 7 + ["no", "ab", "ab", "ab"]),
    ]
    for docs in (list(enumerate(texts)), [(0, texts[0])]):
        got = {(r["doc_id"], r["item_id"], r["start"]): r["in_place"] for r in decontaminate.near_items(frame(spark, docs), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
        assert got == brute.near_matches(docs, ITEMS) and (0, 1, 0) in got


def test_contamination_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, [(2, "x w1 w2 w3 w4 q w6 w7 w8 w9 w10 w11 w12"), (3, "w5 w5 w5")])
    for d, i in ((docs, items.limit(0)), (docs.limit(0), items)):
        found = decontaminate.contamination(d, i).collect()
        assert not any(r["contaminated"] for r in found) and len(found) == d.count()
        assert decontaminate.near_items(d, i).count() == 0


def test_remove_repeats(spark):
    docs = corpus(seed=4) + [(200, "lead " + " ".join(f"u{i}" for i in range(120))), (201, " ".join(f"u{i}" for i in range(30, 90)) + " tail"), (202, " ".join(f"u{i}" for i in range(49)))]
    want = brute.remove_repeats(docs)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(frame(spark, docs)).collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 5
    heavy = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(frame(spark, docs), heavy_runs=2).collect()}
    assert heavy == want
    digests = {r["doc_id"]: r["kept"] for r in substrings.remove_repeats(frame(spark, docs), digest=True).collect()}
    assert digests == {d: hashlib.sha256(w[2].encode()).hexdigest() for d, w in want.items()}


def test_remove_repeats_odd_rows(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    long = " ".join(map(str, range(60)))
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substrings.remove_repeats(frame(spark, [(None, long), (5, long), (5, long), (6, long)])).collect())
    assert got == [(-1, 0), (5, 0), (5, 0), (6, 60)]


def test_small_tables_and_large_ones_join_alike(spark):
    from tessera.llm._shared import small

    ids = spark.createDataFrame([(1,), (2,)], "i long")
    for rows in (2, 1):
        kept = small(ids, "ids", rows)
        assert sorted(r[0] for r in spark.range(5).join(kept, F.col("id") == F.col("i"), "left_anti").collect()) == [0, 3, 4]
    with pytest.raises(ValueError):
        small(spark.createDataFrame([("x",)], "i string"), "texts")


CLASHES = "doc_id long, text string, keep string, n_dropped int, n_lines string, _line_doc string, line_keep int, LINE_DOC int, score string, log_weight string, n_features string, kept string, sampled string, gumbel_key string, n_hit int, rep int, component_id string"


def test_columns_of_clashing_names(spark):
    """Every operator over documents with columns named as its own, and stages that return them."""
    import corpus_pipeline
    from tessera.llm import importance, pieces, suffix_tree

    docs = corpus(12) + [(None, "no id"), (3, "again"), (3, "again")]
    fields = CLASHES.count(",") - 1
    df = spark.createDataFrame([(d, t, *[None] * fields) for d, t in docs], CLASHES).repartition(2)
    plain = df.select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    model = importance.fit(plain, labels)
    rows = lambda x: sorted(map(str, x.collect()))
    out = lines.dedup_lines(df)
    assert rows(out.select("doc_id", "text", "n_lines", "n_dropped")) == rows(lines.dedup_lines(plain)) and "keep" in out.columns
    scored, alone = (importance.resample(importance.score_documents(x, model), model) for x in (df, plain))
    assert rows(scored.select(*alone.columns)) == rows(alone) and len(set(scored.columns)) == len(scored.columns)
    good = importance.keep_good(df, labels)
    assert good.columns == df.columns and rows(good.select("doc_id", "text")) == rows(importance.keep_good(plain, labels))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for f in (minhash.near_duplicates, substrings.remove_repeats, licenses.recognise, suffix_tree.score_texts, pieces.sample_segmentations, lambda x: decontaminate.contamination(x, items)):
        assert rows(f(df)) == rows(f(plain))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        if name != "benchmark_decontamination":
            got = stage(spark, df.withColumn("n_chars", F.length("text")), "")
            assert got.columns == [*df.columns, "n_chars"] and got.count() > 0


def test_texts_longer_than_a_chunk(spark):
    """A text of over 1 MB, handled whole, by the operators that read texts in chunks."""
    from tessera.llm import _text, importance, pieces, suffix_tree

    rng = random.Random(7)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200_000))
    assert len(long) > _text.CHUNK_BYTES and len(long) > pieces.CHUNK
    tail = long[len(long) // 2 :].split(" ", 1)[1]
    docs = [(0, long), (1, "head of its own " + long), (2, tail), (3, "x" * 1_200_000), (4, "short")]
    df = frame(spark, docs)
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert near == brute.components(docs)
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df, digest=True).collect()}
    assert cut == {0: (200_000, 0), 1: (200_004, 200_000), 2: (len(tail.split()), len(tail.split())), 3: (1, 0), 4: (1, 0)}
    features = {r["doc_id"]: r["n_features"] for r in importance.score_documents(df.select("doc_id", "text"), importance.Model(np.ones(importance.BUCKETS))).collect()}
    assert features == {d: 2 * len(t.split()) for d, t in docs}
    scores = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in suffix_tree.score_texts(df).collect()}
    assert {d: s[0] for d, s in scores.items()} == {d: len(t.split()) + 1 for d, t in docs} and all(s[1] < 0 for s in scores.values())
    drawn = pieces.sample_segmentations(df.filter("doc_id in (0, 3)"), k=1).collect()
    assert len(drawn) == 2 and all(r["round_trip"] for r in drawn)
    assert all(len(p) <= 2 * _text.CHUNK_BYTES for p in _text._POWERS)


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 1000, 100)
    for w in (1, 2, 31, 100, 101):
        assert substrings.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(100 - w + 1)]


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    docs = [
        (0, "Text. Released under the MIT License.\nMore"),
        (1, f"{mit}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
        (2, mit.replace("subject to the following conditions:", "").replace(" do so, ", " do so.")),
        (3, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp"),
        (4, "you may obtain a copy of the License at. Licensed under CC BY-NC 4.0. Released under the MIT License. LICENSED under cc-by-nc 4.0!"),
        *[(10 + i, t) for i, t in enumerate(brute.ODD)],
    ]
    got = {r["doc_id"]: (r["matches"], sum(i > 0 for i in r["sentence_ids"]), r["n_sentences"]) for r in licenses.recognise(frame(spark, docs)).collect()}
    assert got[0] == (["MIT"], 1, 3) and got[1] == (["MIT"], 2, 2) and got[2] == (["MIT-0"], 1, 1)
    assert got[3][:2] == (["Apache-2.0"], 3) and got[4][:2] == (["CC-BY-NC-4.0", "MIT"], 4)
    assert got[10] == ([], 0, 0)
    assert licenses.recognise(frame(spark, [])).count() == 0
    assert frame(spark, docs).select(F.count("*")).first()[0] == len(got)


MIT_TEXT = """MIT License

Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_TEXT = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def test_licenses_as_they_stand_in_files(spark):
    comment = lambda text, mark: "".join(f"{mark} {x}\n" if x else f"{mark}\n" for x in text.split("\n"))
    block = lambda text: "/*\n" + "".join(f" * {x}\n" for x in text.split("\n")) + " */\nint main() {}\n"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    cases = [
        (MIT_TEXT, {"MIT"}), (comment(MIT_TEXT, "//"), {"MIT"}), (comment(MIT_TEXT, "#"), {"MIT"}), (block(MIT_TEXT).replace("\n", "\r\n"), {"MIT"}),
        (BSD_TEXT, {"BSD-2-Clause"}), (BSD_TEXT + BSD_THIRD, {"BSD-3-Clause"}), (block(BSD_TEXT + BSD_THIRD), {"BSD-3-Clause"}),
        (GPL_TEXT, {"GPL-3.0-or-later"}), (comment(GPL_TEXT, "#"), {"GPL-3.0-or-later"}), (APACHE_TEXT, {"Apache-2.0"}), (comment(APACHE_TEXT, "//"), {"Apache-2.0"}),
        (isc, {"ISC"}), (lgpl, {"LGPL-2.1-or-later"}), ("// SPDX-License-Identifier: Apache-2.0\nint x;", {"Apache-2.0"}), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", {"GPL-2.0-or-later"}),
        ("This project is licensed under the terms of the MIT license.", {"MIT"}), ("Title\nReleased under the MIT License\nmore text", {"MIT"}),
        ("This work is licensed under a Creative Commons Attribution 4.0\nInternational License.", {"CC-BY-4.0"}),
        ("A permission to use words. The licence of poets is under the sky, version 2.0 of it.", set()), ("no such thing", set()),
    ]
    got = {r["doc_id"]: r["matches"] for r in licenses.recognise(frame(spark, [(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    assert [set(got[i]) for i in range(len(cases))] == [w for _, w in cases]
    own = licenses.recognise(frame(spark, [(0, "You may licence this as\nyou wish. Really.")]), more=(("Own", "You may licence this as you wish. Really."),))
    assert own.first()["matches"] == ["Own"]
