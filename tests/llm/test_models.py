"""Chat, classifier, language model, search and segmentation."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _text, chat, importance, pieces, suffix_tree, topk
from tests.llm import brute

TOLD = r"\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    texts = [TOLD, None, "", "###", "#### #\\## \\", "</turn>\n### user: x", "<\\/turn>", "a\\\\</turn>", "é☃"]
    rows = [(1, i, ("user", "user", "assistant", None, "a: b\n### c")[i % 5], t, "x") for i, t in enumerate(texts)]
    rows += [(2, None, "assistant", "late", "x"), (2, 0, "assistant", "b", "x"), (2, 0, "assistant", "a", "x"), (2, 0, "assistant", "a", "x"), (None, 0, "user", "q", "x"), (3, 0, "user", "only", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, blocks string").repartition(3)
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert chat.read_back(got[1]["formatted"]) == [(r[2] or "", r[3] or "") for r in rows[: len(texts)]]
    assert chat.masked_text(got[1]["formatted"], got[1]["loss_runs"]) == "".join(r[3] or "" for r in rows[: len(texts)] if r[2] == "assistant")
    assert [t for _, t in chat.read_back(got[2]["formatted"])] == ["late", "a", "a", "b"] and got[2]["formatted"].count("### ") == 1
    assert chat.masked_text(got[3]["formatted"], got[3]["loss_runs"]) == "" and got[None]["n_turns"] == 1
    assert sum(r["skip"] + r["size"] for r in got[1]["loss_runs"]) + len(chat.TURN_END) == len(got[1]["formatted"])
    assert chat.format_chats(df.limit(0)).count() == 0


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, 0.0, "k") for d, t in rows], "doc_id long, text string, score double, row string").repartition(3)


def test_classifier_separates_held_out_documents(spark):
    rng = np.random.default_rng(0)
    syllables = ["an", "er", "th", "on", "re", "he", "in", "ed"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    good = lambda: " ".join(word() for _ in range(60)).capitalize() + "."
    bad = [lambda: " ".join(word().upper() + "!!" for _ in range(60)), lambda: " ".join([word()] * 9 + [word()] * 9), lambda: " ".join(word() + "$$$" for _ in range(60))]
    rows = [(i, good() if i % 4 else bad[i // 4 % 3]()) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*rows, *[(1000 + i, t) for i, t in enumerate(brute.ODD)]], "doc_id long, text string").repartition(3)
    model = importance.fit(docs, labels)
    out = importance.resample(importance.score_documents(docs, model).cache(), model).toPandas().set_index("doc_id")
    unseen = [i for i in range(400, 600)]
    assert np.mean([out.loc[i, "kept"] == (i % 4 > 0) for i in unseen]) > 0.98
    assert not out.loc[1000, "kept"] and not out.loc[1000, "sampled"] and out.loc[1000, "n_features"] == 0
    with_words = out[out["n_features"] > 0]
    k = math.ceil(len(with_words) / 2)
    top = set(with_words.sort_values("gumbel_key").index[-k:])
    assert set(out.index[out["sampled"]]) == top
    assert set(importance.keep_good(docs, labels).toPandas()["doc_id"]) == set(out.index[out["kept"]])


def test_classifier_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["doc_id"] for r in importance.keep_good(docs, labels).collect()] == [1]
    assert importance.keep_good(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("values", [[3.0, -1.5, 0.0, -0.0, 2.0**60, -1e300, 1e-300, 3.0], [5.0]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, len(values) + 1):
        assert importance.kth_largest(df, "x", k) == sorted(values)[-k]
    assert importance.kth_largest(df, "x", len(values) + 1) is None


def test_language_model(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["the", "The", "cat", "dog", "é", f"r{rng.integers(50)}"], rng.integers(1, 40)))) for i in range(120)]
    rows += [(200 + i, t) for i, t in enumerate(brute.ODD)] + [(500, "twice twice the"), (500, "twice twice the"), (None, "no id")]
    got = suffix_tree.score_texts(docs_of(spark, rows), frequent_share=0.02).toPandas()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*brute.words(t), None])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    by = {None if math.isnan(r.doc_id) else int(r.doc_id): r for r in got.itertuples()}
    for d, t in rows:
        w = [*brute.words(t), None]
        r = by[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert suffix_tree.score_texts(docs_of(spark, [])).count() == 0


def test_tree_scores_by_definition(spark):
    """Scores of the table against the plain definition, in one pass and in many."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("".join(rng.choice(["ab", "ac", "bd", "É"], rng.integers(1, 5))) for _ in range(rng.integers(1, 60)))) for i in range(90)]
    rows += [(200 + i, t) for i, t in enumerate(brute.ODD)] + [(500, "twice ab"), (500, "twice ab"), (None, "no id")]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    want = brute.tree_scores([t for d, t in rows if not held(d)], [t for _, t in rows], 4.0, 2.0)
    texts = {d: w for (d, _), w in zip(rows, want, strict=True)}
    for tree_bytes in (64 << 20, 3000):
        got = suffix_tree.score_texts(docs_of(spark, rows), gain=4.0, strength=2.0, tree_bytes=tree_bytes).toPandas()
        assert len(got) == len(rows)
        for r in got.itertuples():
            assert r.score == pytest.approx(texts[None if math.isnan(r.doc_id) else int(r.doc_id)], rel=1e-5)


def test_tree_is_a_distribution():
    rng = np.random.default_rng(3)
    (c,) = _text.chunks(pa.array(["".join(rng.choice(["abcd e", "xbcd f"], rng.integers(1, 30))) for _ in range(200)]))
    g, _ = suffix_tree._grams(c)
    keys, counts = suffix_tree._counted(g)
    trunk = suffix_tree.Trunk(*suffix_tree._counted(g & np.uint64((1 << 24) - 1)), 8.0, 2)
    grown = suffix_tree.grow(keys, counts, trunk, 10.0, 8.0, 2)
    assert len(grown[2 * suffix_tree.TRUNK][0]) >= 2
    rows = pa.table({"part": pa.array(list(grown), pa.int32()), "id": [k.tobytes() for k, _ in grown.values()], "s": [v.astype(np.float32).tobytes() for _, v in grown.values()]})
    scorer = suffix_tree.Scorer(suffix_tree._tree_of(rows, trunk))
    for context in [*(keys[:: len(keys) // 7] >> np.uint64(8)).tolist(), 0, 0x7A7A7A7A7A7A]:
        every = np.uint64(context << 8) | np.arange(256, dtype=np.uint64)
        assert (10.0 ** scorer.log_p(every)).sum() == pytest.approx(1, abs=1e-4)


def test_tree_does_not_depend_on_the_size_of_the_corpus():
    """A context that is significant stays so beside any number of others."""
    few, _ = np.unique(np.array([int.from_bytes(b, "big") for b in (b"xyzzyq!", b"abzzyq?")], np.uint64)), 0
    many = np.array([int.from_bytes(b"common!", "big")], np.uint64)
    for n in (0, 10**9):
        keys = np.sort(np.concatenate([few, many]))
        counts = np.where(keys == many[0], n + 1, 40)
        size = np.uint64((1 << 24) - 1)
        trunk = suffix_tree.Trunk(*suffix_tree._merge([(keys & size, counts)]), 8.0, 2)
        grown = suffix_tree.grow(keys, counts, trunk, 10.0, 8.0, 2)
        at = _text.mix(np.array([int.from_bytes(b"zzyq", "big"), int.from_bytes(b"yzzyq", "big")], np.uint64))
        assert at[1] in grown[2 * 5 + 1][0] and at[0] in grown[2 * 4 + 1][0]


def test_lattices_hold_the_librarys_segmentation_of_runs_of_spaces():
    texts = ["a b", "def f(x):\n    if x:\n        return   1  ", "  ", "   lead", "x" + " " * 40 + "y"]
    texts = [t.replace("a b", "a    b") for t in texts]
    with open(pieces.default_model(), "rb") as f:
        v = pieces._vocabulary(f.read(), 1.0)
    (c,) = _text.chunks(pa.array(texts))
    data, start, end, rows = pieces._units(c)
    words, w_start, w_end, which = pieces._distinct(data, start, end)
    lat = pieces._Lattices(v, words, w_start, w_end)
    edges = set(zip(lat.src.tolist(), lat.dst.tolist(), lat.piece.tolist(), strict=True))
    for r, ids in enumerate(pieces.encode(texts)):
        unit = int(rows[r])
        at = int(w_start[which[unit]])
        for p in ids:
            to = at + int(v.size[p])
            assert (at, to, p) in edges
            at = to
            if at == w_end[which[unit]] and unit + 1 < rows[r + 1]:
                unit += 1
                at = int(w_start[which[unit]])
        assert unit + 1 == rows[r + 1] and at == w_end[which[unit]]


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)], 0) for i in range(230)]
    rows += [(300 + i, [0.5] * 6, 0) for i in range(40)] + [(500, None, 0), (501, [None] * 6, 0), (502, [float("nan")] * 6, 0), (503, [float("inf")] * 6, 0), (None, [1.0] * 6, 0)]
    rows += [(505, [], 0), (506, [2.0, 1.0], 0), (507, [1e30, 1.0, 0, 0, 0, -1.0], 0), (50, [0.25] * 6, 0)]
    rows += [(550, [-131072.0, 1, 0, 0, 0, 0], 0), (100, [-9.0, None, 0, 0, 0, 0], 0), (150, [float("-inf")] * 6, 0), (508, [2e5, -3.0], 0)]
    rows = [(i, v if v is None else [x if x is None else float(x) for x in v], r) for i, v, r in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(4)
    from pyspark.sql import functions as F

    usable = [(i, [math.floor(256 * Fraction(float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in usable:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    want = {}
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in usable if i != q)
        want[q] = [(r, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scored[:5], 1)]
    for group_bytes in (16 << 20, 64):
        got = {}
        for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0, group_bytes=group_bytes).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {q: [(x[0], x[2]) for x in g] for q, g in got.items()} == {q: [(x[0], x[2]) for x in g] for q, g in want.items()}
        assert got == want
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


V = None


def vocabulary():
    global V
    if V is None:
        with open(pieces.default_model(), "rb") as f:
            V = pieces.Vocabulary(f.read(), 1.0)
    return V


def segmentations(text):
    """{pieces: probability} of all segmentations."""
    v = vocabulary()
    b = b" " + text.encode()
    index = {x: i for i, x in enumerate(v.bytes) if x and b" " not in x[1:] and i > 258}

    def rest(i):
        if i == len(b):
            yield (), 0.0
        for j in range(i + 1, len(b) + 1):
            if b[i:j] in index:
                for p, w in rest(j):
                    yield (index[b[i:j]], *p), w + v.weight[index[b[i:j]]]

    found = list(rest(0))
    total = np.logaddexp.reduce([w for _, w in found])
    return {p: math.exp(w - total) for p, w in found}


def draw(texts, k, keys=None):
    column = pa.array(texts)
    out = []
    for c in _text.chunks(column, pieces.CHUNK):
        hashed = _text.mix((np.arange(len(texts)) if keys is None else np.array(keys)).astype(np.uint64))
        out += [(r + c.first, *x) for r, *x in pieces._segment(vocabulary(), c, hashed[c.first :], k, True)]
    return out


@pytest.mark.parametrize("deep", [40.0, 0.3])
def test_sampling_without_replacement_follows_the_distribution(monkeypatch, deep):
    monkeypatch.setattr(pieces._Search, "DEEP", deep)
    text, n = "an in", 6000
    exact = segmentations(text)
    got = draw([text] * n, 3)
    first = Counter(tuple(x[2]) for x in got if x[1] == 0)
    second = Counter(tuple(x[2]) for x in got if x[1] == 1)
    for p, q in exact.items():
        assert abs(first[p] / n - q) < 5 * math.sqrt(q / n) + 1e-3
        want = sum(a * q / (1 - a) for o, a in exact.items() if o != p)
        assert abs(second[p] / n - want) < 5 * math.sqrt(want / n) + 1e-3
    assert all(len({tuple(x[2]) for x in got[i : i + 3]}) == 3 for i in range(0, 3 * n, 3))
    assert max(abs(x[3] - math.log(exact[tuple(x[2])])) for x in got) < 1e-9
    # Weighted by the inverse of their inclusion scores, samples stand for all segmentations.
    assert abs(sum(math.exp(x[3] - x[5]) for x in got) / n - 1) < 0.05


def test_sampling_runs_out_and_is_seeded_by_key():
    few = segmentations("I")
    got = draw(["I"], len(few) + 5)
    assert {tuple(x[2]) for x in got} == set(few) and all(x[5] == 0.0 for x in got)
    texts = ["some words here", "ünïcode ☃ ▁ x\n\ny", "", "  two  spaces ", "some words here"]
    a, b = draw(texts, 2, [1, 2, 3, 4, 1]), draw(texts[::-1], 2, [1, 4, 3, 2, 1])
    plain = lambda rows, r: [[y.tolist() if isinstance(y, np.ndarray) else y for y in x[1:]] for x in rows if x[0] == r]
    assert plain(a, 1) == plain(b, 3) and plain(a, 0) == plain(a, 4)
    assert all(x[6] for x in a) and pieces.decode([x[2] for x in a if x[1] == 0]) == texts


def test_sampling_of_a_table(spark):
    rows = [(i, t, 0.0, "k") for i, t in enumerate(brute.ODD)] + [(None, "null key", 0.0, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sample double, pieces string").repartition(2)
    got = pieces.sample_segmentations(df, k=2).collect()
    assert all(r["round_trip"] for r in got) and {r["key"] for r in got} == {r[0] for r in rows}
    texts = {r[0]: r[1] for r in rows}
    assert all(pieces.decode([r["pieces"]])[0] == (texts[r["key"]] or "") for r in got)
    assert all(r["log_inclusion"] <= 0 for r in got)
    sizes = {(r["key"], r["sample"]): r["n_pieces"] for r in pieces.sample_segmentations(df, k=2, with_pieces=False).collect()}
    assert sizes == {(r["key"], r["sample"]): len(r["pieces"]) for r in got}
    assert pieces.sample_segmentations(df.limit(0)).count() == 0
    assert pieces.decode(pieces.encode(["Hello  wörld\n"]))[0] == "Hello  wörld\n"


def test_query_of_segmentations_gives_pieces_and_the_librarys_own(spark, tmp_path):
    from tessera.llm import queries

    rows = [(i, t) for i, t in enumerate([*brute.ODD, "some words here", "def f(x):\n    return   1", "a▁b"])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["sample"]): r for r in queries.op9_sentencepiece_sampling(spark, str(tmp_path)).collect()}
    texts = {d: t or "" for d, t in rows}
    own = pieces.encode(list(texts.values()))
    assert {d: got[d, -1]["pieces"] for d in texts} == dict(zip(texts, own, strict=True))
    assert {d for d, s in got if s == 0} == set(texts)
    for (d, s), r in got.items():
        assert r["n_pieces"] == len(r["pieces"]) and (s < 0) == (r["log_prob"] is None)
        assert r["round_trip"] == (pieces.decode([r["pieces"]])[0] == texts[d]) and (r["round_trip"] or s < 0 and "▁" in texts[d])
        assert s != 1 or r["pieces"] != got[d, 0]["pieces"]


def test_library_encodes_each_word_once(monkeypatch):
    import sentencepiece

    with open(pieces.default_model(), "rb") as f:
        proto = SimpleNamespace(value=f.read())
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "▁", "a", "the", "ü☃", "\t", "　", "🙂", "\x00", "return", "\r\n", "<0x0A>", "x" * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["", None, "\n", " ", "x" * 9000]
    plain = [t or "" for t in texts]
    want = pieces.encode(plain)
    run = lambda t: [r for b in pieces._encoder(proto)(iter([pa.record_batch([pa.array(range(len(t))), pa.array(t)], ["key", "text"])])) for r in b.to_pylist()]
    got = run(texts)
    assert [r["key"] for r in got] == list(range(len(texts))) and [r["pieces"] for r in got] == want
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
    assert [r["round_trip"] for r in got] == [a == b for a, b in zip(sp.decode(want), plain, strict=True)]
    seen, real = [], sentencepiece.SentencePieceProcessor.encode
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", lambda self, x, **o: seen.extend(x) or real(self, x, **o))
    often = ["some words here " * 2000] * 3
    assert [r["pieces"] for r in run(often)] == real(sp, often) and sum(map(len, seen)) < 1000
    # Models whose pieces may cross words: whole texts.
    monkeypatch.setattr(pieces._library(proto.value), "by_words", False)
    assert run(texts) == got
    pieces._library.cache_clear()


def test_query_of_segmentations_reads_the_documents_once(spark, tmp_path, capsys):
    from tessera.llm import queries

    spark.createDataFrame([(1, "some words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries.op9_sentencepiece_sampling(spark, str(tmp_path)).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1
