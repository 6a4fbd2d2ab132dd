"""The pipeline against its stages in plain Python."""

from __future__ import annotations

import random

import corpus_pipeline
from tessera.llm import importance, pieces
from tests.llm import brute


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    line, item = some(9), some(12)
    texts = []
    for i in range(120):
        text = some(rng.randrange(20, 80))
        if i % 5 == 1:
            text = text.upper().replace(" ", "!! ")
        elif i % 5 == 2:
            text = f"{text}\n{line}\n{some(20)}"
        elif i % 5 == 3 and texts:
            text = texts[rng.randrange(len(texts))]
        elif i % 15 == 4:
            text = f"{text} {item} {some(5)}"
        texts.append(text)
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, "en", "s", None), (901, "", None, "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 5 != 1 and not texts[i].isupper()), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = sorted((r["doc_id"], r["text"]) for r in importance.keep_good(table, labels).collect())
    assert not any("!!" in t for _, t in kept) and len(kept) > 70
    lined = [(d, t) for d, (_, _, t) in brute.line_dedup(kept).items() if t.strip(" \t\n\x0b\x0c\r")]
    groups = brute.components(lined)
    single = [(d, t) for d, t in lined if groups[d][1] == d]
    hits = brute.contamination(single, [(1, item)])
    want = {d: t for d, t in single if not hits[d][1]}
    assert len(want) < len(single) < len(lined) and set(got) == set(want)
    assert {d: pieces.decode([r["pieces"]])[0] for d, r in got.items()} == want
    assert all(r["round_trip"] and r["n_pieces"] == len(r["pieces"]) for r in got.values())


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() == 0


def test_last_stage_samples_without_replacement(spark, tmp_path):
    texts = {1: "some words here", 2: "", 3: "I"}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["sample"]): r for r in corpus_pipeline.encoding(spark, docs, str(tmp_path)).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)}
    assert all(got[d, 0]["pieces"] != got[d, 1]["pieces"] for d in (1, 3)) and got[1, 0]["perturbed"] > got[1, 1]["perturbed"]
    assert all(pieces.decode([r["pieces"]])[0] == texts[d] and r["round_trip"] for (d, _), r in got.items())
    assert got[1, 1]["log_inclusion"] < 0 and got[2, 0]["log_inclusion"] == 0
