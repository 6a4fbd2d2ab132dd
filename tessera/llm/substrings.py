"""Repeated passages across documents: seed with winnowed anchors, extend, keep maximal repeats.

Each window of ``length`` words contains ``length - anchor + 1`` grams of ``anchor`` words; the
smallest gram hash among them is the window's anchor. Equal windows have equal anchors, so documents
that share a passage of ``length`` words or more share an anchor.

1. The distinct anchors of each document are counted; those of one document alone are dropped.
2. Documents are joined with the anchors they share. From a shared anchor a match is extended both
   ways over all windows that have this anchor, as a run of window hashes. Windows which a smaller
   document of the same batch holds too are settled at once; of each other window only the smallest
   document of the batch goes on, so that a passage in very many documents sends one row for a batch.
3. The runs meet by anchor, and each window finds the smallest document that holds it. An anchor with
   ``heavy_runs`` runs or more, such as a phrase in very many documents with different surroundings,
   is not gathered: its windows meet by their own hashes, as a pre-aggregated minimum, which is joined
   back to them.
4. Adjacent and overlapping windows of a document join to maximal repeats, the words of which go.

Matches are never formed as pairs of documents: a window is compared with the smallest holder of its
word sequence, which decides what is removed. A window is known by its anchor and a 64-bit hash of its
50 word hashes, so that two different ones would have to agree in 128 bits to be taken for equal (in 64
bits within one Arrow batch, which is settled by itself).

Words are runs of bytes other than white space. Null texts have no words. Rows without an id, and
documents of fewer words than a window, keep all words. Rows that repeat an id don't repeat each
other. Empty tables give no rows and further columns are ignored. Whole texts are used whatever their
length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text
from tessera.llm._shared import keep, small

LENGTH, ANCHOR = 50, 20
_CLEAN, _TEXT, _RUN, _SPAN = 0, 1, 2, 3
_SCHEMA = "kind int, doc_id long, anchor long, first int, last int, hashes array<long>, n_words long, text string"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    n, span = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def _anchors(w: _text.Words, length: int, anchor: int) -> list[np.ndarray]:
    """The anchor of each window of each row."""
    g = _text.grams(w, anchor)
    return [
        sliding_min(g[a : b - anchor + 1], length - anchor + 1) if b - a >= length else g[:0]
        for a, b in zip(w.rows[:-1], w.rows[1:], strict=True)
    ]


def _seeder(length: int, anchor: int):
    def seed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.batches(it):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for c in _text.chunks(batch.column(1)):
                found = [np.unique(a) for a in _anchors(_text.words(c), length, anchor)]
                doc = np.repeat(ids[c.first : c.first + len(found)], [len(f) for f in found])
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(doc, pa.int64())], ["anchor", "doc_id"])

    return seed


def _kept(text: bytes, w: _text.Words, row: int, gone: np.ndarray | None, base: int, digest: bool) -> str:
    words = [text[s:e] for s, e in zip((w.start[w.rows[row] : w.rows[row + 1]] - base).tolist(), (w.end[w.rows[row] : w.rows[row + 1]] - base).tolist(), strict=True)]
    if gone is not None:
        words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
    out = b" ".join(words)
    return hashlib.sha256(out).hexdigest() if digest else out.decode()


def _extender(length: int, anchor: int, digest: bool):
    def extend(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.batches(it):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            shared = batch.column(2)
            has = np.asarray(shared.is_valid())
            bounds, values = shared.offsets.to_numpy(), shared.values.to_numpy(zero_copy_only=False).view(np.uint64)
            out: dict[str, list] = {n: [] for n in ("kind", "doc_id", "n_words", "text")}
            hash_of, doc_of, start_of, anchor_of = [], [], [], []
            for c in _text.chunks(batch.column(1)):
                w = _text.words(c)
                whole = _text.grams(w, length)
                anchors = _anchors(w, length, anchor)
                data = c.data.tobytes()
                for r, a in enumerate(anchors):
                    i, n = c.first + r, int(w.rows[r + 1] - w.rows[r])
                    lo, hi = int(c.offsets[r]), int(c.offsets[r + 1])
                    out["doc_id"].append(None if ids[i] is None or ids[i] != ids[i] else int(ids[i]))
                    out["n_words"].append(n)
                    if has[i]:
                        out["kind"].append(_TEXT)
                        out["text"].append(data[lo:hi].decode())
                        at = np.flatnonzero(np.isin(a, values[bounds[i] : bounds[i + 1]]))
                        hash_of.append(whole[w.rows[r] + at])
                        anchor_of.append(a[at])
                        start_of.append(at)
                        doc_of.append(np.full(len(at), ids[i], np.int64))
                    else:
                        out["kind"].append(_CLEAN)
                        out["text"].append(_kept(data[lo:hi], w, r, None, lo, digest))
            n = len(out["kind"])
            none = pa.nulls(n, pa.int32())
            yield pa.record_batch(
                [pa.array(out["kind"], pa.int32()), pa.array(out["doc_id"], pa.int64()), pa.nulls(n, pa.int64()), none, none, pa.nulls(n, pa.list_(pa.int64())), pa.array(out["n_words"], pa.int64()), pa.array(out["text"], pa.string())],
                ["kind", "doc_id", "anchor", "first", "last", "hashes", "n_words", "text"],
            )
            if hash_of:
                h, doc, start, anc = (np.concatenate(x) for x in (hash_of, doc_of, start_of, anchor_of))
                least = _least(h, doc)
                settled = doc > least
                yield from _spans(doc[settled], start[settled], length)
                yield from _runs(h[~settled], doc[~settled], start[~settled], anc[~settled])

    return extend


def _least(h: np.ndarray, doc: np.ndarray, anchor: np.ndarray | None = None) -> np.ndarray:
    """For each window the smallest document that has its hash, and its anchor if that is given."""
    order = np.lexsort((doc, h) if anchor is None else (doc, h, anchor))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if anchor is not None:
        new[1:] |= anchor[order][1:] != anchor[order][:-1]
    group = np.cumsum(new) - 1
    out = np.empty(len(h), doc.dtype)
    out[order] = doc[order][new][group]
    return out


def _table(kind: int, doc: np.ndarray, anchor: pa.Array, first: np.ndarray, last: np.ndarray, hashes: pa.Array) -> pa.RecordBatch:
    n = len(doc)
    return pa.record_batch(
        [pa.array(np.full(n, kind, np.int32)), pa.array(doc, pa.int64()), anchor, pa.array(first, pa.int32()), pa.array(last, pa.int32()), hashes, pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())],
        ["kind", "doc_id", "anchor", "first", "last", "hashes", "n_words", "text"],
    )


def _spans(doc: np.ndarray, start: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Consecutive windows as spans of words."""
    if not len(doc):
        return
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(doc)) - 1
    yield _table(_SPAN, doc[at], pa.nulls(len(at), pa.int64()), start[at], start[end] + length - 1, pa.nulls(len(at), pa.list_(pa.int64())))


def _runs(h: np.ndarray, doc: np.ndarray, start: np.ndarray, anchor: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Consecutive windows of one document and anchor as one row of hashes."""
    if not len(doc):
        return
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1])
    at = np.flatnonzero(new)
    hashes = pa.ListArray.from_arrays(np.append(at, len(doc)).astype(np.int32), h.view(np.int64))
    yield _table(_RUN, doc[at], pa.array(anchor[at].view(np.int64)), start[at], start[at], hashes)


def _meeter(length: int):
    """Rows sorted by anchor: windows held by a smaller document become spans."""

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        lists = rows.column("hashes").combine_chunks() if rows.num_rows else None
        if lists is None:
            return
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        sizes = np.diff(lists.offsets.to_numpy())
        h = lists.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(rows.column("doc_id").to_numpy(), sizes)
        start = np.repeat(rows.column("first").to_numpy(), sizes) + np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        gone = doc > _least(h, doc, np.repeat(rows.column("anchor").to_numpy(), sizes))
        for b in _spans(doc[gone], start[gone], length):
            yield b.select(["doc_id", "first", "last"])

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            anchors = batch.column(0).to_numpy()
            # Rows of the batch's last anchor wait for what the next batch has of it.
            cut = int(np.searchsorted(anchors, anchors[-1], "left"))
            if cut:
                yield from settle(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = []
            elif waiting and waiting[-1].column(0)[0] != batch.column(0)[0]:
                yield from settle(pa.Table.from_batches(waiting))
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield from settle(pa.Table.from_batches(waiting))

    return meet


def _remover(digest: bool):
    def remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.batches(it):
            spans = batch.column(2).to_pylist()
            texts, counts, n_words = [], [], []
            for c in _text.chunks(batch.column(1)):
                w = _text.words(c)
                data = c.data.tobytes()
                for r in range(len(c.offsets) - 1):
                    n = int(w.rows[r + 1] - w.rows[r])
                    gone = np.zeros(n, bool)
                    for s in spans[c.first + r] or ():
                        gone[s["first"] : s["last"] + 1] = True
                    lo, hi = int(c.offsets[r]), int(c.offsets[r + 1])
                    texts.append(_kept(data[lo:hi], w, r, gone, lo, digest))
                    counts.append(int(gone.sum()))
                    n_words.append(n)
            yield pa.record_batch(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return remove


def _heavy_spans(runs: DataFrame, heavy: DataFrame, length: int) -> DataFrame:
    """Windows of heavy anchors that a smaller document holds, as spans."""
    windows = runs.join(heavy, "anchor").select("anchor", "doc_id", "first", F.posexplode("hashes").alias("i", "h"))
    least = windows.groupBy("anchor", "h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least != most")
    start = (F.col("first") + F.col("i")).cast("int")
    return windows.join(least.drop("most"), ["anchor", "h"]).filter("doc_id > least").select("doc_id", start.alias("first"), (start + length - 1).alias("last"))


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, digest: bool = False, heavy_runs: int = 2000
) -> DataFrame:
    """doc_id, n_words, n_removed, kept: kept words joined by one space, or the SHA-256 of that in
    hexadecimal with ``digest``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seeds, _ = keep(
        docs.filter("doc_id is not null").mapInArrow(_seeder(length, anchor), "anchor long, doc_id long"), "anchors"
    )
    met = seeds.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo != hi").select("anchor")
    shared = seeds.join(met, "anchor").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("anchor").alias("anchors"))
    joined = docs.join(shared.hint("shuffle_hash"), F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "anchors")
    parts, _ = keep(joined.mapInArrow(_extender(length, anchor, digest), _SCHEMA), "extended")

    runs = parts.filter(F.col("kind") == _RUN).select("anchor", "doc_id", "first", "hashes")
    heavy = small(runs.groupBy("anchor").count().filter(F.col("count") >= heavy_runs).select("anchor"), "heavy-anchors")
    light = runs.join(heavy, "anchor", "left_anti")
    met_runs = light.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_meeter(length), "doc_id long, first int, last int")
    spans = parts.filter(F.col("kind") == _SPAN).select("doc_id", "first", "last").union(met_runs).union(_heavy_spans(runs, heavy, length))
    by_doc = spans.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    touched = parts.filter(F.col("kind") == _TEXT).select("doc_id", "text")
    cut = (
        touched.join(by_doc.hint("shuffle_hash"), F.col("doc_id") == F.col("_doc"), "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_remover(digest), "doc_id long, n_words long, n_removed long, kept string")
    )
    clean = parts.filter(F.col("kind") == _CLEAN).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept")
    )
    return cut.union(clean)
