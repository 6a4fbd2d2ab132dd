"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set is that of its distinct 5-word shingles. Documents are linked if the Jaccard
similarity of their sets is at least ``percent`` / 100; links are confirmed on the full sets.

1. One scan gives each document the size and a 128-bit digest of its set, a SuperMinHash signature of
   ``bands * rows`` registers, hashed by bands, and a byte of each register.
2. Documents with equal sets become one class, represented by the smallest id (pre-aggregated).
3. Representatives with an equal band are a bucket, whose hub is the member that meets most others
   in all its buckets. Each representative is compared with one hub; confirmed links are joined by
   union-find.
4. Buckets that still hold several components are compared across components, tile by tile: pairs
   whose signatures agree in a share of ``coarse`` of their registers, and whose finer ones of 512
   registers in ``fine_share``, are confirmed on the full sets too, and joined.

No bucket is capped: what step 3 skips, step 4 compares unless both are of one component already, so
that a group of copies costs a comparison for each copy instead of one for each pair. Signatures are
compared in tiles of ``tile`` members, spread over tasks, however large a bucket is. A pair at the
threshold shares no band with probability (1 - 0.75**4)**36 = 1.1e-6; it falls below ``coarse`` or
``fine_share`` as seldom (both lie 4.7 standard deviations below what is expected of it).

Words are runs of bytes other than white space, A-Z lower-cased. A text of 1 to 4 words is one
shingle; a null text or one without words has none and is linked with nothing. Rows without an id get
no component. Rows that repeat an id should repeat its text. Empty tables give no rows, and further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text
from tessera.llm._shared import discard, keep, small
from tessera.llm.components import components

SHINGLE = 5
_U = np.uint64
_EMPTY = _U((1 << 64) - 1)
#: Elements whose permutations are held at a time.
_ELEMENTS = 100_000
#: Steps of a permutation that are traced back before it is laid out.
_TRACED = 4


def shingle_sets(chunk: _text.Chunk, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a chunk."""
    w = _text.words(chunk, lower=True)
    g = _text.grams(w, size)
    out = []
    for a, b in zip(w.rows[:-1], w.rows[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            few = np.array([b - a], _U)
            for h in w.hash[a:b]:
                few = _text.mix(few * _U(0x9E3779B97F4A7C15) ^ h)
            out.append(few)
        else:
            out.append(np.zeros(0, _U))
    return out


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (len(sets), m) of sets of 64-bit hashes.

    Every element draws a random permutation of the m registers step by step; step j offers the value
    j + r, r in [0, 1), to one register. A register keeps its smallest offer. As no later step offers
    less than its number, a set is done once its largest register is below the next step. Values are
    fixed-point numbers: the step in the upper, r in the lower 32 bits. m must not exceed 256.
    """
    out = np.full((len(sets), m), _EMPTY, _U)
    sizes = np.array([len(s) for s in sets])
    at = 0
    while at < len(sets):
        to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), _ELEMENTS, "right")) + at)
        _signatures(sets[at:to], sizes[at:to], out[at:to])
        at = to
    return out


def _signatures(sets: list[np.ndarray], sizes: np.ndarray, out: np.ndarray) -> None:
    m = out.shape[1]
    flat = out.reshape(-1)
    element = np.concatenate(sets) if sets else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    drawn: list[np.ndarray] = []
    perm = None
    for j in range(m):
        if not len(element):
            return
        x = _text.mix(element + _U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = (_U(j) + (x & _U(0xFFFFFFFF)) % _U(m - j)).astype(np.int64)
        if perm is None:
            register = k
            for t in range(j - 1, -1, -1):
                register = np.where(register == drawn[t], t, np.where(register == t, drawn[t], register))
            drawn.append(k)
        else:
            every = np.arange(len(k))
            register = perm[every, k].astype(np.int64)
            perm[every, k] = perm[:, j]
            perm[:, j] = register
        np.minimum.at(flat, owner * m + register, (_U(j) << _U(32)) | (x >> _U(32)))
        owners = np.unique(owner)
        unfinished = np.zeros(len(sets), bool)
        unfinished[owners] = out[owners].max(axis=1) >> _U(32) > j
        stay = unfinished[owner]
        if not stay.all():
            element, owner = element[stay], owner[stay]
            drawn = [d[stay] for d in drawn] if perm is None else drawn
            perm = perm[stay] if perm is not None else None
        if perm is None and j + 1 == _TRACED:
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
            every = np.arange(len(element))
            for t, d in enumerate(drawn):
                swapped = perm[every, d]
                perm[every, d] = perm[:, t]
                perm[:, t] = swapped


def _sketcher(bands: int, rows: int):
    m = bands * rows

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.batches(it):
            for c in _text.chunks(batch.column(1)):
                sets = shingle_sets(c)
                sig = super_minhash(sets, m)
                sizes = np.array([len(s) for s in sets], np.int64)
                digest = np.array([[s.sum(), _text.mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum()] for s in sets], _U)
                band = np.tile(np.arange(bands, dtype=_U), (len(sets), 1))
                key = band
                for r in range(rows):
                    key = _text.mix(key * _U(0x9E3779B97F4A7C15) ^ sig[:, r::rows])
                # The number of the band is the key's last six bits.
                key = (key & ~_U(63)) | band
                low = np.ascontiguousarray((sig & _U(0xFF)).astype(np.uint8))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(c.first, len(sets)),
                        pa.array(sizes),
                        pa.array(digest[:, 0].view(np.int64)),
                        pa.array(digest[:, 1].copy().view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, key.reshape(-1).view(np.int64)),
                        pa.array([row.tobytes() for row in low], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "bands", "sig"],
                )

    return sketch


def _confirm(percent: int):
    def confirm(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.batches(it, 1 << 23):
            one = [s for c in _text.chunks(batch.column(2)) for s in shingle_sets(c)]
            two = [s for c in _text.chunks(batch.column(3)) for s in shingle_sets(c)]
            ok = []
            for x, y in zip(one, two, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = small(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair-ids")
    texts, _ = keep(docs.join(ids, docs.doc_id == ids.id, "left_semi").dropDuplicates(["doc_id"]), "pair-texts")
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long")


#: Registers of a finer signature, of which four bits each are kept.
FINE = 512


def _finer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to four bits of each of ``FINE`` further registers."""
    for batch in _text.batches(it):
        for c in _text.chunks(batch.column(1)):
            sets = shingle_sets(c)
            parts = [super_minhash([_text.mix(x ^ _U(i + 1)) for x in sets], 256) & _U(15) for i in range(FINE // 256)]
            packed = np.concatenate([(p[:, ::2] << _U(4) | p[:, 1::2]).astype(np.uint8) for p in parts], axis=1)
            yield pa.record_batch([batch.column(0).slice(c.first, len(sets)), pa.array([r.tobytes() for r in packed], pa.binary())], ["rep", "fine"])


def _agreeing(least: float):
    """The pairs (a, b, sig_a, sig_b) whose signatures agree in a share of ``least`` or more."""

    def agree(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return agree


def _across(coarse: float, fine: float):
    """Rows (key, i, j, rep, comp, side, bands, sig, fine), sorted by tile, to the pairs of a tile that are of
    two components and agree well enough. A pair of several buckets comes from its first band's; the keys
    of the bands tell which that is, as the kept bytes also agree where registers don't."""

    def compare(band: int, rep: np.ndarray, comp: np.ndarray, side: np.ndarray, split: bool, bands: np.ndarray, sig: np.ndarray, more: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # One of two members of different components is outside the largest one.
        names, sizes = np.unique(comp, return_counts=True)
        largest = names[np.argmax(sizes)]
        for x in np.flatnonzero(comp != largest):
            other = (comp != comp[x]) & ((rep > rep[x]) | (comp == largest))
            if split:
                other &= side != side[x]
            ys = np.flatnonzero(other)
            ys = ys[(sig[ys] == sig[x]).mean(axis=1) >= coarse]
            if not len(ys):
                continue
            ys = ys[(bands[ys] == bands[x]).argmax(axis=1) == band]
            apart = more[ys] ^ more[x]
            ys = ys[((apart & 15 == 0).sum(axis=1) + (apart >> 4 == 0).sum(axis=1)) >= fine * FINE]
            if len(ys):
                yield np.full(len(ys), rep[x]), rep[ys]

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j, rep, comp, side = (t.column(c).to_numpy() for c in ("key", "i", "j", "rep", "comp", "side"))
        sig, more = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(len(key), -1) for c in ("sig", "fine"))
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(key), -1)
        cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        a, b = [], []
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
            if hi - lo > 1:
                for x, y in compare(int(key[lo]) & 63, rep[lo:hi], comp[lo:hi], side[lo:hi], i[lo] != j[lo], bands[lo:hi], sig[lo:hi], more[lo:hi]):
                    a.append(np.minimum(x, y))
                    b.append(np.maximum(x, y))
        if a:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def tile(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(c)[at].as_py() for c in range(3))

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            if waiting and tile(waiting[-1], waiting[-1].num_rows - 1) != tile(batch, 0):
                yield from settle(pa.Table.from_batches(waiting))
                waiting = []
            # The batch's last tile waits for what the next batch has of it.
            key, i, j = (batch.column(c).to_numpy() for c in range(3))
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if len(new):
                yield from settle(pa.Table.from_batches([*waiting, batch.slice(0, new[-1])]))
                waiting = []
            waiting.append(batch.slice(new[-1]) if len(new) else batch)
        if waiting:
            yield from settle(pa.Table.from_batches(waiting))

    return meet


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 75,
    bands: int = 36,
    rows: int = 4,
    tile: int = 1024,
    coarse: float = 0.58,
    fine_share: float = 0.677,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base, _ = keep(
        docs.mapInArrow(_sketcher(bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary"),
        "sketches",
    )
    some = base.filter("n_shingles > 0 and doc_id is not null")
    content = ["n_shingles", "d1", "d2"]
    classes = some.groupBy(*content).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    # Only documents that share their set with others need a lookup.
    shared = classes.filter("n > 1").select(*content, "rep")
    member, _ = keep(
        some.select("doc_id", *content).join(shared, content).filter("doc_id != rep").groupBy("doc_id").agg(F.min("rep").alias("rep")),
        "copies",
    )
    reps = some.join(member, "doc_id", "left_anti").select(F.col("doc_id").alias("rep"), "bands", "sig")

    banded = reps.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded, crowded_path = keep(banded.join(buckets, "key"), "buckets")

    # A bucket's hub is the member that meets most others in all its buckets.
    degree = crowded.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = crowded.join(degree, "rep").select("key", "rep", F.struct("degree", (-F.col("rep")).alias("minus")).alias("rank"))
    hubs = ranked.groupBy("key").agg(F.max("rank").alias("hub"))
    stars = ranked.join(hubs, "key").filter("rank < hub").groupBy("rep").agg(F.max("hub").alias("hub"))
    signed = reps.select("rep", "sig")
    likely = (
        stars.select((-F.col("hub.minus")).alias("a"), F.col("rep").alias("b"))
        .join(signed.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(signed.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(_agreeing(coarse), "a long, b long")
    )
    likely, _ = keep(likely, "star-pairs")
    first, _ = keep(_confirmed(likely, docs, percent), "star-links")
    after = components(first)

    named = crowded.join(after, crowded.rep == after.node, "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("comp")
    )
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    members, _ = keep(named.join(mixed, "key", "left_semi"), "members")
    ids = small(members.select("rep").distinct(), "member-ids")
    again = docs.join(ids, docs.doc_id == ids.rep, "left_semi").dropDuplicates(["doc_id"])
    fine = again.mapInArrow(_finer, "rep long, fine binary")
    sketches, _ = keep(reps.join(ids, "rep", "left_semi").select("rep", "bands", "sig").join(fine, "rep"), "fine-sketches")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("rep"), tiles).cast("int")
    dealt = members.withColumn("side", own).withColumn("t", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dealt = dealt.select("key", F.least("side", "t").alias("i"), F.greatest("side", "t").alias("j"), "rep", "comp", "side")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.join(sketches, "rep").select("key", "i", "j", "rep", "comp", "side", "bands", "sig", "fine")
    sorted_ = sorted_.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    rest, _ = keep(sorted_.mapInArrow(_across(coarse, fine_share), "a long, b long"), "rest-pairs")
    second, _ = keep(_confirmed(rest, docs, percent), "rest-links")
    # Links found later join whole components.
    one, two = (after.select(F.col("node").alias(f"_{x}"), F.col("component").alias(f"in_{x}")) for x in "ab")
    bridges = second.join(one, F.col("a") == F.col("_a"), "left").join(two, F.col("b") == F.col("_b"), "left")
    more = components(bridges.select(F.coalesce("in_a", "a").alias("a"), F.coalesce("in_b", "b").alias("b")))
    more = more.select(F.col("node").alias("part"), F.col("component").alias("whole"))
    discard(spark, crowded_path)

    out = base.select("doc_id", "n_shingles").join(member, "doc_id", "left")
    own_class = F.coalesce("rep", "doc_id")
    return (
        out.withColumn("rep", own_class)
        .join(after, F.col("rep") == F.col("node"), "left")
        .withColumn("part_of", F.coalesce("component", "rep"))
        .join(more, F.col("part_of") == F.col("part"), "left")
        .select("doc_id", "n_shingles", F.coalesce("whole", "part_of").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
