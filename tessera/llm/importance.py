"""Quality classification by importance resampling, sampled by Gumbel top-k.

Two generative models of hashed n-grams are fitted: one on texts labelled good (the target), one on
all texts (the raw corpus). A document's log weight is the sum over its n-grams of the log ratio of
the two; its score is that sum divided by the number of n-grams. The classifier keeps scores of at
least a threshold, which is fitted on labelled texts that the target model has not seen. For
resampling, each document's log weight gets Gumbel noise seeded by its id, and the k largest sums are
sampled without replacement.

N-grams: every word, and every pair of the shapes of two consecutive words, marked if the two words
are equal. A shape has one letter for each run of lower-case or non-ASCII letters, capitals, digits
and each other character. Texts of any language share them, and invented or rare words, whose own
buckets tell little, are told apart by their shapes.

The models have ``BUCKETS`` counts each, whatever the corpus. At most about ``max_labelled`` labelled
documents, chosen by a hash of their ids, are used for the target and the threshold; the raw model
counts all documents. The k-th largest sum is found by counting, 16 bits at a time, so that nothing
is sorted or collected.

A text without words (null, empty) has no score and is neither kept nor sampled. Labels that are null
are ignored, and several labels of one document count as good only if all are. Without good labels
all documents with words are kept. Ties at the k-th largest sum are all sampled. Repeated rows each
get their row, an empty table gives none, and other columns pass through; a column of the input that
has the name of one of the result (n_features, log_weight, score, kept, gumbel_key, sampled) gives way
to it, except in ``keep_good``, which returns all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _text
from tessera.llm._shared import without

#: Hashed n-grams.
BUCKETS = 1 << 14
#: A rejected good document costs as much as so many kept bad ones when the threshold is fitted.
GOOD_COST = 10

_U = np.uint64
_CLASS = np.array([1 if b >= 0x80 or 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b + 4 for b in range(256)], np.int64)


@dataclass(frozen=True)
class Model:
    """Log ratio of target and raw probability for each bucket, and the least score that is kept."""

    log_ratio: np.ndarray
    threshold: float = 0.0


def features(chunk: _text.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, a word's own and that of its pair next to each other; row bounds."""
    w = _text.words(chunk)
    n = len(w.start)
    kind = _CLASS[chunk.data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[w.start] = True
    new &= ~_text.SPACE[chunk.data]
    at = np.flatnonzero(new)
    lo, hi = np.searchsorted(at, w.start), np.searchsorted(at, w.end)
    up, down = _text.powers(len(at) + 1)
    sums = np.zeros(len(at) + 1, _U)
    np.cumsum(_text.mix(kind[at].astype(_U)) * up[: len(at)], out=sums[1:])
    shape = _text.mix((sums[hi] - sums[lo]) * down[lo]) if n else np.zeros(0, _U)
    before, same = np.zeros(n, _U), np.zeros(n, _U)
    before[1:] = shape[:-1]
    same[1:] = w.hash[1:] == w.hash[:-1]
    first = w.rows[:-1][w.rows[:-1] < w.rows[1:]]
    before[first] = same[first] = 0
    out = np.empty(2 * n, np.int64)
    out[::2] = _text.mix(w.hash ^ _U(0x1B873593)) & _U(BUCKETS - 1)
    out[1::2] = _text.mix((before * _U(3) + same) * _U(0x9E3779B97F4A7C15) ^ shape) & _U(BUCKETS - 1)
    return out, 2 * w.rows


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, good) to counts of buckets in good and in all texts."""
    good, every = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in _text.batches(it):
        flags = np.asarray(batch.column(1).fill_null(False))
        for c in _text.chunks(batch.column(0)):
            f, rows = features(c)
            every += np.bincount(f, minlength=BUCKETS)
            mine = np.repeat(flags[c.first : c.first + len(rows) - 1], np.diff(rows))
            good += np.bincount(f[mine], minlength=BUCKETS)
    at = np.flatnonzero(every)
    yield pa.record_batch([pa.array(at), pa.array(good[at]), pa.array(every[at])], ["bucket", "good", "every"])


def _scorer(sent, text_at: int, stay: list[int], kept_only: bool = False):
    """Rows with n_features, log_weight and score; or, ``kept_only``, the rows as they are that the model
    keeps, so that no other row leaves Python."""

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in _text.batches(it):
            size, weight = [], []
            for c in _text.chunks(batch.column(text_at)):
                f, rows = features(c)
                value = model.log_ratio[f]
                for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    size.append(b - a)
                    weight.append(float(value[a:b].sum()))
            n, s = np.array(size, np.int64), np.array(weight)
            mean = pa.array(s / np.maximum(n, 1), mask=n == 0)
            if kept_only:
                good = (n > 0) & (s / np.maximum(n, 1) >= model.threshold)
                yield batch if good.all() else batch.filter(pa.array(good))
                continue
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in stay], pa.array(n), pa.array(s, mask=n == 0), mean],
                [*[batch.schema.names[i] for i in stay], "n_features", "log_weight", "score"],
            )

    return score


def score_documents(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns ``drop``, with n_features, log_weight and score."""
    stay = without(docs, *drop, "n_features", "log_weight", "score")
    schema = T.StructType(
        [*[docs.schema[c] for c in stay], T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("score", T.DoubleType())]
    )
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scorer(sent, names.index(text), [names.index(c) for c in stay]), schema)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", max_labelled: int = 20_000) -> Model:
    """The two models and the threshold, from the labelled documents and all documents."""
    known = (
        labels.select(F.col(doc_id).alias("_labelled"), F.col(quality).alias("_quality"))
        .filter("_labelled is not null and _quality is not null")
        .groupBy("_labelled")
        .agg((F.min("_quality") > 0).alias("_good"))
    )
    share = min(1.0, max_labelled / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("_labelled"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # Three quarters make the target, one quarter the threshold.
    known = known.withColumn("_held", F.pmod(F.xxhash64("_labelled", F.lit(1)), F.lit(4)) == 0)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(
        F.broadcast(known), F.col("_doc") == F.col("_labelled"), "left"
    )
    counted = texts.select("_text", (F.col("_good") & ~F.col("_held")).alias("_good")).mapInArrow(_count, "bucket long, good long, every long")
    rows = counted.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("every").alias("every")).toPandas()
    good, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    good[rows["bucket"]], every[rows["bucket"]] = rows["good"], rows["every"]
    if not good.sum():
        return Model(np.zeros(BUCKETS), 0.0)
    # The target is smoothed towards the raw model, so that a bucket it has not seen counts for little.
    raw = (every + 1) / (every + 1).sum()
    target = (good + 100.0 * raw) / (good.sum() + 100.0)
    model = Model(np.log(target / raw))
    held = score_documents(texts.filter("_held").select("_text", "_good"), model, "_text", ("_text",)).filter("score is not null").toPandas()
    return Model(model.log_ratio, _threshold(held["score"].to_numpy(), held["_good"].to_numpy(bool)))


def _threshold(score: np.ndarray, good: np.ndarray) -> float:
    """Half way in the gap where cutting costs least; 0 if one kind is missing."""
    if not good.any() or good.all():
        return 0.0
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) * GOOD_COST
    left = np.concatenate([[(~g).sum()], (~g).sum() - np.cumsum(~g)])
    cost = (lost + left)[1:-1]
    best = np.flatnonzero(cost == cost.min()) + 1
    i = best[np.argmax(s[best] - s[best - 1])]
    return float((s[i - 1] + s[i]) / 2)


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column without nulls or NaN; None if there are fewer.

    The 64 bits of a value, arranged to ascend with it, are counted 16 at a time from above.
    """
    ordered = df.select(F.col(column).alias("x")).mapInArrow(_as_bits, "b long")
    prefix, below = 0, k
    for shift in (48, 32, 16, 0):
        part = F.shiftright("b", shift).bitwiseAND(0xFFFF)
        same = ordered if shift == 48 else ordered.filter(F.shiftright("b", shift + 16) == prefix)
        counts = {r[0]: r[1] for r in same.groupBy(part.alias("p")).count().collect()}
        # The top 16 bits are signed.
        for p in sorted(counts, key=lambda p: p - (1 << 16 if shift == 48 and p >= 1 << 15 else 0), reverse=True):
            if below <= counts[p]:
                break
            below -= counts[p]
        else:
            return None
        top = p - (1 << 16) if shift == 48 and p >= 1 << 15 else p
        prefix = top if shift == 48 else (prefix << 16) | p
    b = np.int64(prefix)
    return float((b ^ ((b >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def _as_bits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        b = (batch.column(0).to_numpy() + 0.0).view(np.int64)
        yield pa.record_batch([pa.array(b ^ ((b >> 63) & 0x7FFFFFFFFFFFFFFF))], ["b"])


def gumbel_key(log_weight: str, doc_id: str, seed: int = 0):
    """Log weight plus Gumbel noise from a hash of the id."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.col(log_weight) - F.log(-F.log(u))


def resample(scored: DataFrame, model: Model, fraction: float = 0.5, doc_id: str = "doc_id", seed: int = 0) -> DataFrame:
    """``scored`` with kept, gumbel_key and sampled: whether it is among the ``fraction`` of the
    documents with words that have the largest keys. Reads its input six times; give it a table."""
    scored = scored.select(*without(scored, "kept", "gumbel_key", "sampled"))
    keyed = scored.withColumn("kept", F.coalesce(F.col("score") >= model.threshold, F.lit(False))).withColumn(
        "gumbel_key", gumbel_key("log_weight", doc_id, seed)
    )
    some = keyed.filter("gumbel_key is not null")
    k = int(np.ceil(some.count() * fraction))
    least = kth_largest(some, "gumbel_key", k) if k else None
    chosen = F.lit(False) if least is None else F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False))
    return keyed.withColumn("sampled", chosen)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text=text, **how))
    return docs.mapInArrow(_scorer(sent, docs.columns.index(text), list(range(len(docs.columns))), kept_only=True), docs.schema)
