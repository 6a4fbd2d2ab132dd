"""Exact top-k search by inner product, exhaustive and term at a time.

Each dimension is a term. A block of candidates is turned into postings (candidate, weight) for each
term; the terms of a tile of queries scatter their weighted postings into a dense array of scores,
small enough to stay in a processor's cache; a term that a query lacks is skipped. The k best of each
query are selected in the block, merged over the blocks of a task, and merged over all tasks by Spark.
Every query meets every candidate.

Queries travel to the tasks in groups of at most ``group_bytes``: however many queries there are, no
broadcast and nothing in the driver exceeds that size. Each group is one pass over the candidates; with
several groups, the result of one is written before the next is read. A pass costs the comparisons of
its queries, far more than its scan, so that many groups don't make the search slower.

Components are floor(scale * x), x as double, and scores are exact integers: a tile adds in 32-bit
floating point where a bound shows that to be exact, else in 64-bit integers, else (components of
``WIDE`` or more after scaling) in Python's integers. Scores beyond 64 bits are ranked as they are and
returned as the nearest 64-bit integer. Vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id. An empty vector scores 0 with all; a missing dimension counts
as 0. Rows of one id are one query (that of the smallest vector that takes part), while as candidates
each of them counts. A query's own id is never its candidate. Empty tables give no rows and further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import keep

#: Scaled components from here on are Python integers: 2**13 smaller ones multiplied and summed stay
#: below 2**63.
WIDE = 1 << 25
#: Queries and candidates of a tile.
TILE = 32, 4096
#: Share of a list from which on it is added whole, zeros included.
FULL = 0.25

_SCHEMA = "query_id long, vec_id long, score decimal(38, 0)"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(ids: pa.Array, vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and integer rows of the vectors that take part, short rows filled with 0: those of small
    components first, then those with a wide one, whose rows hold Python integers."""
    n = len(ids)
    lengths = np.diff(vectors.offsets.to_numpy())
    ok = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    lengths = np.where(ok, lengths, 0)
    flat = vectors.flatten() if ok.all() else vectors.filter(pa.array(ok)).flatten()
    raw = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), lengths)
    ok[row[~np.isfinite(raw)]] = False
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(raw * scale)
        wide = np.zeros(n, bool)
        wide[row[~(np.abs(values) < WIDE)]] = True
    wide &= ok
    column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((n, int(lengths.max(initial=0))), np.int64)
    small = (ok & ~wide)[row]
    out[row[small], column[small]] = values[small].astype(np.int64)
    large = np.zeros((int(wide.sum()), out.shape[1]), object)
    place = np.cumsum(wide) - 1
    for i in np.flatnonzero(wide[row]).tolist():
        large[place[row[i]], column[i]] = math.floor(Fraction(raw[i]) * Fraction(scale))
    names = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return names[ok & ~wide], out[ok & ~wide], names[wide], large


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best of each row of scores, ties to the smaller id; ``ids`` ascend."""
    n = scores.shape[1]
    if n <= k:
        return [(ids, s) for s in scores]
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    out = []
    for s, t in zip(scores, least, strict=True):
        at = np.flatnonzero(s >= t)
        if len(at) > k:
            above = at[s[at] > t]
            at = np.concatenate([above, at[s[at] == t][: k - len(above)]])
        out.append((ids[at], s[at]))
    return out


def _kind(queries: np.ndarray, rows: np.ndarray) -> type:
    """The quickest type in which all sums of products are exact."""
    if queries.dtype == object or rows.dtype == object:
        return object
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * min(queries.shape[1], rows.shape[1])
    return np.float32 if largest < 1 << 24 else np.int64


class _Block:
    """Candidates in ascending order of ids, as postings by term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, kind: type) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.kind = ids[order], kind
        rows = rows[order]
        self.postings = []
        for d in range(rows.shape[1]):
            where = np.flatnonzero(rows[:, d])
            # A term that most candidates have is posted for all of them.
            full = len(where) >= len(rows) * FULL
            self.postings.append((None, np.ascontiguousarray(rows[:, d], kind)) if full else (where, rows[where, d].astype(kind)))

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Scores of a tile's queries with all candidates."""
        n = len(self.ids)
        out = np.zeros((len(queries), n), self.kind)
        room = np.empty_like(out)
        weight = queries.astype(self.kind)
        for d, (where, posted) in enumerate(self.postings[: queries.shape[1]]):
            mine = np.flatnonzero(weight[:, d])
            if where is None and len(mine) >= len(queries) * FULL:
                np.multiply(weight[:, d, None], posted, out=room)
                out += room
            elif where is None:
                for q in mine.tolist():
                    out[q] += weight[q, d] * posted
            elif len(mine) and len(where):
                out[np.ix_(mine, where)] += weight[mine, d, None] * posted
        return out


def _search_block(best: list, query_ids: np.ndarray, places: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
    """Merge a block's best into ``best`` at the queries' places."""
    if not len(ids) or not len(queries):
        return
    block = _Block(ids, rows, _kind(queries, rows))
    for at in range(0, len(queries), TILE[0]):
        q = slice(at, at + TILE[0])
        scores, own = block.scores(queries[q]), query_ids[q]
        mine = np.isin(own, block.ids)
        found = iter(_best(block.ids, scores[~mine], k) if not mine.all() else [])
        for i, s in enumerate(scores):
            if mine[i]:
                other = block.ids != own[i]
                v, s = _best(block.ids[other], s[None, other], k)[0]
            else:
                v, s = next(found)
            b = best[places[at + i]]
            s = s if s.dtype == object else s.astype(np.int64)
            v, s = np.concatenate([b[0], v]), np.concatenate([b[1], s])
            if len(v) > k:
                first = np.lexsort((v, -s))[:k]
                v, s = v[first], s[first]
            best[places[at + i]] = v, s


def _searcher(asked, k: int, scale: float):
    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small_ids, small, wide_ids, wide = asked.value
        every = np.concatenate([small_ids, wide_ids])
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(every)
        places = np.arange(len(every))
        for batch in it:
            for lo in range(0, batch.num_rows, TILE[1]):
                part = batch.slice(lo, TILE[1])
                ids, rows, more_ids, more = quantised(part.column(0), part.column(1), scale)
                for c_ids, c in ((ids, rows), (more_ids, more)):
                    _search_block(best, small_ids, places[: len(small_ids)], small, c_ids, c, k)
                    _search_block(best, wide_ids, places[len(small_ids) :], wide, c_ids, c, k)
        sizes = [len(v) for v, _ in best]
        if sum(sizes):
            yield pa.record_batch(
                [
                    pa.array(np.repeat(every, sizes)),
                    pa.array(np.concatenate([v for v, _ in best])),
                    # A decimal holds what 64 bits don't, up to 38 digits.
                    pa.array([max(-(10**38) + 1, min(10**38 - 1, int(x))) for _, s in best for x in s], pa.decimal128(38, 0)),
                ],
                ["query_id", "vec_id", "score"],
            )

    return search


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    group_bytes: int = 16 << 20,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query."""
    spark = vectors.sparkSession
    data = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), is_query.alias("asked"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = data.filter("asked and vec_id is not null and embedding is not null").filter(finite).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, widest = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    groups = max(1, -(-n * max(1, widest or 0) * 8 // group_bytes))
    found: list[DataFrame] = []
    for g in range(groups):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toArrow()
        if not part.num_rows:
            continue
        rows = part.combine_chunks().to_batches()[0]
        sent = spark.sparkContext.broadcast(quantised(rows.column(0), rows.column(1), scale))
        one = data.select("vec_id", "embedding").mapInArrow(_searcher(sent, k, scale), _SCHEMA)
        if groups > 1:
            one, _ = keep(_ranked(one, k), "best-of-group")
            sent.destroy()
        else:
            one = _ranked(one, k)
        found.append(one)
    if not found:
        return _ranked(spark.createDataFrame([], _SCHEMA), k)
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    score = F.greatest(F.least("score", F.lit(_MOST).cast("decimal(38,0)")), F.lit(_LEAST).cast("decimal(38,0)")).cast("long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
