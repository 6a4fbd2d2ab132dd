"""Language-model scores from a probabilistic suffix tree, and from token counts.

The tree models the bytes of lower-cased texts, each followed by an end symbol. A context of up to
``DEPTH`` bytes is retained if what it tells of the next symbol beyond the context one byte shorter is
significant: its count times the Kullback-Leibler divergence of the two distributions (in nats) must
reach ``gain`` and one more for each symbol that follows it but the first. With a context all its
suffixes are retained; contexts of less than ``TRUNK`` bytes always are. The test knows nothing of the
size of the corpus, so that a larger corpus grows a larger tree. Each distribution is smoothed with that
of its parent, with a weight of ``strength`` for each symbol that follows the context, and the root with
the uniform one, so that the tree gives every text a probability. A symbol is predicted by its longest
retained context.

1. One scan counts the grams of ``TRUNK`` bytes, at most 2**24 whatever the corpus, tokens, and
   candidates for frequent words.
2. A second one sends the counts of all grams of DEPTH + 1 bytes, packed, to buckets of their branch:
   the TRUNK bytes before the predicted symbol. All longer contexts and all suffixes that a test or a
   smoothed distribution needs are in one branch, so that each bucket grows its part of the tree alone
   and returns packed tables: the log probabilities of grams, and the log shares that contexts leave to
   their parents. Rare words go to buckets of their hash in the same shuffle.
3. Texts are scored in passes: a pass broadcasts the tables of as many buckets as fill ``tree_bytes``
   (more only if a single bucket does) and scores the symbols of these branches. One pass does for a
   tree of up to ``tree_bytes``; a larger one costs more scans, not more memory.

Counts cover all training texts; grams seen once count in the totals of contexts but are not tabled.

Token counts are exact. Words that make up ``frequent_share`` of a batch's tokens or more are
candidates for a list of frequent words, at most 2 / ``frequent_share`` long; their counts are summed
for each batch and broadcast. Every other word meets its counterparts in a bucket of its hash: tasks
send one packed row for each batch and bucket, and a bucket counts, scores and forgets its words, and
returns the sums of its texts, again in packed rows, which are added up by parts of the texts. A word in
a third of all texts is thus never gathered. The number of buckets grows with the number of tokens.

Null texts are empty; an empty text is an end token. Null ids count as the empty string where ids are
hashed. Repeated rows each count in training and each get their row. Without training texts all
distributions are uniform. Empty tables give no rows, and further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text
from tessera.llm._shared import keep

#: Longest context in bytes; a gram with its next symbol then has 56 bits.
DEPTH = 6
#: Bytes of the trunk's grams: shorter contexts are retained untested.
TRUNK = 3
END = 255
#: Occurrences that a gram needs to be tabled: a single one says nothing of a distribution.
MIN_COUNT = 2
#: Tokens for a bucket of rare words.
BUCKET_TOKENS = 2_000_000
_U = np.uint64
_GRAM, _WORD, _TOKENS = 0, 1, 2
#: Buckets of branches for each bucket of words.
BRANCHES = 2
#: Bytes of texts scored together: the more, the fewer of their grams are distinct.
SCORED_BYTES = 1 << 21
#: Gram counts that a task holds at a time.
_FLUSH = 1 << 21


def _mask(size: int) -> np.uint64:
    """The last ``size`` bytes."""
    return _U((1 << 8 * size) - 1)


def _grams(chunk: _text.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """DEPTH + 1 bytes up to each byte of the lower-cased texts and to their ends, the last one lowest
    (before a text are zero bytes); and where each text's begin."""
    n = len(chunk.offsets) - 1
    extra = (DEPTH + 1) * np.arange(n + 1)
    out = np.zeros(len(chunk.data) + int(extra[-1]), np.uint8)
    real = np.ones(len(out), bool)
    base = chunk.offsets[:-1] + extra[:-1] + DEPTH
    row = np.repeat(np.arange(n), np.diff(chunk.offsets))
    out[np.arange(len(chunk.data)) + extra[row] + DEPTH] = _text.LOWER[chunk.data]
    out[base + np.diff(chunk.offsets)] = END
    for i in range(1, DEPTH + 1):
        real[base - i] = False
    wide = out.astype(_U)
    g = wide.copy()
    for i in range(1, DEPTH + 1):
        g[i:] |= wide[:-i] << _U(8 * i)
    return g[real], chunk.offsets[:-1] + np.arange(n)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "key", "n"]
    )


def _first_counts(frequent_share: float):
    """(row, held_out, text): trunk grams of training texts, candidates for frequent words, tokens."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trunk = np.zeros(1 << 8 * TRUNK, np.int64)
        for batch in _text.batches(it):
            batch = batch.filter(pc.invert(batch.column(1)))
            words, tokens = [], 0
            for c in _text.chunks(batch.column(2)):
                g, _ = _grams(c)
                some, n = _counted((g & _mask(TRUNK)).astype(np.uint32))
                trunk[some] += n
                w = _text.words(c, lower=True)
                words.append(_counted(w.hash))
                tokens += len(w.hash) + len(c.offsets) - 1
            if words:
                h, n = _merge(words)
                often = n >= max(2.0, frequent_share * tokens)
                yield _rows(_WORD, h[often], n[often])
                yield _rows(_TOKENS, np.zeros(1, np.int64), np.array([tokens]))
        seen = np.flatnonzero(trunk)
        if len(seen):
            yield _rows(_GRAM, seen, trunk[seen])

    return count


def _lookup(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in a sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


_RARE, _FREQUENT, _BRANCH = 0, 1, 2
_PARTIAL = "kind int, bucket int, part int, id binary, s binary, known binary, n long"
_TEXTS, _LISTED, _DISTINCT, _TREE = 0, 1, 2, 3


def _bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((_text.mix(x) >> _U(20)) % _U(buckets)).astype(np.int64)


def _squeezed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, and counts, byte plane by byte plane, compressed."""
    step = np.diff(keys, prepend=_U(0))
    planes = [step.view(np.uint8).reshape(-1, 8).T, counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T]
    raw = np.concatenate(planes).tobytes()
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _expanded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 12 * n, asbytes=True), np.uint8).reshape(12, n)
    step, counts = (np.ascontiguousarray(x.T).view(t).reshape(-1) for x, t in ((planes[:8], _U), (planes[8:], np.uint32)))
    return np.cumsum(step, dtype=_U), counts


def _packed_grams(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row of grams and counts for each bucket of branches; these follow the buckets of words."""
    bucket = _branch_bucket(keys, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 15 else bucket, kind="stable")
    keys, counts = keys[order], counts[order]
    cut = np.searchsorted(bucket[order], np.arange(BRANCHES * buckets + 1))
    some = np.flatnonzero(np.diff(cut)).tolist()
    return _bucket_rows([(buckets + b, _BRANCH, _squeezed(keys[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]]), b"", b"") for b in some])


def _branch_bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the branch of each gram."""
    return _bucket_of((g >> _U(8)) & _mask(TRUNK), BRANCHES * buckets)


def _bucket_rows(rows: list[tuple[int, int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.record_batch(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())],
        ["bucket", "kind", "hash", "row", "n"],
    )


def _packer(frequent, buckets: int):
    """Rows for buckets: for each batch, hashes, texts and counts (negative: held out) of rare words, and
    counts of frequent ones; and grams of training texts, counted over as many as fit ``_FLUSH``."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = frequent.value
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in _text.batches(it):
            row_keys = batch.column(0).to_numpy()
            sign = np.where(np.asarray(batch.column(1)), -1, 1)
            hashes, rows, counts, often = [], [], [], []
            for c in _text.chunks(batch.column(2)):
                g, first = _grams(c)
                if (sign[c.first : c.first + len(first)] < 0).any():
                    g = g[np.repeat(sign[c.first : c.first + len(first)] > 0, np.diff(np.append(first, len(g))))]
                grams.append(_counted(g))
                if sum(len(x) for x, _ in grams) > _FLUSH:
                    grams = [_merge(grams)]
                    if len(grams[0][0]) > _FLUSH // 2:
                        yield _packed_grams(*grams.pop(), buckets)
                w = _text.words(c, lower=True)
                where, is_listed = _lookup(listed, w.hash)
                for r, (a, b) in enumerate(zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True)):
                    h, n = _counted(w.hash[a:b][~is_listed[a:b]])
                    hashes.append(h)
                    rows.append(np.full(len(h), row_keys[c.first + r]))
                    counts.append((n * sign[c.first + r]).astype(np.int32))
                trained = np.repeat(sign[c.first : c.first + len(w.rows) - 1] > 0, np.diff(w.rows))
                often.append(np.bincount(where[is_listed & trained], minlength=len(listed)))
            if not hashes:
                continue
            h, row, n = np.concatenate(hashes), np.concatenate(rows), np.concatenate(counts)
            bucket = ((h >> _U(20)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, row, n = h[order], row[order], n[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            out = [(int(b), _RARE, h[cut[b] : cut[b + 1]].tobytes(), row[cut[b] : cut[b + 1]].tobytes(), n[cut[b] : cut[b + 1]].tobytes()) for b in some]
            summed = np.sum(often, axis=0) if len(listed) else np.zeros(0, np.int64)
            seen = np.flatnonzero(summed)
            place = ((listed[seen] >> _U(20)) % _U(buckets)).astype(np.int64)
            for b in np.unique(place):
                mine = seen[place == b]
                out.append((int(b), _FREQUENT, listed[mine].tobytes(), b"", summed[mine].astype(np.int64).tobytes()))
            yield _bucket_rows(out)
        if grams:
            yield _packed_grams(*_merge(grams), buckets)

    return pack


def _joined(table: pa.Table, name: str, dtype, kind: int | None = None) -> np.ndarray:  # noqa: ANN001
    column = table.column(name)
    if kind is not None:
        column = column.filter(pc.equal(table.column("kind"), kind))
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _partial(bucket: int, rows: list[tuple[int, int, bytes, bytes, bytes, int]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.table(
        [pa.array(cols[0], pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[2:5]], pa.array(cols[5], pa.int64())],
        ["kind", "bucket", "part", "id", "s", "known", "n"],
    )


def _settler(parts: int, trunk, rule: tuple[float, float, int]):
    """A bucket: log10(c + 1) of its rare words summed for each text, packed by part of the texts; counts
    of frequent words; number of distinct training words. Or, of the buckets behind those of words, the
    branches of the tree."""

    def settle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= parts:
            found = [_expanded(x) for x in table.column("hash").to_pylist()]
            grown = grow(*_merge([(k, n.astype(np.int64)) for k, n in found]), trunk.value, *rule)
            return _partial(bucket - parts, [(_TREE, name, k.tobytes(), v.astype(np.float32).tobytes(), b"", len(k)) for name, (k, v) in grown.items() if len(k)])
        h, row = _joined(table, "hash", _U, _RARE), _joined(table, "row", np.int64, _RARE)
        n = _joined(table, "n", np.int32, _RARE).astype(np.int64)
        _, word = np.unique(h, return_inverse=True)
        c = np.bincount(word, weights=np.maximum(n, 0))
        tf = np.abs(n)
        texts, at = np.unique(row, return_inverse=True)
        s = np.bincount(at, weights=tf * np.log10(c[word] + 1), minlength=len(texts))
        known = np.bincount(at, weights=tf * (c[word] > 0), minlength=len(texts)).astype(np.int64)
        part = (texts.view(_U) >> _U(20)) % _U(parts)
        order = np.argsort(part, kind="stable")
        texts, s, known = texts[order], s[order], known[order]
        cut = np.searchsorted(part[order], np.arange(parts + 1).astype(_U))
        out = [(_TEXTS, p, texts[cut[p] : cut[p + 1]].tobytes(), s[cut[p] : cut[p + 1]].tobytes(), known[cut[p] : cut[p + 1]].tobytes(), 0) for p in np.flatnonzero(np.diff(cut)).tolist()]
        fh, fn = _merge([(_joined(table, "hash", _U, _FREQUENT), _joined(table, "n", np.int64, _FREQUENT))])
        if len(fh):
            out.append((_LISTED, 0, fh.tobytes(), b"", fn.astype(np.int64).tobytes(), len(fh)))
        out.append((_DISTINCT, 0, b"", b"", b"", int((c > 0).sum())))
        return _partial(bucket, out)

    return settle


def _sum_part(table: pa.Table) -> pa.Table:
    """The sums of the texts of a part over all buckets."""
    texts, at = np.unique(_joined(table, "id", np.int64), return_inverse=True)
    s = np.bincount(at, weights=_joined(table, "s", np.float64), minlength=len(texts))
    known = np.bincount(at, weights=_joined(table, "known", np.int64), minlength=len(texts))
    return pa.table([pa.array(texts), pa.array(s), pa.array(known.astype(np.int64))], ["row", "rare_s", "rare_known"])


class _Level:
    """Grams of one length, sorted: context bytes and a symbol. ``of`` is each one's context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        context = keys >> _U(8)
        at = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[at]
        self.n_symbols = np.diff(np.append(at, len(keys)))
        self.of = np.repeat(np.arange(len(at)), self.n_symbols)
        self.total = np.add.reduceat(counts, at) if len(at) else np.zeros(0, np.int64)

    def tabled(self, retained: np.ndarray, strength: float, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which grams are tabled, their own share, and what each context leaves to its parent."""
        good = (self.counts >= min_count) & retained[self.of]
        weight = strength * self.n_symbols
        own = np.bincount(self.of, weights=self.counts * good, minlength=len(self.contexts))
        left = (weight + self.total - own) / (self.total + weight)
        return good, self.counts / (self.total + weight)[self.of], left


class Trunk:
    """The contexts of less than TRUNK bytes: ``tables`` are those of the levels, and ``probability`` that
    of each gram of TRUNK bytes that is in ``grams``, all of which training texts have."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, strength: float, min_count: int) -> None:
        levels = [_Level(keys, counts)]
        for size in range(TRUNK - 1, 0, -1):
            levels.insert(0, _Level(*_merge([(levels[0].keys & _mask(size), levels[0].counts)])))
        self.grams, self.total = levels[-1], int(counts.sum())
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        above = None
        for length, level in enumerate(levels):
            good, own, left = level.tabled(np.ones(len(level.contexts), bool), strength, min_count)
            if above is None:
                parent = np.full(len(level.keys), 1 / 256)
            else:
                parent = above[_lookup(levels[length - 1].keys, level.keys & _mask(length))[0]]
            above = np.where(good, own, 0.0) + left[level.of] * parent
            self.tables |= _tables(length, level, good, above, left, np.ones(len(left), bool))
        self.probability = above if above is not None else np.zeros(0)


def _tables(length: int, level: _Level, good: np.ndarray, p: np.ndarray, left: np.ndarray, retained: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Table 2 * length: log10 probabilities of grams; 2 * length + 1: log10 shares left by contexts.
    Keys are mixed."""
    with np.errstate(divide="ignore"):
        return {
            2 * length: (_text.mix(level.keys[good]), np.log10(p[good])),
            2 * length + 1: (_text.mix(level.contexts[retained]), np.log10(left[retained])),
        }


def grow(keys: np.ndarray, counts: np.ndarray, trunk: Trunk, gain: float, strength: float, min_count: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The tables of some branches, from the counts of all their grams of DEPTH + 1 bytes."""
    levels = [_Level(keys, counts)]
    for size in range(DEPTH, TRUNK, -1):
        levels.insert(0, _Level(*_merge([(levels[0].keys & _mask(size), levels[0].counts)])))
    base = trunk.grams
    retained: list[np.ndarray] = []
    above = base
    parents: list[np.ndarray] = []
    for i, level in enumerate(levels):
        length = TRUNK + i
        parent = _lookup(above.keys, level.keys & _mask(length))[0]
        parents.append(parent)
        p = level.counts / level.total[level.of]
        q = above.counts[parent] / above.total[above.of[parent]]
        told = np.bincount(level.of, weights=level.counts * np.log(p / q), minlength=len(level.contexts))
        retained.append(told >= gain + level.n_symbols - 1)
        above = level
    for i in range(len(levels) - 1, 0, -1):
        suffixes = np.unique(levels[i].contexts[retained[i]] & _mask(TRUNK + i - 1))
        retained[i - 1][np.searchsorted(levels[i - 1].contexts, suffixes)] = True
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    probability = trunk.probability
    for i, level in enumerate(levels):
        good, own, left = level.tabled(retained[i], strength, min_count)
        inherited = probability[parents[i]]
        probability = np.where(retained[i][level.of], np.where(good, own, 0.0) + left[level.of] * inherited, inherited)
        out |= _tables(TRUNK + i, level, good, probability, left, retained[i])
    return out


class _Table:
    """Values by mixed key; ``start`` says where the keys of each leading bit pattern begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        bits = max(1, int(len(keys)).bit_length())
        self.shift = _U(64 - bits)
        sizes = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1."""
        m = _text.mix(x)
        head = (m >> self.shift).astype(np.int64)
        at, end = self.start[head], self.start[head + 1]
        out = np.full(len(x), -1, np.int32)
        live = np.flatnonzero(at < end)
        at, end, m = at[live], end[live], m[live]
        while len(live):
            hit = self.keys[at] == m
            out[live[hit]] = at[hit]
            at += 1
            go = np.flatnonzero(~hit & (at < end))
            live, at, end, m = live[go], at[go], end[go], m[go]
        return out


class Scorer:
    """Tables of the trunk and of some buckets' branches."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.tables = {name: _Table(k, v) for name, (k, v) in tables.items()}

    def log_p(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram."""
        out = np.zeros(len(g))
        # The longest retained context of each gram; what contexts leave to their parents.
        depth = np.zeros(len(g), np.int8)
        shares: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * (DEPTH + 1)
        live = np.arange(len(g))
        for length in range(1, DEPTH + 1):
            table = self.tables.get(2 * length + 1)
            if table is None or not len(live):
                break
            at = table.find((g[live] >> _U(8)) & _mask(length))
            some = at >= 0
            live = live[some]
            depth[live] = length
            shares[length] = live, table.values[at[some]]
        missed = np.zeros(len(g), bool)
        for length in range(DEPTH, -1, -1):
            now = np.flatnonzero(missed | (depth == length))
            table = self.tables.get(2 * length)
            at = table.find(g[now] & _mask(length + 1)) if table is not None else np.full(len(now), -1, np.int32)
            hit = at >= 0
            if table is not None:
                out[now[hit]] += table.values[at[hit]]
            missed[now] = ~hit
            depth[now[hit]] = -1
            if length:
                where, share = shares[length]
                mine = missed[where]
                out[where[mine]] += share[mine]
        root = self.tables.get(1)
        out[missed] += (float(root.values[0]) if root is not None else 0.0) - np.log10(256.0)
        return out


def _tree_of(rows: pa.Table, trunk: Trunk) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The tables of some buckets and of the trunk, sorted by mixed key."""
    out = {}
    part = rows.column("part").to_numpy() if rows.num_rows else np.zeros(0, np.int32)
    for name in range(2 * DEPTH + 2):
        mine = rows.filter(pa.array(part == name))
        keys, values = _joined(mine, "id", _U), _joined(mine, "s", np.float32)
        if name in trunk.tables:
            keys, values = trunk.tables[name]
        order = np.argsort(keys)
        if len(keys):
            out[name] = keys[order], values[order].astype(np.float32)
    return out


def _tree_scores(scorer: Scorer, chosen: np.ndarray | None, c: _text.Chunk) -> np.ndarray:
    """log10 probability of the symbols of chosen buckets (None: all), summed for each text of a chunk."""
    g, first = _grams(c)
    if not len(first):
        return np.zeros(0)
    # Places sorted by a hash of their grams, both in one number: equal grams are next to each other, and
    # a gram that shares its hash with another is looked up more than once at worst.
    bits = _U(len(g).bit_length())
    order = np.sort((g * _U(0x9E3779B97F4A7C15) >> bits << bits) | np.arange(len(g), dtype=_U))
    order = (order & ((_U(1) << bits) - _U(1))).astype(np.int64)
    sorted_ = g[order]
    new = np.append(True, sorted_[1:] != sorted_[:-1])
    distinct = sorted_[new]
    p = np.zeros(len(distinct))
    mine = slice(None) if chosen is None else np.flatnonzero(chosen[_branch_bucket(distinct, len(chosen) // BRANCHES)])
    p[mine] = scorer.log_p(distinct[mine])
    each = np.empty(len(g))
    each[order] = p[np.cumsum(new) - 1]
    return np.add.reduceat(each, first)


def _scorer(sent, chosen, words):
    """(row, held_out, text) and what follows the text: the text's parts of both scores; of later passes
    (``words`` is None) only that of the tree."""

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        if words is not None:
            listed, counts, ends = words.value
            weight = np.log10(counts + 1.0)
        for batch in _text.batches(it):
            n_tokens, s, known, score = [], [], [], [np.zeros(0)]
            for c in _text.chunks(batch.column(2), SCORED_BYTES):
                score.append(_tree_scores(scorer, chosen, c))
                if words is None:
                    continue
                w = _text.words(c, lower=True)
                at, is_listed = _lookup(listed, w.hash)
                value = np.where(is_listed, weight[at] if len(listed) else 0.0, 0.0)
                seen = is_listed & (counts[at] > 0 if len(listed) else False)
                for a, b in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
                    n_tokens.append(b - a + 1)
                    s.append(float(value[a:b].sum()) + float(np.log10(ends + 1.0)))
                    known.append(int(seen[a:b].sum()) + (ends > 0))
            total = pa.array(np.concatenate(score))
            if words is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), total], ["row", "more"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(3), pa.array(n_tokens, pa.int64()), pa.array(s, pa.float64()), pa.array(known, pa.int64()), total],
                    ["row", "held_out", "doc_id", "n_tokens", "s", "known", "score"],
                )

    return score


def _passes(sizes: list[tuple[int, int]], tree_bytes: int) -> list[list[int]]:
    """Buckets in order, as many at a time as fill ``tree_bytes``; one empty list without any."""
    out: list[list[int]] = [[]]
    filled = 0
    for bucket, n in sorted(sizes):
        if out[-1] and filled + 12 * n > tree_bytes:
            out.append([])
            filled = 0
        out[-1].append(bucket)
        filled += 12 * n
    return out


def score_texts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 7,
    held_fold: int = 2,
    min_count: int = MIN_COUNT,
    gain: float = 10.0,
    strength: float = 8.0,
    frequent_share: float = 1e-5,
    tree_bytes: int = 64 << 20,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    Texts whose crc32(id as text) mod ``folds`` is ``held_fold`` are held out from all training.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    fold = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(
        F.xxhash64(doc_id, text).alias("row"), (fold == held_fold).alias("held_out"), F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id")
    )
    slim = rows.select("row", "held_out", "text")
    counted, _ = keep(
        slim.mapInArrow(_first_counts(frequent_share), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts"
    )
    grams = counted.filter(F.col("kind") == _GRAM).select("key", "n").toArrow().sort_by("key")
    trunk = Trunk(grams.column("key").to_numpy().view(_U), grams.column("n").to_numpy(), strength, min_count)
    tokens = counted.filter(F.col("kind") == _TOKENS).agg(F.sum("n")).first()[0] or 0
    ends = rows.filter("not held_out").count()
    often = counted.filter((F.col("kind") == _WORD) & (F.col("n") >= max(2.0, frequent_share * tokens / 2))).select("key").toPandas()
    listed = np.sort(often["key"].to_numpy(np.int64).view(_U))

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))
    packed = slim.mapInArrow(_packer(sc.broadcast(listed), buckets), "bucket int, kind int, hash binary, row binary, n binary")
    settle = _settler(buckets, sc.broadcast(trunk), (gain, strength, min_count))
    partial, _ = keep(packed.groupBy("bucket").applyInArrow(settle, _PARTIAL), "word-scores")

    counts = np.zeros(len(listed), np.int64)
    few = partial.filter(F.col("kind") == _LISTED).select("id", "known").toArrow()
    at, there = _lookup(listed, _joined(few, "id", _U))
    counts[at[there]] = _joined(few, "known", np.int64)[there]
    distinct = int(partial.filter(F.col("kind") == _DISTINCT).agg(F.sum("n")).first()[0] or 0) + int((counts > 0).sum()) + (ends > 0)
    scale = float(np.log10(tokens + distinct + 1))

    branches = partial.filter(F.col("kind") == _TREE)
    sizes = [(r["bucket"], r["n"]) for r in branches.groupBy("bucket").agg(F.sum("n").alias("n")).collect()]
    own, later = None, []
    passes = _passes(sizes, tree_bytes)
    for i, mine in enumerate(passes):
        found = branches.filter(F.col("bucket").between(mine[0], mine[-1])) if mine else branches.limit(0)
        sent = sc.broadcast(_tree_of(found.select("part", "id", "s").toArrow(), trunk))
        chosen = np.zeros(BRANCHES * buckets, bool)
        chosen[(mine[0] if i else 0) : (passes[i + 1][0] if i + 1 < len(passes) else len(chosen))] = True
        chosen = None if len(passes) == 1 else chosen
        if not i:
            own = rows.mapInArrow(
                _scorer(sent, chosen, sc.broadcast((listed, counts, ends))),
                "row long, held_out boolean, doc_id long, n_tokens long, s double, known long, score double",
            )
            if len(passes) > 1:
                own, _ = keep(own, "scores")
        else:
            more, _ = keep(slim.mapInArrow(_scorer(sent, chosen, None), "row long, more double").groupBy("row").agg(F.avg("more").alias("more")), "more-scores")
            later.append(more)
        if len(passes) > 1:
            sent.destroy()
    for more in later:
        own = own.join(more, "row").withColumn("score", F.col("score") + F.col("more")).drop("more")

    texts = partial.filter(F.col("kind") == _TEXTS).select("part", "id", "s", "known")
    summed = texts.groupBy("part").applyInArrow(_sum_part, "row long, rare_s double, rare_known long")
    # Rows that are alike in id and text have one key; each of them has added to its sum.
    alike = rows.groupBy("row").count().filter("count > 1").withColumnRenamed("row", "_row")
    parts = summed.join(alike, F.col("row") == F.col("_row"), "left").select(
        F.col("row").alias("_row"), (F.col("rare_s") / F.coalesce("count", F.lit(1))).alias("rare_s"), (F.col("rare_known") / F.coalesce("count", F.lit(1))).cast("long").alias("rare_known")
    )
    return own.join(parts, F.col("row") == F.col("_row"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("s") + F.coalesce("rare_s", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )
