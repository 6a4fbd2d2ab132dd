"""SentencePiece encoding and decoding, with sampling of segmentations without replacement.

``encode_texts`` (for a table) and ``encode`` give the sentencepiece library's own segmentation.
``sample_segmentations`` draws ``k`` distinct segmentations of each text by a perturbed A* search
(Gumbel top-k):

* The lattice of a text has an edge for each vocabulary piece that matches at a position; a character
  that no piece covers gets an edge of byte pieces. Pieces of this kind of model hold spaces only at
  their start, so the lattice of a text is a chain of lattices of words with all the spaces before them,
  and each distinct one of a chunk of texts is looked up and summed (backwards, in log space) once.
* The library's own segmentation is made of the same words (see ``_Library``), each encoded once too.
* A segmentation's probability is the product of its edges' weights over the sum for all. Its perturbed
  score is its log probability plus Gumbel noise; the k largest perturbed scores are a sample without
  replacement. The search keeps regions of segmentations, each with its log mass and the largest
  perturbed score within, in a queue. The first region is all of them. The best region is taken, its
  best segmentation emitted (it inherits the region's score), and what is left of the region is split
  at each node of that path into the edges not taken; each part draws its score from a Gumbel
  distribution cut off at the region's score.
* Beside its log probability a sample has its inclusion score: the log of the probability that its
  perturbed score exceeds the largest one that wasn't sampled. 0 (certain) if nothing is left over.

All randomness is a hash of the row's key, the seed, and the place in the text, so a lost task draws
the same again and batches don't matter. The weights of edges are -alpha * log(1 + rank) for the
merge ranks of a BPE model, and alpha * score for a unigram model.

A null text counts as empty; an empty text has one segmentation, without pieces. Texts with fewer than
k segmentations give as many as they have. Repeated rows draw alike, null keys count as 0, an empty
table gives no rows. Whole texts are used; one text's lattice must fit in memory.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
_MARK = "▁"
#: Bytes of texts whose lattices are handled together.
CHUNK = 3 << 18
#: Bytes of distinct words that the library encodes as one text.
PART = 1 << 12
SCHEMA = "sample int, pieces array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def default_model() -> str:
    """Path of the public 32,000-piece BPE model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces as a trie over bytes, with log weights."""

    def __init__(self, proto: bytes, alpha: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        scores = np.array([sp.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        # Merge ranks are whole numbers from 0 down; log probabilities aren't.
        ranks = bool(np.all(scores[plain] == np.round(scores[plain])))
        weight = -alpha * np.log1p(np.maximum(0.0, -scores)) if ranks else alpha * scores
        self.bytes: list[bytes] = [b""] * n
        self.byte_piece = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:-1], 16)
                self.bytes[i] = bytes([value])
                self.byte_piece[value] = i
        self.byte_weight = float(weight[plain].min())
        entries = []
        for i in plain:
            b = sp.id_to_piece(i).replace(_MARK, " ").encode()
            self.bytes[i] = b
            if b and b" " not in b.lstrip(b" "):
                entries.append((b, i))
        self.size = np.array([len(b) for b in self.bytes])
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        step: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for b, i in entries:
            at = 0
            for c in b:
                at = step.setdefault((at, c), len(step) + 1)
            ends[at] = i
        # One flat table; a state is its number times 256, so that a step is one addition and one look-up.
        self.step = np.zeros((len(step) + 1) * 256, np.int32)
        for (at, c), to in step.items():
            self.step[at * 256 + c] = to * 256
        self.piece = np.full(len(step) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.weight = weight


@lru_cache(maxsize=2)
def _vocabulary(proto: bytes, alpha: float) -> Vocabulary:
    return Vocabulary(proto, alpha)


@lru_cache(maxsize=2)
def _library(proto: bytes) -> _Library:
    return _Library(proto)


class _Lattices:
    """Edges of distinct words laid end to end; node i is the place before byte i of ``data``. A node's edges
    are ``first[i]:last[i]``; nodes come in the order of their distance to their word's end."""

    def __init__(self, v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = len(data)
        self.limit = limit = np.repeat(ends.astype(np.int32), ends - starts)
        place = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        char = np.minimum(np.append(place[1:], np.int32(size)), limit[place]) - place
        far = limit[place] - place
        order = np.argsort(far.astype(np.uint16) if far.max(initial=0) < 1 << 16 else far, kind="stable")
        place, char, far = place[order], char[order], far[order]
        count = np.zeros(len(place), np.int32)
        own = np.zeros(len(place), bool)
        found = []
        at, to, left, step = np.arange(len(place), dtype=np.int32), place, far, 0
        node = np.zeros(len(place), np.int32)
        while len(at):
            node = v.step[node + data[to]]
            step += 1
            go = np.flatnonzero(node)
            at, node, to, left = at[go], node[go], to[go], left[go]
            p = v.piece[node >> 8]
            hit = np.flatnonzero(p >= 0)
            n = at[hit]
            found.append((n, count[n], p[hit]))
            count[n] += 1
            if step <= 4:
                own[n[char[n] == step]] = True
            go = np.flatnonzero(left > step)
            at, node, left, to = at[go], node[go], left[go], to[go] + np.int32(1)
        # Characters without a piece of their own: one edge of byte pieces, coded -1 if several.
        bare = np.flatnonzero(~own)
        behind = count[bare]
        count[bare] += 1
        begin = np.concatenate([[0], np.cumsum(count)])
        edges = int(begin[-1])
        self.dst, self.piece = np.empty(edges, np.int32), np.empty(edges, np.int32)
        for i, (n, nth, p) in enumerate(found):
            e = begin[n] + nth
            self.dst[e] = place[n] + np.int32(i + 1)
            self.piece[e] = p
        e = begin[bare] + behind
        self.dst[e] = place[bare] + char[bare]
        self.piece[e] = np.where(char[bare] == 1, v.byte_piece[data[place[bare]]], -1)
        value = v.weight[self.piece]
        value[e] = v.byte_weight * char[bare]
        self.src = np.repeat(place, count)
        self.first, self.last = np.zeros(size + 1, np.int32), np.zeros(size + 1, np.int32)
        self.first[place], self.last[place] = begin[:-1], begin[1:]
        # Log sums from each node to its word's end, from the nodes nearest to the end on. The end of one
        # word is the start of the next in ``data``, but sums to nothing, as does the last place.
        total = np.zeros(size + 1)
        to = np.where(self.dst == limit[self.src], np.int32(size), self.dst)
        sums = np.zeros(len(place))
        groups = np.flatnonzero(np.diff(far, prepend=0, append=(far[-1] if len(far) else 0) + 1)).tolist()
        for lo, hi in zip(groups[:-1], groups[1:], strict=True):
            a, b = begin[lo], begin[hi]
            value[a:b] += total[to[a:b]]
            sums[lo:hi] = np.logaddexp.reduceat(value[a:b], begin[lo:hi] - a)
            total[place[lo:hi]] = sums[lo:hi]
        value -= np.repeat(sums, count)
        self.log_p = value
        # Cumulative probability within a node.
        self.upto = np.exp(value)
        more, nth = np.flatnonzero(count > 1), 1
        while len(more):
            e = begin[more] + nth
            self.upto[e] += self.upto[e - 1]
            nth += 1
            more = more[count[more] > nth]

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that the number u in [0, 1) falls on."""
        e, last = self.first[node], self.last[node] - 1
        at = np.flatnonzero((self.upto[e] <= u) & (e < last))
        while len(at):
            now = e[at] + 1
            e[at] = now
            at = at[(self.upto[now] <= u[at]) & (now < last[at])]
        return e

    def pick_one(self, node: int, u: float) -> int:
        """``pick`` for one node."""
        e, last = int(self.first[node]), int(self.last[node]) - 1
        while e < last and self.upto[e] <= u:
            e += 1
        return e


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((_text.mix(h) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _mix(h: int) -> int:
    """``_text.mix`` of one number."""
    h &= _ALL
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _ALL
    return h ^ (h >> 31)


def _unit(h: int) -> float:
    return ((_mix(h) >> 11) + 0.5) * 2.0**-53


def _cut_gumbel(loc: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel noise around ``loc``, given that it is less than ``top``."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - loc)


def _paths(lat: _Lattices, unit: np.ndarray, end: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A random path through each word occurrence: edges in order, and where each one's begin."""
    at, live = unit, np.arange(len(unit))
    found, of, count, step = [], [], np.zeros(len(unit), np.int64), 0
    while len(live):
        e = lat.pick(at, _uniform(seed[live] + _U((step + 1) * _GOLD % (1 << 64))))
        found.append(e)
        of.append(live)
        step += 1
        count[live] = step
        at = lat.dst[e]
        go = np.flatnonzero(at < end[live])
        at, live = at[go], live[go]
    begin = np.concatenate([[0], np.cumsum(count)])
    edges = np.empty(int(begin[-1]), np.int64)
    for i, (e, units) in enumerate(zip(found, of, strict=True)):
        edges[begin[units] + i] = e
    return edges, begin


class _Search:
    """The queue of one text. Regions are (-score, path, node): all segmentations that follow a path up
    to a node and leave it there by an edge not taken yet.

    The nodes of a path behind the one at which its probability falls below exp(-``DEEP``) are one
    region first, marked by its first node's complement; it is split once it is taken.
    """

    DEEP = 40.0

    def __init__(self, lat: _Lattices, key: int, k: int) -> None:
        self.lat, self.key, self.k = lat, key, k
        self.queue: list[tuple[float, int, int]] = []
        self.paths: list[np.ndarray] = []
        self.excluded: list[dict[int, list[int]]] = []
        self.prefix: list[np.ndarray] = []

    def _masses(self, path: int, lo: int, hi: int) -> np.ndarray:
        """Log mass of what is not taken at nodes lo..hi-1 of a path."""
        lat, edges = self.lat, self.paths[path][lo:hi]
        with np.errstate(divide="ignore"):
            left = np.log(np.maximum(-np.expm1(lat.log_p[edges]), 1e-300))
        alone = lat.last[lat.src[edges]] - lat.first[lat.src[edges]] == 1
        return np.where(alone, -np.inf, self.prefix[path][lo:hi] + left)

    def _push(self, path: int, lo: int, mass: np.ndarray, top: float, skip: int = -1) -> None:
        open_ = np.flatnonzero(mass > -np.inf)
        u = _uniform(_U(self._seed(path, -2)) + (lo + open_ + 1).astype(_U) * _U(_GOLD))
        score = _cut_gumbel(mass[open_], top, u)
        # No more than k regions are ever taken, and one more is looked at.
        best = np.argpartition(-score, self.k + 1)[: self.k + 2] if len(score) > self.k + 2 else np.arange(len(score))
        for i in best.tolist():
            if lo + open_[i] != skip:
                heapq.heappush(self.queue, (-float(score[i]), path, lo + int(open_[i])))

    def _seed(self, path: int, node: int) -> int:
        return _mix(self.key + (path + 1) * 0xD6E8FEB86659FD93 + (node + 1) * 0xCA5A826395121157)

    def branch(self) -> tuple[float, int, int, int] | None:
        """Take the best region: its score, path, node and the edge it goes on with."""
        if not self.queue:
            return None
        score, path, node = heapq.heappop(self.queue)
        top, lat = -score, self.lat
        if node < 0:
            deep = ~node
            self.prefix[path] = np.concatenate([[0.0], np.cumsum(lat.log_p[self.paths[path]])])
            mass = self._masses(path, deep, len(self.paths[path]))
            share = np.cumsum(np.exp(mass - mass.max()))
            node = deep + min(int(np.searchsorted(share, _unit(self._seed(path, -4)) * share[-1], "right")), len(mass) - 1)
            self._push(path, deep, mass, top, skip=node)
        used = self.excluded[path].setdefault(node, [int(self.paths[path][node])])
        place = int(lat.src[used[0]])
        options = [e for e in range(int(lat.first[place]), int(lat.last[place])) if e not in used]
        p = [math.exp(x) for x in lat.log_p[options].tolist()]
        seed = self._seed(path, node + 1 + (len(used) << 32))
        u, i = _unit(seed) * sum(p), 0
        while i < len(p) - 1 and u >= p[i]:
            u -= p[i]
            i += 1
        used.append(options[i])
        left = sum(p[:i]) + sum(p[i + 1 :])
        if len(p) > 1:
            mass = float(self.prefix[path][node]) + math.log(left)
            g = _cut_gumbel(mass, top, _unit(seed ^ 0x5851F42D4C957F2D))
            heapq.heappush(self.queue, (-float(g), path, node))
        return top, path, node, options[i]


def _add_all(lat: _Lattices, found: list[tuple[_Search, int, float]], whole: np.ndarray, cut: list[int], log_p: np.ndarray) -> list[float]:
    """The paths ``whole[cut[i]:cut[i + 1]]``, with the log probabilities of their edges, join the searches of
    ``found`` (search, first node that is a new region, score); returns their own log probabilities."""
    k, totals, opened, deeper = found[0][0].k, [], [], []
    prefixes = []
    for i, (s, start, _) in enumerate(found):
        lo, hi = cut[i], cut[i + 1]
        totals.append(float(log_p[lo:hi].sum()))
        prefix = np.zeros(hi - lo + 1)
        np.cumsum(log_p[lo:hi], out=prefix[1:])
        deep = max(start, int(np.searchsorted(-prefix, s.DEEP)))
        opened.append((lo + start, lo + max(start, min(deep, hi - lo))))
        if deep < hi - lo:
            deeper.append((i, deep))
        prefixes.append(prefix)
    span = np.array(opened, np.int64)
    size = span[:, 1] - span[:, 0]
    row = np.repeat(np.arange(len(found)), size)
    at = np.arange(len(row)) + np.repeat(span[:, 0] - (np.cumsum(size) - size), size)
    src = lat.src[whole[at]]
    some = np.flatnonzero(lat.last[src] - lat.first[src] > 1)
    row, at = row[some], at[some]
    before = np.concatenate([x[:-1] for x in prefixes])[at]
    mass = before + np.log(np.maximum(-np.expm1(log_p[at]), 1e-300))
    node = at - np.array(cut)[row]
    seed = np.array([s._seed(len(s.paths), -2) for s, *_ in found], _U)
    top = np.array([t for *_, t in found])
    score = _cut_gumbel(mass, top[row], _uniform(seed[row] + (node + 1).astype(_U) * _U(_GOLD)))
    bounds = np.searchsorted(row, np.arange(len(found) + 1)).tolist()
    for i, (s, *_) in enumerate(found):
        lo, hi = bounds[i], bounds[i + 1]
        # No more than k regions are ever taken, and one more is looked at.
        best = np.argpartition(-score[lo:hi], k + 1)[: k + 2] + lo if hi - lo > k + 2 else np.arange(lo, hi)
        for g, n in zip(score[best].tolist(), node[best].tolist(), strict=True):
            heapq.heappush(s.queue, (-g, len(s.paths), n))
    for i, deep in deeper:
        s, _, t = found[i]
        rest = float(prefixes[i][deep]) + math.log(max(-math.expm1(totals[i] - float(prefixes[i][deep])), 1e-300))
        g = _cut_gumbel(rest, t, _unit(s._seed(len(s.paths), -3)))
        heapq.heappush(s.queue, (-float(g), len(s.paths), ~deep))
    for i, (s, *_) in enumerate(found):
        s.paths.append(whole[cut[i] : cut[i + 1]])
        s.excluded.append({})
        s.prefix.append(prefixes[i])
    return totals


def _units(chunk: _text.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a space put before each, cut before runs of spaces: bytes, starts, ends, row bounds."""
    n = len(chunk.offsets) - 1
    sizes = np.diff(chunk.offsets)
    some = sizes > 0
    data = np.insert(chunk.data, chunk.offsets[:-1][some], 0x20)
    bounds = chunk.offsets + np.concatenate([[0], np.cumsum(some)])
    cut = data == 0x20
    cut[1:] &= data[:-1] != 0x20
    cut[bounds[:-1][some]] = True
    # Line feeds are in no piece of more than one character, so that words end there too.
    feed = data == 0x0A
    cut[1:] |= feed[:-1]
    cut |= feed
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data))
    assert n == len(bounds) - 1
    return data, start, end, np.searchsorted(start, bounds)


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the distinct words, and which of them each word is."""
    up, down = _text.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_text._BYTE[data] * up[: len(data)], out=sums[1:])
    h = _text.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    size = (end - start)[first]
    stop = np.cumsum(size)
    take = np.repeat(start[first] - (stop - size), size) + np.arange(int(size.sum()))
    return data[take], stop - size, stop, which


def _decoded(v: Vocabulary, lat: _Lattices, words: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of edges in order, how many each edge has, and the bytes they stand for."""
    ids = lat.piece[paths]
    several = np.flatnonzero(ids < 0)
    count = np.ones(len(ids), np.int64)
    count[several] = lat.dst[paths[several]] - lat.src[paths[several]]
    full = np.repeat(ids, count)
    if len(several):
        at = (np.cumsum(count) - count)[several]
        n = count[several]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        full[np.repeat(at, n) + nth] = v.byte_piece[words[np.repeat(lat.src[paths[several]], n) + nth]]
    size = v.size[full]
    begin = np.repeat(v.begin[full] - (np.cumsum(size) - size), size)
    return full, count, v.flat[begin + np.arange(len(begin))]


class _Library:
    """The library's encoder. A BPE model merges only what a piece holds, so where no piece goes on with a
    space or holds a line feed beside others, each distinct word of a chunk is encoded once. Texts with the
    character that stands for spaces in pieces are encoded whole, as are all texts with other models."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.by_words = False
        self.feed = sp.encode("\n")
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:  # protobuf may be absent
            return
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        how, trainer = model.normalizer_spec, model.trainer_spec
        plain = how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces and not how.precompiled_charsmap
        kinds = model.SentencePiece
        usual = all(p.type in (kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE) for p in model.pieces)
        within = all(_MARK not in p.piece.lstrip(_MARK) and ("\n" not in p.piece or p.piece == "\n") for p in model.pieces)
        bpe = trainer.model_type == trainer.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
        self.by_words = bool(bpe and plain and usual and within and len(self.feed) == 2)

    def whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Pieces of texts, and whether the library decodes them to the texts again."""
        found = self.sp.encode(texts, num_threads=1)
        return found, [a == b for a, b in zip(self.sp.decode(found, num_threads=1), texts, strict=True)]

    def words(self, v: Vocabulary, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of distinct words one after another, how many each has, and whether they decode to it."""
        first = self.feed[-1]
        feed = np.flatnonzero((end - start == 1) & (words[start] == 0x0A))
        # Words stand between line feeds, which nothing merges with.
        size = end - start + 1
        stop = np.cumsum(size)
        text = np.full(int(stop[-1]) if len(stop) else 0, 0x0A, np.uint8)
        text[np.arange(len(words)) + np.repeat(np.arange(1, len(size) + 1), end - start)] = words
        cuts = np.append(np.unique(np.searchsorted(stop, np.arange(0, len(text), PART), "right")), len(size))
        parts = [text[stop[a] - size[a] : stop[b - 1]].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(x[1:], np.int32) for x in self.sp.encode(parts, num_threads=1))])
        breaks = np.flatnonzero(ids == first)
        # A line feed of its own is a second break behind its word's.
        own = np.ones(len(breaks), bool)
        own[feed + 1 + np.arange(len(feed))] = False
        breaks = breaks[own]
        if len(breaks) != len(size):
            raise ValueError("the library's pieces cross words")
        count = np.diff(np.append(breaks, len(ids))) - 1
        ids = np.delete(ids, breaks)
        bytes_ = np.repeat(v.begin[ids] - (np.cumsum(v.size[ids]) - v.size[ids]), v.size[ids])
        back = v.flat[bytes_ + np.arange(len(bytes_))]
        # Bytes of each word's pieces, and of those that differ from the word's.
        upto = np.concatenate([[0], np.cumsum(v.size[ids])])[np.concatenate([[0], np.cumsum(count)])]
        same = np.diff(upto) == end - start
        off = upto[:-1] - start
        at = np.flatnonzero(np.repeat(same, end - start))
        wrong = words[at] != back[at + np.repeat(off, end - start)[at]]
        same[np.searchsorted(end, at[wrong], "right")] = False
        return ids, count, same


def _own(lib: _Library, v: Vocabulary, chunk: _text.Chunk, cut: tuple) -> tuple[list[np.ndarray], list[bool]]:
    """The library's own segmentation of a chunk's texts, and whether each decodes to its text."""
    n = len(chunk.offsets) - 1
    raw = chunk.data.tobytes()
    bounds = chunk.offsets.tolist()
    text = lambda r: raw[bounds[r] : bounds[r + 1]].decode()
    if not lib.by_words:
        found, same = lib.whole([text(r) for r in range(n)])
        return [np.array(x, np.int32) for x in found], same
    rows, (words, w_start, w_end, which) = cut
    ids, count, right = lib.words(v, words, w_start, w_end)
    begin = np.cumsum(count) - count
    size = count[which]
    upto = np.concatenate([[0], np.cumsum(size)])
    full = ids[np.arange(int(upto[-1])) + np.repeat(begin[which] - upto[:-1], size)]
    at = upto[rows].tolist()
    found = [full[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    wrong = np.concatenate([[0], np.cumsum(~right[which])])[rows]
    same = (np.diff(wrong) == 0).tolist()
    mark, marked = _MARK.encode(), set()
    place = raw.find(mark)
    while place >= 0:
        r = int(np.searchsorted(chunk.offsets, place, "right")) - 1
        marked.add(r)
        place = raw.find(mark, bounds[r + 1])
    if marked:
        some = sorted(marked)
        for r, x, y in zip(some, *lib.whole([text(r) for r in some]), strict=True):
            found[r], same[r] = np.array(x, np.int32), y
    return found, same


def _segment(v: Vocabulary, chunk: _text.Chunk, keys: np.ndarray, k: int, with_pieces: bool, lib: _Library | None = None) -> list[tuple]:
    """(row, sample, pieces, log_prob, perturbed, log_inclusion, round trip) of each sample, and with ``lib``
    of the library's own segmentation, as sample -1 without scores."""
    data, start, end, rows = _units(chunk)
    n = len(chunk.offsets) - 1
    words, w_start, w_end, which = _distinct(data, start, end)
    own_rows = []
    if lib:
        given, right = _own(lib, v, chunk, (rows, (words, w_start, w_end, which)))
        own_rows = [(r, -1, x if with_pieces else len(x), None, None, None, y) for r, (x, y) in enumerate(zip(given, right, strict=True))]
    lat = _Lattices(v, words, w_start, w_end)
    unit, stop = w_start[which], w_end[which]
    row_of = np.repeat(np.arange(n), np.diff(rows))
    place = (np.arange(len(start)) - rows[row_of]).astype(_U)
    bounds = np.append(start, len(data))[rows]
    key_of = [int(x) for x in keys[:n]]
    out: list[list] = [[] for _ in range(n)]
    search: list[_Search] = []
    for sample in range(k):
        salt = keys[row_of] + _U((sample + 1) * 0xA0761D6478BD642F % (1 << 64)) + place * _U(0xE7037ED1A0B428DB)
        edges, begin = _paths(lat, unit, stop, _text.mix(salt))
        ends = begin[rows]
        paths, starts, tops, own = [], [], [], []
        for r in range(n):
            lo, hi = int(rows[r]), int(rows[r + 1])
            if not sample:
                search.append(_Search(lat, key_of[r], k))
                paths.append(edges[ends[r] : ends[r + 1]])
                starts.append(0)
                tops.append(-math.log(-math.log(_unit(key_of[r] ^ 0x94D049BB133111EB))))
                own.append(r)
                continue
            s = search[r]
            found = s.branch()
            if found is None:
                continue
            top, of, node, edge = found
            old = s.paths[of][:node]
            # The word of the text that the node is in: words end where an edge reaches a word's end.
            word = lo + int(np.count_nonzero(lat.dst[old] == lat.limit[lat.src[old]]))
            head, at, inside = [edge], int(lat.dst[edge]), 0
            while at < int(stop[word]):
                u = _unit(s._seed(len(s.paths), inside) ^ 0x2545F4914F6CDD1D)
                head.append(lat.pick_one(at, u))
                at, inside = int(lat.dst[head[-1]]), inside + 1
            paths.append(np.concatenate([old, np.array(head, np.int64), edges[begin[word + 1] : begin[hi]]]))
            starts.append(node + 1)
            tops.append(top)
            own.append(r)
        if not paths:
            break
        whole = np.concatenate(paths)
        cut = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
        full, count, back = _decoded(v, lat, words, whole)
        piece_cut = np.concatenate([[0], np.cumsum(count)])[cut]
        byte_cut = np.concatenate([[0], np.cumsum(v.size[full])])[piece_cut]
        totals = _add_all(lat, [(search[r], starts[i], tops[i]) for i, r in enumerate(own)], whole, cut.tolist(), lat.log_p[whole])
        for i, r in enumerate(own):
            total = totals[i]
            same = np.array_equal(back[byte_cut[i] : byte_cut[i + 1]], data[bounds[r] : bounds[r + 1]])
            a, b = int(piece_cut[i]), int(piece_cut[i + 1])
            out[r].append([full[a:b] if with_pieces else b - a, sample, total, tops[i], 0.0, same])
    for r in range(n):
        rest = -search[r].queue[0][0] if search[r].queue else -math.inf
        for item in out[r]:
            # log(1 - exp(-exp(log_prob - rest)))
            gap = item[2] - rest
            item[4] = 0.0 if gap > 700 else gap if gap < -20 else math.log(-math.expm1(-math.exp(gap)))
    return own_rows + [(r, i[1], i[0], i[2], i[3], i[4], i[5]) for r, items in enumerate(out) for i in items]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def _sampler(proto, alpha: float, k: int, seed: int, with_pieces: bool, own: bool):
    def sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(proto.value, alpha)
        lib = _library(proto.value) if own else None
        for batch in _text.batches(it):
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            keys = _text.mix(ids * _U(0xD1342543DE82EF95) + _U((seed + 1) * _GOLD % (1 << 64)))
            for c in _text.chunks(batch.column(1), CHUNK):
                found = _segment(v, c, keys[c.first :], k, with_pieces, lib)
                row, number, pieces, log_p, top, inc, same = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.array(row) + c.first)),
                        pa.array(number, pa.int32()),
                        _lists(pieces) if with_pieces else pa.array(pieces, pa.int64()),
                        pa.array(log_p, pa.float64()),
                        pa.array(top, pa.float64()),
                        pa.array(inc, pa.float64()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["key", "sample", "pieces" if with_pieces else "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip"],
                )

    return sample


def sample_segmentations(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = 2,
    alpha: float = 1.0,
    seed: int = 0,
    model: str | None = None,
    with_pieces: bool = True,
    own: bool = False,
) -> DataFrame:
    """Up to ``k`` rows for each text: key, sample (from 0), pieces, log_prob, perturbed,
    log_inclusion, round_trip (decoding gives the text back); n_pieces without ``with_pieces``. With ``own`` one
    more row, sample -1 without scores: the library's own segmentation, as ``encode_texts`` gives it."""
    with open(model or default_model(), "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    schema = "key long, " + (SCHEMA if with_pieces else SCHEMA.replace("pieces array<int>", "n_pieces long"))
    return rows.mapInArrow(_sampler(proto, alpha, k, seed, with_pieces, own), schema)


def _encoder(proto):
    def encode_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, v = _library(proto.value), _vocabulary(proto.value, 1.0)
        for batch in _text.batches(it):
            for c in _text.chunks(batch.column(1), CHUNK):
                data, start, end, rows = _units(c)
                found, same = _own(lib, v, c, (rows, _distinct(data, start, end)))
                keys = batch.column(0).slice(c.first, len(found))
                yield pa.RecordBatch.from_arrays([keys, _lists(found), pa.array(same, pa.bool_())], ["key", "pieces", "round_trip"])

    return encode_batches


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """The library's own segmentation of each text: key, pieces, round_trip (the library decodes it to the
    text again, which it does not for a text with the character that stands for spaces in pieces)."""
    with open(model or default_model(), "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_encoder(proto), "key long, pieces array<int>, round_trip boolean")


def encode(texts: list[str], model: str | None = None) -> list[list[int]]:
    """The library's own segmentation."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model or default_model()).encode(texts, num_threads=1)


def decode(pieces: list[list[int]], model: str | None = None, alpha: float = 1.0) -> list[str]:
    """Texts of piece lists, byte pieces included."""
    with open(model or default_model(), "rb") as f:
        v = _vocabulary(f.read(), alpha)
    return [b"".join(v.bytes[i] for i in p)[1:].decode(errors="replace") for p in pieces]
