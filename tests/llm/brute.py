"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Texts that are awkward one way or another.
ODD = [
    None, "", " ", "\n", "\n\n", "a", "\ta b\x0bc\x0c", "É é ﬀ ☃ 𝒳 \x00 x", "x" * 30000, "word " * 3000, "Straße ÀÉ ÀÉ straße", "one two three four", "one two three four five",
    "A line that is long enough to count\nshort\nA LINE that is long enough to count", "\r\n tail \r\n",
]


def words(text, pattern=SPACE, lower=True):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(docs):
    """{id: (n_shingles, component)} under links of similarity 0.75."""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def line_dedup(docs, min_chars=20, min_docs=3):
    """{id: (n_lines, n_dropped, text)}."""
    holders = defaultdict(set)
    split = {d: (t or "").split("\n") for d, t in docs}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for d, ls in split.items():
        for line in ls:
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = {}
    for d, ls in split.items():
        kept = [x for x in ls if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == d]
        out[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def contamination(docs, items, window=10):
    """{id: (n_words, n_hit, item ids)}."""
    out = {}
    wanted = [(i, words(t, WORD)) for i, t in items]
    for d, t in docs:
        w = words(t, WORD)
        hit, found = set(), set()
        for i, iw in wanted:
            k = min(len(iw), window)
            grams = {tuple(iw[s : s + k]) for s in range(len(iw) - k + 1)} if k else set()
            for s in range(len(w) - k + 1) if k else ():
                if tuple(w[s : s + k]) in grams:
                    hit |= set(range(s, s + k))
                    found.add(i)
        out[d] = (len(w), len(hit), sorted(map(str, found)))
    return out


def remove_repeats(docs, length=50):
    """{id: (n_words, n_removed, kept)}."""
    first = {}
    split = {d: words(t, lower=False) for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < d:
                gone |= set(range(s, s + length))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def tree_scores(training, texts, gain, strength, depth=6, trunk=3, min_count=2):
    """log10 probability of each text under the suffix tree of the training texts."""
    seq = lambda t: bytes(depth) + (t or "").translate(LOWER).encode() + b"\xff"
    counts = defaultdict(Counter)
    for t in training:
        s = seq(t)
        for i in range(depth, len(s)):
            for n in range(depth + 1):
                counts[s[i - n : i]][s[i]] += 1
    total = {c: sum(x.values()) for c, x in counts.items()}

    def significant(c):
        told = sum(n * math.log(n / total[c] / (counts[c[1:]][s] / total[c[1:]])) for s, n in counts[c].items())
        return told >= gain + len(counts[c]) - 1

    retained = {c for c in counts if len(c) < trunk}
    for c in counts:
        if len(c) >= trunk and significant(c):
            retained.update(c[i:] for i in range(len(c)))

    def p(c, s):
        if c not in retained:
            return p(c[1:], s) if c else 1 / 256
        tabled = {x: n for x, n in counts[c].items() if n >= min_count}
        weight = strength * len(counts[c])
        below = p(c[1:], s) if c else 1 / 256
        return (tabled.get(s, 0) + (weight + total[c] - sum(tabled.values())) * below) / (total[c] + weight)

    out, known = [], {}
    for t in texts:
        s = seq(t)
        score = 0.0
        for i in range(depth, len(s)):
            at = s[i - depth : i], s[i]
            if at not in known:
                known[at] = math.log10(p(*at))
            score += known[at]
        out.append(score)
    return out


def near_matches(docs, items, window=10, near=8, slack=1):
    """{(doc, item, start): most words in place} of windows that are near, but not whole, in a document."""
    out = {}
    for d, text in docs:
        have = words(text, WORD, lower=True)
        for i, item in items:
            w = words(item, WORD, lower=True)
            size = min(window, len(w))
            for start in range(len(w) - size + 1) if size >= near else ():
                most, whole = 0, False
                for shift in range(-len(w), len(have) + 1):
                    at = lambda k, by, s=shift: 0 <= s + k + by < len(have) and have[s + k + by] == w[k]  # noqa: E731, B023
                    inside = range(start, start + size)
                    most = max(most, sum(any(at(k, by) for by in range(-slack, slack + 1)) for k in inside))
                    whole |= all(at(k, 0) for k in inside)
                if most >= near and not whole:
                    out[d, i, start] = most
    return out
