from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import _text
from tests.llm import brute


@given(st.lists(st.none() | st.text(alphabet="aAzZ \t\n\x0b\x1f é☃\x00", max_size=30), max_size=8))
@settings(max_examples=100, deadline=None)
def test_words_equal_the_regular_expression(texts):
    for c in _text.chunks(pa.array(texts, pa.string()), limit=40):
        w = _text.words(c, lower=True)
        data = _text.LOWER[c.data].tobytes()
        for r in range(len(c.offsets) - 1):
            got = [data[a:b].decode() for a, b in zip(w.start[w.rows[r] : w.rows[r + 1]], w.end[w.rows[r] : w.rows[r + 1]], strict=True)]
            assert got == brute.words(texts[c.first + r])


def test_hashes_tell_words_not_places():
    texts = ["the cat", "cat the the", "é cat"]
    (c,) = _text.chunks(pa.array(texts))
    w = _text.words(c)
    assert w.hash[0] == w.hash[3] == w.hash[4] and w.hash[1] == w.hash[2] == w.hash[6] and len(set(w.hash)) == 3
    for k in (2, 9):
        (c,) = _text.chunks(pa.array(["z a b c d e f g h i j q a b c d e f g h i j"]))
        g = _text.grams(_text.words(c), k)
        assert g[1] == g[12] and len(set(g)) < len(g)


def test_chunks_cover_sliced_and_empty_columns():
    column = pa.array(["ab", None, "", "cde", "f"]).slice(1)
    got = [bytes(c.data[a:b]) for c in _text.chunks(column, 2) for a, b in zip(c.offsets[:-1], c.offsets[1:], strict=True)]
    assert got == [b"", b"", b"cde", b"f"]
    assert not list(_text.chunks(pa.array([], pa.string())))
    assert np.array_equal(_text.powers(3)[0] * _text.powers(3)[1], np.ones(3, np.uint64))
