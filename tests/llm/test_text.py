import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import text as T
from tests.llm import util as U


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b\x0cé😀.-", max_size=40)), max_size=8))
def test_words_equal_the_regular_expression(texts):
    row, h = T.words(pa.array(texts, pa.string()), T.SPACED, True)
    expected = [(i, w) for i, t in enumerate(texts) for w in U.words(t, True)]
    assert row.tolist() == [i for i, _ in expected]
    first = {}
    for (_, w), x in zip(expected, h.tolist()):
        assert first.setdefault(w, x) == x
    assert len(set(first.values())) == len(first)


def test_sliced_arrays_and_long_words():
    rng = random.Random(3)
    long = "".join(rng.choice("abc") for _ in range(3 * T._SEGMENT // 2))
    texts = pa.array(["x y", None, long, f"{long} z", ""], pa.string())
    row, h = T.words(texts)
    assert row.tolist() == [0, 0, 2, 3, 3] and h[2] == h[3]
    row2, h2 = T.words(texts.slice(2, 2))
    assert row2.tolist() == [0, 1, 1] and (h2 == h[2:]).all()


def test_row_shingles():
    texts = list(U.corpus().values())
    row, h = T.row_shingles(pa.array(texts, pa.string()), 5)
    counts = np.bincount(row, minlength=len(texts))
    assert counts.tolist() == [len(U.shingle_set(t)) for t in texts]


def test_slices_cover_all_rows():
    texts = pa.array(["a" * n for n in (0, 10, 3, 50, 0, 7)])
    got = list(T.slices(texts, 12))
    assert [a for a, _ in got] == [0, *(e for _, e in got[:-1])] and got[-1][1] == 6
    assert list(T.slices(pa.array([], pa.string()))) == []
