import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from granulon.llm.lyndon import suffix_arrays


def check(texts):
    """Texts of symbols over 0; each gets the end symbol 0."""
    whole = [[*t, 0] for t in texts]
    base = np.cumsum([0] + [len(t) for t in whole])[:-1]
    got = suffix_arrays(np.array([x for t in whole for x in t], np.int64), base)
    for t, b in zip(whole, base, strict=True):
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert (got[b : b + len(t)] - b).tolist() == want, t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=8))
def test_small_alphabets(texts):
    check(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 257), max_size=60), min_size=1, max_size=5))
def test_bytes(texts):
    check(texts)


def test_periods_and_words():
    fib = [1], [1, 2]
    for _ in range(9):
        fib = fib[1], fib[1] + fib[0]
    check([[1] * 200, [1, 2] * 90, [2, 1] * 90, fib[1], [2, 1, 1] * 50 + [1], list(range(1, 80)), list(range(80, 0, -1)), []])
    assert len(suffix_arrays(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
