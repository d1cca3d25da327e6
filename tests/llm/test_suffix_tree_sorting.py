"""Grams of a chunk and of a bucket are numbered as by a plain sort, in less time."""

import time

import numpy as np
import pytest

from corpuslake.llm import suffix_tree


def text(n, letters):
    rng = np.random.default_rng(5)
    known = [bytes(rng.choice(np.frombuffer(letters, np.uint8), rng.integers(2, 9))) for _ in range(3000)]
    return b" ".join(known[int(3000 * x**3)] for x in rng.random(n))


@pytest.mark.parametrize("texts", [[b""], [b"a"], [b"", b"ab ab", text(5000, b"abcdefgh")], [np.random.default_rng(6).integers(128, 256, 20000, np.uint8).tobytes()]])
def test_numbers_equal_a_plain_sort(texts):
    s, scored, _ = suffix_tree._stream(texts)
    g = suffix_tree._grams(s)[scored]
    want, at = np.unique(g.byteswap(), return_inverse=True)
    names, back = suffix_tree._numbered(s, scored)
    assert (names == want).all() and (back == at).all()
    parts = np.concatenate([suffix_tree._distinct(x.byteswap()).byteswap() for x in np.array_split(g, 5)])
    want, at = np.unique(parts, return_inverse=True)
    names, back = suffix_tree._merged(parts)
    assert (names == want).all() and (back == at).all()


def test_a_chunk_takes_less_time_than_a_plain_sort_of_places():
    s, scored, _ = suffix_tree._stream([text(250_000, b"abcdefghijklmnop")])

    def least(f):
        took = []
        for _ in range(3):
            t = time.process_time()
            f()
            took.append(time.process_time() - t)
        return min(took)

    plain = least(lambda: np.unique(suffix_tree._grams(s)[scored].byteswap(), return_inverse=True))
    assert least(lambda: suffix_tree._numbered(s, scored)) < 0.9 * plain
