"""Anchors of texts of more words than the index in a key holds."""

from types import SimpleNamespace

import numpy as np

from corpuslake.llm import substrings


def test_anchors_beyond_two_to_the_24_words():
    n, size, tail = (1 << 24) + 500, 50, 400
    words = np.random.default_rng(2).integers(0, 1 << 63, n).astype(np.uint64)
    doc, at, many, anchor = substrings._segments(SimpleNamespace(words=words, first=np.array([0, n])), size)
    of = dict(zip((at[-3:] - (n - tail)).tolist(), anchor[-3:].tolist(), strict=True))
    _, alone, _, want = substrings._segments(SimpleNamespace(words=words[-tail:], first=np.array([0, tail])), size)
    assert of == dict(zip(alone[-3:].tolist(), want[-3:].tolist(), strict=True))
    assert (many - size + 1).sum() == n - size + 1
