"""A tokenizer's worker asks for the ids of a word once, whatever its case or the marks after it; ids stay those of the whole text."""

import numpy as np
import pytest

from corpuslake.llm import tokens

WORD, BYTE = ("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)


def asked(e, monkeypatch):
    """What the tokenizer itself, and what the model, gets from now on."""
    out, each, words = [], e._each, e._words
    monkeypatch.setattr(e, "_each", lambda t: (out.extend(t), each(t))[1])
    monkeypatch.setattr(e, "_words", lambda w: (out.extend(w), words(w))[1])
    return out


@pytest.mark.parametrize(("name", "spaces_count"), [WORD, BYTE])
def test_a_word_is_asked_for_once(monkeypatch, name, spaces_count):
    e = tokens.PieceEncoder(tokens.tokenizer_path(name), spaces_count, keeps=True)
    out = asked(e, monkeypatch)
    rng = np.random.default_rng(3)
    words = ["".join(x) for x in rng.choice(list("abcdefghé"), (300, 8))]
    forms = [words, [w + "," for w in words], [w + "$$$" for w in words], [w + '."' for w in words]]
    if not spaces_count:
        forms += [[w.title() for w in words if w.isascii()], [w.upper() + "%" for w in words if w.isascii()]]
    for form in forms:
        text = "so " + " ".join(form)
        assert e(text).tolist() == e._whole(text)
    assert len(out) < len(words) + 20


@pytest.mark.parametrize(("name", "spaces_count"), [WORD, BYTE])
def test_cuts_are_those_of_the_whole_text(name, spaces_count):
    e = tokens.PieceEncoder(tokens.tokenizer_path(name), spaces_count, keeps=True)
    parts = list("abSTéÉñÀ×÷İıŉſ") + [" "] * 9 + list("\n.,;:!?'\"-_$<|>=/09²½ªµǅΣςσ") + ["H̱", "ẖ", "≠", "ñ", "क़", "it's", ",'s", "'S ", "€", "　", "\t", "\x00"]
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 40, 2000)]
    texts += [" ".join(t.split()) for t in texts] + ["", "a <|endoftext|> b"]
    for text, ids in zip([None, *texts], e.many([None, *texts]), strict=True):
        assert ids.tolist() == (e._whole(text) if text else [])
