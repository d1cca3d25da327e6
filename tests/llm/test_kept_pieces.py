"""A tokenizer's worker that remembers too many pieces keeps those met again, and its ids stay those of the whole text."""

import numpy as np

from corpuslake.llm import tokens


def test_pieces_met_again_are_encoded_once(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 400)
    path = tokens.tokenizer_path("word_bpe_49k.json")
    e = tokens.PieceEncoder(path, False, keeps=True)
    encoded = []
    words = e._words
    monkeypatch.setattr(e, "_words", lambda w: (encoded.extend(w), words(w))[1])
    rng = np.random.default_rng(8)
    made = lambda n: ["".join(x) for x in rng.choice(list("abcdefgh"), (n, 7))]
    often = made(50)
    for _ in range(12):
        once = made(150)
        texts = [" ".join(often + once), " ".join([*often[::-1], *(w + "," for w in often), "x-1 déjà."])]
        for text, ids in zip(texts, e.many(texts), strict=True):
            assert ids.tolist() == e._whole(text)
    assert len(e.numbers) < 1000
    assert all(encoded.count(w) == 1 for w in often)
