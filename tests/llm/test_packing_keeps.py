"""Packing asks for the ids of words met again once, though its worker remembers too many pieces."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark

from corpuslake.llm import packing, tokens


def test_words_met_again_are_asked_for_once(spark, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 400)
    monkeypatch.setattr(tokens, "_open", {})
    monkeypatch.setattr(packing, "map_arrow", lambda df, run, schema, remembers: run)
    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    asked, words = [], tokens.PieceEncoder._words
    monkeypatch.setattr(tokens.PieceEncoder, "_words", lambda self, w: (asked.extend(w), words(self, w))[1])
    rng = np.random.default_rng(6)
    made = lambda n: ["".join(x) for x in rng.choice(list("abcdefgh"), (n, 7))]
    often = made(50)
    texts = ["so " + " ".join([*often, *made(150), *often]) for _ in range(12)]
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    run = packing.token_pieces(docs, path, 1024, 2, False)
    batches = (pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], names=["doc_id", "text"]) for i, t in enumerate(texts))
    whole = tokens.PieceEncoder(path, True)._whole
    lengths: dict[int, int] = {}
    for batch in run(batches):
        for i, n in zip(batch.column("doc_id").to_pylist(), batch.column("length").to_pylist(), strict=True):
            lengths[i] = lengths.get(i, 0) + n
    assert lengths == {i: len(whole(t)) + 1 for i, t in enumerate(texts)}
    assert all(asked.count(w) == 1 for w in often)
