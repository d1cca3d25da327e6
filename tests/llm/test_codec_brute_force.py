"""The token files against the tokenizer on whole texts, null and repeated ids, and ids that don't fit."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpuslake.llm import codec
from corpuslake.llm.tokens import tokenizer_path

TEXTS = ["Plain words, twice. Plain words!", None, "", " \t\n", "d\u00e9j\u00e0 vu 123 x-y", "\x00nul \x1c odd", "<|endoftext|> a", "word " * 3000, "\u65e5\u672c\u8a9e \u0130x"]


def test_rows_equal_the_tokenizer(spark):
    rows = [(i, t) for i, t in zip([4, 3, 9, 1, 0, 7, 5, 2, 8], TEXTS, strict=True)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(3)
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want, start = [], 0
    for i, t in sorted(rows):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = codec.read(codec.write(df, tokenizer_path("word_bpe_49k.json")))
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == want


def test_null_and_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "d e"), (None, None)], "doc_id long, text string")
    got = codec.read(codec.write(df, tokenizer_path("word_bpe_49k.json"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1] and got[-1].start + got[-1].n_tokens == 9
    assert codec.read(codec.write(df.limit(0), tokenizer_path("word_bpe_49k.json"))).count() == 0


def test_large_ids_are_refused():
    with pytest.raises(ValueError, match="65535"):
        codec.encode_ids(np.array([1, 65536]))


def test_contexts_save_more_than_block_starts_cost():
    """Phrases that come back: far below the order-0 entropy of their ids."""
    rng = np.random.default_rng(4)
    phrases = [rng.integers(0, 40000, 12) for _ in range(60)]
    ids = np.concatenate([phrases[int(i)] for i in rng.integers(0, 60, 3000)])
    n = np.bincount(ids)
    n = n[n > 0]
    entropy = -(n * np.log2(n / n.sum())).sum()
    assert 8 * len(codec.encode_ids(ids)) < 0.5 * entropy
