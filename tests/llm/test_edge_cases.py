"""Empty tables, null and repeated ids, and clashing columns through every operator."""

import pytest
from pyspark.sql import functions as F

from corpuslake.llm import codec, compression, decontamination, jaccard, packing, pii, substrings, suffix_tree, topk
from corpuslake.llm.tokens import tokenizer_path

ROWS = [(None, "a b c d e f"), (None, None), (1, ""), (1, "a b c d e f"), (2, "x@y.zz called"), (2, None)]


def operators(spark):
    bench = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0)], "doc_id long, y int")
    return {
        "op1": lambda d: compression.score(d, compression.train(d, labels, compression.TOXICITY)),
        "op2": lambda d: compression.score(d, compression.train(d, labels, compression.QUALITY)),
        "op3": lambda d: codec.read(codec.write(d, tokenizer_path("word_bpe_49k.json"))),
        "op4": lambda d: suffix_tree.score(d, F.coalesce(F.col("doc_id") == 1, F.lit(False))),
        "op5": lambda d: packing.pack(d, tokenizer_path("byte_bpe_50k.json")),
        "op6": lambda d: pii.find_spans(d, into="found"),
        "op8": lambda d: substrings.removed(d, 50),
        "op9": lambda d: decontamination.matches(d, bench),
        "op10": lambda d: jaccard.join(d),
        "redact": lambda d: pii.redact(d),
        "decontaminate": lambda d: decontamination.decontaminate(d, bench),
        "near_duplicates": lambda d: jaccard.near_duplicates(d),
    }


COUNTS = {"decontaminate": 4, "near_duplicates": 5}


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op8", "op9", "op10", "redact", "decontaminate", "near_duplicates"])
def test_null_and_repeated_ids_and_empty_table(spark, name):
    rows = [(*r, f"s{i}", [i], 1.5) for i, r in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n array<int>, score double")
    f = operators(spark)[name]
    assert f(df).count() == COUNTS.get(name, len(ROWS))
    assert f(df.limit(0)).count() == 0


def test_topk_without_rows(spark):
    df = spark.createDataFrame([(None, [1.0]), (20, None)], "vec_id long, embedding array<float>")
    assert topk.search(df).count() == 0


def test_substrings_with_dealt_groups(spark, monkeypatch):
    """Groups too many to be sent give what sent ones give."""
    monkeypatch.setattr(substrings, "SMALL", 0)
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    df = spark.createDataFrame([(i, f"{a} own{i}" if i % 2 else b) for i in range(12)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.removed(df, 50).collect()}
    assert got == {0: 0, 1: 0} | {i: 80 for i in range(2, 12)}
