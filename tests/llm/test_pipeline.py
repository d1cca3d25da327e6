"""The pipeline as a whole on a small fixture: every stage against a brute-force version of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpuslake.llm.tokens import tokenizer_path

GOOD, BAD = [f"good{i}" for i in range(150)], [f"zzz{i}q" for i in range(8)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    text = lambda v, n: " ".join(rng.choice(v, n).tolist())
    bench = [f"bench{i} " + text(GOOD, 20) for i in range(3)]
    docs, labels = [], []
    for i in range(160):
        bad = i % 3 == 0
        docs.append((i, text(BAD if bad else GOOD, 90)))
        labels.append((i, int(not bad), 0))
    docs += [(200, docs[1][1]), (201, docs[2][1] + " tail"), (202, text(GOOD, 40) + " " + bench[1] + " " + text(GOOD, 10)), (203, text(GOOD, 60) + " mail a.b@c.de now"), (204, None), (205, ""), (None, text(GOOD, 70))]
    where = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(str(i), t) for i, t in enumerate(bench)], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages(spark, folder):
    docs, seen = corpus_pipeline.table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stash(stage(spark, docs, folder), "test")
        seen[name] = {r.doc_id: r for r in out.collect()}
        if name != "best-fit packing":
            assert out.columns == corpus_pipeline.COLUMNS
            docs, last = out, out
    quality = set(seen["quality classifier"])
    assert all((i in quality) == (i % 3 != 0) for i in range(160)) and {200, 201, 202, 203, None} <= quality
    assert set(seen["n-gram Jaccard join"]) == quality - {200, 201}
    clean = set(seen["benchmark decontamination"])
    assert clean == set(seen["n-gram Jaccard join"]) - {202}
    assert set(seen["PII"]) == clean and seen["PII"][203].text.endswith("mail [EMAIL] now")
    pieces = out.toPandas().sort_values(["sequence_id", "offset"])
    assert (pieces.groupby("sequence_id")["length"].cumsum() - pieces["length"] == pieces["offset"]).all()
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in last.where(F.col("doc_id").isNotNull()).collect():
        own = pieces[pieces.doc_id == r.doc_id].sort_values("piece")
        ids = np.concatenate([np.frombuffer(x, dtype="<u2") for x in own["ids"]]).tolist()
        assert ids == tok.encode(r.text or "", add_special_tokens=False).ids + [2]


def test_run_gives_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 50


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
