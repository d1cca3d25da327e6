"""A benchmark of several blocks gives what one block gives, with null and repeated ids."""

from corpuslake.llm import decontamination


def test_blocks_do_not_change_rows(spark, monkeypatch):
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    texts = [f"see {a} end", f"{b} {a}", "clean", None, " ".join(a.split()[4:] + ["x5", "x6"])]
    rows = [(i, t) for i in (None, 3, 3) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [("i1", a), ("i2", b), ("i3", " ".join(a.split()[4:] + ["x5", "x6"]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    take = lambda: sorted((repr((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in decontamination.matches(docs, bench).collect()))
    one = take()
    assert len(one) == len(rows)
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 1)
    assert len(decontamination._blocks(bench)) > 1
    assert take() == one
