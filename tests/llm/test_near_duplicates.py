"""Near duplicates where ids are null or repeated."""

from corpuslake.llm import jaccard


def text(name, changed=None):
    return " ".join("changed" if j == changed else f"{name}{j}" for j in range(80))


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text) for r in jaccard.near_duplicates(df).collect()), key=repr)


def test_other_texts_under_null_or_repeated_ids_stay(spark):
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (8, text("f"))]
    assert kept(spark, rows) == sorted(rows, key=repr)


def test_one_row_of_each_component_stays(spark):
    for ids in ((None, None), (5, 5), (5, None), (4, 5)):
        rows = [(ids[0], text("a")), (ids[0], text("a")), (ids[1], text("a", 3)), (ids[1], text("b")), (None, text("c")), (9, text("c", 70))]
        got = kept(spark, rows)
        assert (ids[1], text("b")) in got and (None, text("c")) in got and len(got) == 3
        last = next(r for r in got if "a1" in r[1].split())
        assert last in rows and last[0] == (None if None in ids else min(ids))


def test_texts_without_shingles_stay(spark):
    rows = [(None, None), (1, ""), (1, None), (2, "")]
    assert kept(spark, rows) == sorted(rows, key=repr)
