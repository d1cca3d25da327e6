"""Literal cases of the import gates and of canonical answers."""

import json

from pyspark.sql import functions as F

from corpuslake.operators import imports

LABEL = "struct<label:string,aliases:array<string>>"


def test_legacy_gates(spark):
    m = lambda a: [("user", "q"), ("assistant", a)]
    rows = [(1, "math", "external", "x", m("a")), (2, "math", "synthetic_curated", "curated_ru_smalltalk_v4", m("a")), (3, "math", "synthetic_curated", "x", None), (4, "math", "synthetic_curated", "x", m("z" * 1601)), (5, "math", "synthetic_computed", "x", m(" 12,5 ")), (6, "conversation", "synthetic_curated", "x", m("a")), (7, "language", "synthetic_curated", "x", m("a")), (8, "math", None, "x", m("a"))]
    got = imports.legacy(spark.createDataFrame(rows, "id long, category string, kind string, generator string, messages array<struct<role:string,content:string>>"))
    assert {r.id: r.reason for r in got.collect()} == {1: "non_synthetic", 2: "low_diversity_smalltalk_v4", 3: "bad_schema", 4: "empty_or_long_answer", 5: "bare_numeric_not_assistant_style", 6: "conversation_examples_excluded", 7: None, 8: "non_synthetic"}


def test_item_gates_and_canonical_answers(spark, tmp_path):
    item = lambda uid, q, a, props=(), answers=({"label": "Ann", "wd_names": {"ru": ["Анна"]}},): {"uid": uid, "question_text": q, "answer_text": a, "answers": list(answers), "question_props": list(props), "question_uris": ["Q1"]}
    rows = [item(1, "Кто это?", "анна"), item(2, "Кто это", "Анна"), item(3, "Кто это?", "Ира"), item(4, "Столица?", "Рим", ["wdt:P36"]), item(5, "Столица чего?", "Бонн", ["wdt:P36"]), item(6, "Какие города?", "Рим"), item(7, "Кто там?", "a", (), ()), item(8, "Who?", "Ann"), item(9, "Кто тут?", "Анна, Ира"), item(10, "Где?", "неизвестно"), item(11, "Чей?", "x", ["wdt:P54"]), item(12, "", "x"), item(13, "Кто здесь?", "Аннаа", (), ({"label": "Аннаб", "wd_names": None},)), item(14, "Что?", "x")]
    (tmp_path / "dev.json").write_text(json.dumps(rows))
    df = imports.read_items(spark, str(tmp_path / "dev.json"))
    excluded = spark.createDataFrame([("dev.json", 14)], "file string, uid long")
    got = {r.uid: r.reason for r in imports.items(df, excluded, ("рим",)).collect()}
    assert got == {1: None, 2: "exact_duplicate_question", 3: "exact_question_answer_conflict", 4: None, 5: "unverified_or_outdated_capital", 6: "plural_question_single_answer", 7: "multi_or_missing_answer", 8: "language_or_pii", 9: "article_like_or_non_atomic_answer", 10: "no_answer_text", 11: "time_sensitive_or_cause_of_death", 12: "empty_or_long", 13: None, 14: "manual_fact_review"}
    how = {r.uid: (r.answer, r.how) for r in imports.canonical(df.where("uid IN (1, 2, 4)")).collect()}
    assert how == {1: ("Анна", "case"), 2: ("Анна", "as_is"), 4: ("Рим", "as_is")}
    assert {r.field: r.n for r in imports.missing_fields(df.withColumn("none", F.lit(None)), ("uid", "none")).collect()} == {"none": 14}


def test_small_repairs(spark):
    df = spark.createDataFrame([("кто это", "на на каникулах")], "q string, t string")
    r = df.select(imports.whole_question(F.col("q")).alias("q"), imports.plain_preposition(F.col("t")).alias("t"), imports.tied(F.col("t"), F.lit("петь"), F.lit("Пой.")).alias("x")).first()
    assert tuple(r) == ("Кто это?", "на каникулах", "на на каникулах Пой.")
