"""Literal cases of the cleaning rules."""

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import clean

PROSE = " ".join(f"the {a} {b}" for a in ("red", "green", "blue", "old", "new", "small") for b in ("house", "river", "garden", "window", "street", "bridge"))
PHONE, CREDENTIAL = "sensitive_phone_with_contact_context_removed", "sensitive_credential_pattern_removed"
CASES = [
    ("phone: +1 555 010-0199 x", PHONE),
    ("ТЕЛЕФОН 8 (495) 123-45-67", PHONE),
    ("Номер # 123456789012", PHONE),
    ("phone 12345", None),
    ("order 1 555 010-0199", None),
    ("password = hunter2hunter2", CREDENTIAL),
    ("API-Key: abcdefgh", CREDENTIAL),
    ("Пароль: абвгдежз", CREDENTIAL),
    ("СЕКРЕТНЫЙ  ключ=12345678", CREDENTIAL),
    ("client_secret:abcdefg", None),
    ("mypassword = hunter2hunter2", None),
    ("мойпароль: абвгдежз", None),
    ("password = abc, defghijk", None),
    ("a.b@example.org phone: +1 555 010-0199", "sensitive_email_removed"),
    ("phone: +1 555 010-0199 password = hunter2hunter2", PHONE),
]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(i, f"{PROSE} {t}") for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r.reason for r in clean.judge(df).select("doc_id", F.col("reason")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_sensitive_rules(judged, i):
    assert judged[i] == CASES[i][1]


def test_removals_judge_each_document_once(spark):
    """One pass for the rules and the copies; without any document there is a row for the copies."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([PROSE, PROSE, PROSE + "\n\n\n\nx ", PROSE + "\n\nx", "short", "short", None])], "doc_id long, text string")
    found = clean.removals(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {tuple(r) for r in found.collect()} == {("exact_duplicates_removed", 2), ("too_short_removed", 2), ("empty_removed", 1)}
    assert [tuple(r) for r in clean.removals(docs.where("doc_id < 0")).collect()] == [("exact_duplicates_removed", 0)]


def test_few_words_beyond_a_varied_or_poor_beginning(spark):
    """Where the beginning of a text has too few different words, the whole text decides."""
    varied = " ".join("abcdefghijklmnopqrstuvwxyz"[i] * 3 for i in range(26))
    texts = [(" ab" * 2000 + " " + varied, True), (" ab" * 500 + " " + varied, False), (varied + " ab" * 500, False), (varied + " ab" * 2000, True)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.reason for r in clean.judge(df).select("doc_id", "reason").collect()}
    assert [got[i] == "noise_low_lexical_diversity_removed" for i in range(4)] == [w for _, w in texts]
