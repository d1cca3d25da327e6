"""What the suffix tree sends for rarer words follows the words, not documents times buckets."""

from pyspark.sql import functions as F

from corpuslake.llm import suffix_tree


def test_rare_words_travel_in_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HEAD", 0)  # every word is rare
    n = 3000
    docs = spark.createDataFrame([(i, f"w{i % 1500} v{i % 700}") for i in range(n)], "doc_id long, text string").coalesce(1)
    buckets, words, _, head, scanned, *_ = suffix_tree._learn(docs, F.lit(True))
    rare = suffix_tree._rare(scanned, head, buckets)
    sent, back = (x.where("not own").agg(F.sum(F.length("data"))).first()[0] for x in (rare, suffix_tree._look_up(rare, words, buckets)))
    tokens = 3 * n  # two words and the end
    assert sent < 10 * tokens
    assert scanned.where("kind = 'word'").isEmpty()  # nor are they stored
    assert back < 8 * tokens
