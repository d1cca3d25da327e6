"""Stages of the pipeline send text to Python workers in small batches, whatever the documents' lengths."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslake.session import BATCH_BYTES


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])


def largest(docs):
    return docs.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]


def test_stages_bound_batches(spark):
    text = F.repeat(F.lit("a word "), 2000)
    docs = spark.range(2000).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("x").alias("lang"), F.lit("y").alias("source"), F.lit(14000).cast("long").alias("n_chars"))
    spark.conf.unset(BATCH_BYTES[0])
    try:
        corpus_pipeline.decontamination(spark, docs, "/root/testdata/sf0.001")
        assert largest(docs) < 5 << 20
        spark.conf.set(BATCH_BYTES[0], "8m")  # a session's own bound stays
        corpus_pipeline.decontamination(spark, docs, "/root/testdata/sf0.001")
        assert largest(docs) > 5 << 20
    finally:
        spark.conf.unset(BATCH_BYTES[0])
