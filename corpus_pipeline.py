"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as
the next stage's docs.  Stages keep the columns of documents until the last one.  Those that
use Python workers bound the Arrow batches of the session: executors keep what large ones have taken through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import bound_batches, stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with a lower quality score are rejected.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Compression classifier: documents that it rejects go; learned from all labels of documents it is given."""
    from corpuslake.llm.compression import QUALITY, keep, train

    bound_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return keep(docs.select(*COLUMNS), train(docs, labels, QUALITY), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join at 0.75 on five words: the document of least id in each component stays."""
    from corpuslake.llm.jaccard import near_duplicates as keep

    bound_batches(spark)
    return keep(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item occur go."""
    from corpuslake.llm.decontamination import decontaminate

    bound_batches(spark)
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), size=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text."""
    from corpuslake.llm.pii import redact

    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as tokens in sequences of at most 1024; `ids` holds the tokens of each piece, 16 bits each."""
    from corpuslake.llm.packing import pack
    from corpuslake.llm.tokens import tokenizer_path

    bound_batches(spark)
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2, keep_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: Trained scores and token ids can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stash(docs, f"stage{n}")
    return docs
