"""Writers: corpus and split files, statistics, manifests, an append-only log.

Spark's commit protocol publishes whole outputs only; existing ones are refused unless overwriting is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, order: str | None = None, overwrite: bool = False) -> None:
    """JSON lines without null fields; files follow `order` where given."""
    out = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).drop(order) if order else rows
    out.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "true").json(path)


def write_report(report: DataFrame, path: str, overwrite: bool = False) -> None:
    """A report of one row as one JSON file."""
    report.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def file_facts(spark, path: str) -> DataFrame:
    """(name, bytes, sha256, examples) of the files of an output; examples counts lines."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return raw.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.regexp_count(F.col("content").cast("string"), F.lit("\n")).alias("examples"))


def upsert(manifest: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Manifest with the rows of `fresh` laid over it: its values win where they aren't null, rows of either side stay."""
    old, new = manifest.alias("o"), fresh.alias("n")
    columns = dict.fromkeys([*manifest.columns, *fresh.columns])
    pick = lambda c: [F.col(f"{side}.{c}") for side, df in (("n", fresh), ("o", manifest)) if c in df.columns]
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*[F.coalesce(*pick(c)).alias(c) for c in columns])


def append_log(records: DataFrame, path: str) -> None:
    """Append records to a log of JSON lines, which is a streaming source too."""
    records.write.mode("append").json(path)
