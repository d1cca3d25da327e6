"""Streams: cleaning of arriving files, first-wins deduplication with bounded state, watching a training log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import judge

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, at timestamp"
LOG = "run long, step long, loss double"


def documents(spark: SparkSession, folder: str, schema: str = DOCUMENT, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def cleaned(docs: DataFrame, lateness: str | None = "1 day") -> DataFrame:
    """Documents that pass all rules, each normalised text once.

    With `lateness`, copies are told only as long after a text's time `at`, which bounds the state; without, for good.
    """
    passed = judge(docs).where("reason IS NULL").withColumn("sha", F.sha2("clean", 256))
    if lateness is None:
        return passed.dropDuplicates(["sha"])
    return passed.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["sha"])


def reason_counts(docs: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Rejections by rule in windows of time."""
    return judge(docs).withWatermark("at", lateness).groupBy(F.window("at", window).alias("w"), F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def watch(log: DataFrame) -> DataFrame:
    """Per run, after each batch: last step, best loss and length of the present streak of strict rises."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        last, loss, best, streak = state.get if state.exists else (-1, float("nan"), float("inf"), 0)
        rows = pd.concat(list(batches)).sort_values("step")
        for r in rows.itertuples():
            if r.step <= last or r.loss is None or r.loss != r.loss:
                continue  # a step that was seen before, or without a loss
            streak = streak + 1 if r.loss > loss else 0
            last, loss, best = int(r.step), float(r.loss), min(best, float(r.loss))
        state.update((last, loss, best, streak))
        yield pd.DataFrame([(key[0], last, best, streak)], columns=["run", "step", "best", "streak"])

    return log.groupBy("run").applyInPandasWithState(step, "run long, step long, best double, streak int", "last long, loss double, best double, streak int", "update", GroupStateTimeout.NoTimeout)


def write(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what there is as Parquet, then stop; both folders must be shared ones on a cluster."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
