"""Analytics over training logs and score vectors."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))


def best_so_far(log: DataFrame) -> DataFrame:
    return log.select("run", "step", F.min("loss").over(Window.partitionBy("run").orderBy("step")).alias("best"))


def rise_streak(log: DataFrame) -> DataFrame:
    """Length of the run of strict rises that ends at each step (gaps and islands)."""
    w = Window.partitionBy("run").orderBy("step")
    up = log.withColumn("up", F.coalesce((F.col("loss") > F.lag("loss").over(w)).cast("int"), F.lit(0)))
    islands = up.withColumn("island", F.sum(1 - F.col("up")).over(w))
    return islands.select("run", "step", F.sum("up").over(Window.partitionBy("run", "island").orderBy("step")).alias("streak"))


def replay(log: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last record of each key wins."""
    return log.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def lr_scale(steps: DataFrame, warmup: int, total: int, least: float) -> DataFrame:
    """Linear warm-up, then cosine decay to `least`."""
    s = F.col("step")
    done = F.least((s - warmup) / F.lit(float(total - warmup)), F.lit(1.0))
    return steps.withColumn("scale", F.when(s < warmup, (s + 1) / F.lit(float(warmup))).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(pi) * done))))


def scores_of(vectors: DataFrame) -> DataFrame:
    rows = vectors.select("vec_id", F.posexplode("embedding").alias("token", "score"))
    return rows.select("vec_id", F.col("token").cast("long").alias("token"), F.col("score").cast("double").alias("score"))


def running(log: DataFrame) -> DataFrame:
    """Tokens trained so far and tokens a second of (run, step, tokens, seconds)."""
    so_far = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("run", "step", F.sum("tokens").over(so_far).alias("tokens_trained"), F.try_divide(F.col("tokens").cast("double"), F.col("seconds")).alias("tokens_per_second"))


def resume(lines: DataFrame, start: int) -> DataFrame:
    """Validation history of a log (line, value as JSON text) at a restart: the last readable record of each step up to `start`.

    Records that aren't JSON, or lack a step or a loss, are passed over.
    """
    v = F.try_parse_json("value")
    read = lines.select("line", F.try_variant_get(v, "$.step", "bigint").alias("step"), F.try_variant_get(v, "$.validation_loss", "double").alias("loss"))
    usable = read.where(F.col("step").isNotNull() & F.col("loss").isNotNull() & (F.col("step") <= start))
    return usable.groupBy("step").agg(F.max_by("loss", "line").alias("loss"))


def stop_step(log: DataFrame, patience: int) -> DataFrame:
    """The first step of each run at which the loss has risen `patience` times in a row; null where it never does."""
    return rise_streak(log).groupBy("run").agg(F.min(F.when(F.col("streak") >= patience, F.col("step"))).alias("stop"))


def weighted_loss(batches: DataFrame) -> DataFrame:
    """Loss weighted by tokens of (run, loss, tokens), and its perplexity, the loss counting 20 at most.  Runs with a loss that isn't finite are an error."""
    checked = F.when(F.isnan("loss") | (F.abs("loss") == float("inf")), F.raise_error(F.lit("a loss isn't finite"))).otherwise(F.col("loss"))
    mean = (F.sum(checked * F.col("tokens")) / F.sum("tokens")).alias("loss")
    return batches.groupBy("run").agg(mean).withColumn("perplexity", F.exp(F.least("loss", F.lit(20.0))))


def parameters(vocabulary: int, hidden: int, inner: int, layers: int) -> int:
    """Parameters of a decoder with tied embeddings: V H + L (4 H^2 + 3 H I + 2 H) + H."""
    return vocabulary * hidden + layers * (4 * hidden * hidden + 3 * hidden * inner + 2 * hidden) + hidden


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with `turn`, their order by a seeded hash of the key: a shuffle that is the same on any cluster."""
    from ..functions.text import split_hash

    return rows.withColumn("turn", split_hash(F.col(key).cast("string"), seed))
