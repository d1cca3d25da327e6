"""Choosing the next token from scores: penalties, temperature, top-k and nucleus cuts, draws.  Rows are (key, token, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def penalize(scores: DataFrame, used: DataFrame, penalty: float, key: str = "vec_id") -> DataFrame:
    """Scores of tokens in `used` (key, token) are divided by the penalty, or multiplied where negative; once for each token."""
    seen = used.select(key, "token").distinct().withColumn("__used", F.lit(True))
    s = F.col("score")
    return scores.join(seen, [key, "token"], "left").withColumn("score", F.when(F.col("__used"), F.when(s < 0, s * penalty).otherwise(s / penalty)).otherwise(s)).drop("__used")


def heat(scores: DataFrame, temperature: float, key: str = "vec_id") -> DataFrame:
    """Scores by temperature; at 0 or below only the best token (ties: the smallest) stays."""
    if temperature > 0:
        return scores.withColumn("score", F.col("score") / temperature)
    best = scores.groupBy(key).agg(F.max_by(F.struct("token", "score"), F.struct("score", -F.col("token"))).alias("b"))
    return best.select(key, "b.token", "b.score")


def top_k(scores: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """Scores at or above the k-th; ties stay."""
    return scores.withColumn("r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("score")))).where(F.col("r") <= k).drop("r")


def softmax(key: str = "vec_id") -> Column:
    every = Window.partitionBy(key)
    e = F.exp(F.col("score") - F.max("score").over(every))
    return e / F.sum(e).over(every)


def _with_probability(scores: DataFrame, key: str) -> DataFrame:
    every = Window.partitionBy(key)
    raised = scores.withColumn("__e", F.exp(F.col("score") - F.max("score").over(every)))
    return raised.withColumn("p", F.col("__e") / F.sum("__e").over(every)).drop("__e")


def nucleus(scores: DataFrame, p: float, key: str = "vec_id") -> DataFrame:
    """The most likely tokens up to the one with which their probabilities pass p; ties by token."""
    before = Window.partitionBy(key).orderBy(F.desc("score"), "token").rowsBetween(Window.unboundedPreceding, -1)
    reached = _with_probability(scores, key).withColumn("__before", F.coalesce(F.sum("p").over(before), F.lit(0.0)))
    return reached.where(F.col("__before") <= p).drop("__before", "p")


def draw(scores: DataFrame, uniform: Column, key: str = "vec_id") -> DataFrame:
    """One token of each key: the first whose cumulated probability, in order of token, passes the key's uniform number."""
    up_to = Window.partitionBy(key).orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    summed = _with_probability(scores, key).withColumn("__sum", F.sum("p").over(up_to)).withColumn("__u", uniform)
    hit = F.min(F.when(F.col("__sum") > F.col("__u"), F.col("token")))
    return summed.groupBy(key).agg(F.coalesce(hit, F.max("token")).alias("token"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of SHA-256 over seed and key."""
    digits = F.substr(F.sha2(F.concat(F.lit(f"{seed}\u0000"), key.cast("string")), 256), F.lit(1), F.lit(13))
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)
