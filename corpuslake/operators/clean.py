"""Cleaning, exact deduplication, splitting and prefix sums over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.unicode import normalize_text


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a struct column that is computed once for each row, however often its fields are used.

    Filters and projections are merged with what is below them and would repeat it; a generator stops that.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def judge(docs: DataFrame, normalize: bool = True, **limits) -> DataFrame:
    """Add `clean` (normalised text), n_words, language and reason (null: kept); all other columns stay."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text = normalize_text(F.col("text")) if normalize else F.col("text")
    held = docs.select(*columns, text.alias("__text"))
    seen = once(held, F.struct(F.regexp_count("__text", F.lit(T.WORD)).alias("n"), T.language(F.col("__text")).alias("l")), "__seen")
    done = once(seen, F.struct(T.reason(F.col("__text"), F.col("__seen.n"), F.col("__seen.l"), **limits).alias("r")), "__why")
    return done.select(*columns, F.col("__text").alias("clean"), F.col("__seen.n").alias("n_words"), F.col("__seen.l").alias("language"), F.col("__why.r").alias("reason"))


def first_of(df: DataFrame, key: Column, order: str, *carry: str) -> DataFrame:
    """The first row of each key in the given order, with the columns `carry`; partial aggregation, so a hot key is no hot task."""
    firsts = df.groupBy(key.alias("__key")).agg(F.min(F.struct(order, *carry)).alias("__first"))
    return firsts.select("__first.*")


def kept(docs: DataFrame, **limits) -> DataFrame:
    """The first document of each normalised text that passes all rules: doc_id, language, n_words, bytes."""
    passed = judge(docs, **limits).where("reason IS NULL").select("doc_id", "language", "n_words", F.octet_length("clean").alias("bytes"), F.sha2("clean", 256).alias("sha"))
    return first_of(passed, F.col("sha"), "doc_id", "language", "n_words", "bytes")


def prefix_sum(df: DataFrame, order: str, value: str, into: str, parts: int | None = None) -> DataFrame:
    """Sum of `value` over all rows before, in two levels: range partitions, then the few totals of them."""
    from ..session import stash

    ranged = df.repartitionByRange(parts, order) if parts else df.repartitionByRange(order)
    #: Ranges are drawn from a sample, so they are fixed once before both levels use them.
    ranged = stash(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__n"))
    #: A row per partition.
    before = totals.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ranged.withColumn("__in", inside).join(F.broadcast(before), "__part").withColumn(into, F.col("__in") + F.col("__before")).drop("__in", "__before", "__part")


def validation_count(n: int, fraction: float) -> int:
    """round-half-even(n f) within 1 and n - 1; none of a single record."""
    return min(max(1, round(n * fraction)), n - 1) if n > 1 and fraction > 0 else 0


def smallest(hashes: DataFrame, k: int, digits: int = 4) -> str:
    """The k-th smallest of distinct hex hashes (column h).  Counts by prefix find the few hashes that it is among."""
    counts = hashes.groupBy(F.substr("h", F.lit(1), F.lit(digits)).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # 16**digits rows at most
    for r in counts:
        if k <= r["n"]:
            return hashes.where(F.col("h").startswith(r["p"])).orderBy("h").limit(k).agg(F.max("h")).first()[0]
        k -= r["n"]
    return ""


def hash_split(docs: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Split by the k smallest distinct hashes; equal texts stay together.  Null texts have no hash and train."""
    hashed = docs.withColumn("h", T.split_hash(F.col("text"), seed))
    distinct = hashed.where("h IS NOT NULL").select("h").distinct()
    k = validation_count(distinct.count(), fraction)
    last = smallest(distinct, k) if k else ""
    return hashed.withColumn("split", F.when(F.col("h") <= F.lit(last), "validation").otherwise("train"))


def single_record_split(text: Column, fraction: float) -> Column:
    """One record split by words: the last ones, as many as validation_count gives, are validation; of fewer than two words none."""
    ws = F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    n = F.size(ws)
    k = F.least(F.greatest(F.lit(1), F.bround(n * F.lit(fraction)).cast("int")), n - 1)
    head, tail = F.array_join(F.slice(ws, F.lit(1), n - k), " "), F.array_join(F.slice(ws, n - k + 1, k), " ")
    return F.when(n < 2, F.struct(text.alias("train"), F.lit(None).cast("string").alias("validation"))).otherwise(F.struct(head.alias("train"), tail.alias("validation")))


def every_nth(docs: DataFrame, order: str, fraction: float) -> DataFrame:
    """Every round(1 / fraction)-th row in order, from the first."""
    step = max(1, round(1 / fraction))
    placed = prefix_sum(docs.withColumn("__one", F.lit(1).cast("long")), order, "__one", "__at")
    return placed.where(F.col("__at") % step == 0).drop("__one", "__at")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Documents, bytes and words kept by language, with their share of all words in percent, to four places."""
    by = kept(docs).groupBy("language").agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes"), F.sum("n_words").alias("words"))
    every = F.greatest(F.lit(1), F.sum("words").over(Window.partitionBy(F.lit(0))))  # a row per language
    return by.withColumn("word_share", F.round(F.col("words") * 100.0 / every, 4))


def removals(docs: DataFrame) -> DataFrame:
    """How many documents each rule removes, exact copies of kept ones included."""
    why = F.coalesce("reason", F.lit("exact_duplicates_removed")).alias("reason")
    judged = judge(docs).select("reason", F.when(F.col("reason").isNull(), F.sha2("clean", 256)).alias("sha"))
    #: Rows with a reason are counted together, kept ones by text; a text that isn't there gives the row of copies if nothing is kept.
    groups = judged.groupBy("reason", "sha").agg(F.count(F.lit(1)).alias("m"))
    none = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("sha"), F.lit(1).cast("long").alias("m"))
    counted = groups.unionByName(none).select(why, (F.col("m") - F.col("reason").isNull().cast("long")).alias("n"))
    return counted.groupBy("reason").agg(F.sum("n").alias("n"))
