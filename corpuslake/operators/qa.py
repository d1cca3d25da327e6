"""Audit of question-answer items: kinds of answer, flags, duplicates, conflicts, near pairs, samples.

Items are rows (file, uid, question, answer, props array, uris array, answers array of (label, aliases)).
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..functions.unicode import folded, nfc
from ..session import ship, stash

#: Properties that tell the kind of an answer, in order; functional properties; words of non-answers.
KINDS = (
    ("date_or_year", ("wdt:P569", "wdt:P570", "wdt:P571", "wdt:P577", "wdt:P585"), r"(?iu)\b\d{3,4}\s*(?:г\.?|год|до н\.?\s*э\.?)"),
    ("place_or_country", ("wdt:P36", "wdt:P17", "wdt:P19", "wdt:P20", "wdt:P276", "wdt:P131"), None),
    ("person_or_creator", ("wdt:P50", "wdt:P57", "wdt:P86", "wdt:P170", "wdt:P112", "wdt:P61"), None),
    ("number", (), r"^\s*[+−-]?\d+(?:[.,]\d+)?\s*$"),
    ("concept_or_type", ("wdt:P106", "wdt:P31", "wdt:P279", "wdt:P136", "wdt:P361", "wdt:P527"), None),
)
FUNCTIONAL = ("wdt:P17", "wdt:P36", "wdt:P569", "wdt:P570", "wdt:P19", "wdt:P20")
NON_ANSWERS = ("неизвестно", "нет данных", "не найдено", "не указано", "ошибка")
QUALIFIED = r"(?U)\b(?:регион|провинц|координат|действующий|являющ(?:ийся|аяся))\b"
#: Grams of more items than this give no candidates; least similarity of a near pair.
MOST_ITEMS, SIMILAR = 80, 0.92


def norm(text: Column) -> Column:
    """Words of the folded text, joined by blanks; null counts as empty."""
    return F.array_join(T.tokens(folded(F.coalesce(text, F.lit("")))), " ")


def answer_kind(props: Column, answer: Column) -> Column:
    """The first kind one of whose properties the item has, or whose pattern the answer fits."""
    held, said = F.coalesce(props, F.array().cast("array<string>")), F.coalesce(answer, F.lit(""))
    out = F.lit("other")
    for name, own, pattern in reversed(KINDS):
        fits = F.arrays_overlap(held, F.array(*map(F.lit, own))) if own else F.lit(False)
        out = F.when(F.coalesce(fits, F.lit(False)) | (said.rlike(pattern) if pattern else F.lit(False)), name).otherwise(out)
    return out


def normed(items: DataFrame) -> DataFrame:
    first = F.coalesce(F.try_element_at("props", F.lit(1)), F.lit("no_property"))
    return items.withColumn("qn", norm(F.col("question"))).withColumn("an", norm(F.col("answer"))).withColumn("prop", first).withColumn("kind", answer_kind(F.col("props"), F.col("answer")))


def flags(items: DataFrame) -> DataFrame:
    """How many items each flag of suspicion fits; an item may have several."""
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    both, an = F.concat(q, F.lit(" "), a), norm(F.col("answer"))
    rules = {
        "empty_question": F.trim(q) == "",
        "empty_answer": F.trim(a) == "",
        "hidden_or_control_character": both.rlike(r"[\p{Cf}\p{Cs}]|[\p{Cc}&&[^\t\r\n]]"),
        "damaged_or_non_nfc_unicode": both.contains("�") | both.contains("\u0000") | (nfc(both) != both),
        "question_over_300_chars": F.length(q) > 300,
        "answer_over_100_chars": F.length(a) > 100,
        "non_answer_or_uncertain_text": an.rlike("|".join(NON_ANSWERS)),
        "article_like_or_qualified_answer": an.rlike(QUALIFIED),
        "compound_or_editorial_answer": (an != "") & a.rlike("[,;()]"),
    }
    named = items.select(F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))).alias("flag"))
    return named.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def alias_match(items: DataFrame) -> DataFrame:
    """How many answers are a label or alias of the only answer entity, aren't, or can't be compared."""
    names = F.transform(F.flatten(F.transform("answers", lambda x: F.concat(F.array(x["label"]), F.coalesce(x["aliases"], F.array().cast("array<string>"))))), lambda n: F.lower(F.trim(n)))
    exact = (F.trim(F.coalesce("answer", F.lit(""))) != "") & F.array_contains(names, F.lower(F.trim(F.coalesce("answer", F.lit("")))))
    verdict = F.when(F.size("answers") != 1, "multi_or_zero_answer_not_compared").when(exact, "exact_alias").otherwise("alias_not_exactly_equal")
    return items.groupBy(verdict.alias("match")).agg(F.count(F.lit(1)).alias("n"))


def question_groups(items: DataFrame) -> DataFrame:
    """Questions that occur several times, with their number, and their sorted different answers joined by |."""
    return normed(items).where("qn != ''").groupBy("qn").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("an")).alias("answers")).where("n > 1").select("qn", "n", F.array_join("answers", "|").alias("answers"), (F.size("answers") > 1).alias("conflict"))


def fact_conflicts(items: DataFrame) -> DataFrame:
    """Facts (first address and property) of several different answers; up to ten of them, and whether the property is functional."""
    facts = normed(items).where((F.size("uris") > 0) & (F.col("prop") != "no_property") & (F.col("an") != "")).select(F.concat_ws("|", F.col("uris")[0], "prop").alias("fact"), "prop", "an")
    several = facts.groupBy("fact", "prop").agg(F.count(F.lit(1)).alias("occurrences"), F.sort_array(F.collect_set("an")).alias("a")).where(F.size("a") > 1)
    return several.select("fact", F.size("a").alias("n_answers"), F.array_join(F.slice("a", 1, 10), "|").alias("answers"), "occurrences", F.col("prop").isin(*FUNCTIONAL).alias("functional"))


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two strings by their matching blocks, no character being junk."""
    from pyspark.sql import SparkSession

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    ship(SparkSession.active())
    return F.pandas_udf(run, DoubleType())(a, b)


def near_questions(items: DataFrame) -> DataFrame:
    """Pairs of different questions with a similarity of 0.92 or more: uid_a, uid_b, similarity to four places, most alike first.

    Candidates share a run of three characters that at most 80 items have, and their lengths are close.
    """
    held = stash(normed(items).where("qn != ''").select(F.concat_ws("\u0000", "file", F.col("uid").cast("string")).alias("id"), "uid", "qn"), "questions")
    grams = held.select("id", "uid", "qn", F.explode(T.trigrams(F.col("qn"))).alias("g"))
    rare = grams.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(f"m BETWEEN 2 AND {MOST_ITEMS}").select("g")
    own = grams.join(rare, "g")
    other = own.select("g", F.col("id").alias("id_b"), F.col("uid").alias("uid_b"), F.col("qn").alias("qb"))
    la, lb = F.length("qn"), F.length("qb")
    close = F.abs(la - lb) <= F.greatest(F.lit(8), F.floor(F.greatest(la, lb) * 0.12))
    both = own.join(other, "g").where((F.col("id") < F.col("id_b")) & close & (F.col("qn") != F.col("qb"))).select("id", "id_b", F.col("uid").alias("uid_a"), "uid_b", "qn", "qb").distinct()
    return both.withColumn("s", ratio(F.col("qn"), F.col("qb"))).where(F.col("s") >= SIMILAR).select("uid_a", "uid_b", F.round("s", 4).alias("similarity")).orderBy(F.desc("similarity"), "uid_a", "uid_b")


def first_questions(items: DataFrame, order: str = "uid") -> DataFrame:
    """(order, verdict) of every item: kept if its question comes first, duplicate if the first one has the same answer, else conflict."""
    held = normed(items).select(order, "qn", "an")
    first = held.groupBy("qn").agg(F.min(F.struct(order, "an")).alias("f"))
    verdict = F.when(F.col(order) == F.col("f")[order], "kept").when(F.col("an") == F.col("f.an"), "duplicate").otherwise("conflict")
    return held.join(first, "qn").select(order, verdict.alias("verdict"))


def without_listed(items: DataFrame, excluded: DataFrame) -> DataFrame:
    """Items that a list of (file, uid) doesn't name."""
    return items.join(excluded.select("file", "uid").distinct(), ["file", "uid"], "left_anti")


def reviewed(sample: DataFrame, log: DataFrame) -> DataFrame:
    """(file, uid, status) of a sample, by the last line (file, uid, line, status) of a review log; pending without one."""
    last = log.groupBy("file", "uid").agg(F.max_by("status", "line").alias("status"))
    return sample.select("file", "uid").join(last, ["file", "uid"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def review_summary(statuses: DataFrame) -> DataFrame:
    """One row: reviewed, pending and rejected items, and PASS, partial or pending for all."""
    n = lambda c: F.count_if(c)
    s = F.col("status")
    counted = statuses.agg(n(s != "pending").alias("reviewed"), n(s == "pending").alias("pending"), n(s == "rejected").alias("rejected"))
    return counted.withColumn("verdict", F.when(F.col("reviewed") == 0, "pending").when((F.col("pending") > 0) | (F.col("rejected") > 0), "partial").otherwise("PASS"))


def stratified(items: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """A sample of (file, uid): equal quotas of the files, the first ones one more, their strata (property, kind) in turn.

    In a stratum items follow a seeded hash.  Files short of their quota are made up for by what is left, round by round.
    """
    year = F.when(F.coalesce("answer", F.lit("")).rlike(r"\b\d{3,4}\b"), "date_or_year").otherwise(F.col("kind"))
    h = T.split_hash(F.concat_ws("|", "file", F.col("uid").cast("string")), seed)
    keyed = normed(items).select("file", "uid", F.concat_ws("|", "file", "prop", year).alias("key"), h.alias("h"))
    turn = keyed.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("h", "uid")))
    placed = stash(turn.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("turn", "key"))), "placed")
    files = placed.select("file").distinct().withColumn("i", F.row_number().over(Window.orderBy("file")) - 1)  # a row per file
    n = files.count()
    quota = files.select("file", (F.lit(size // max(1, n)) + (F.col("i") < size % max(1, n)).cast("int")).alias("quota"))
    own = placed.join(F.broadcast(quota), "file").withColumn("own", F.col("place") <= F.col("quota"))
    short = size - own.where("own").count()
    more = own.where("NOT own").orderBy("turn", "key").limit(max(0, short)).select("file", "uid") if short > 0 else own.limit(0).select("file", "uid")
    return own.where("own").select("file", "uid").unionByName(more)


def traces(source: Column, answer: Column) -> Column:
    """Whether every telling word of the source answer is in the answer, or shares its first five letters with a word of it.

    Telling are words of four letters or more; all words where there are none.
    """
    own, said = T.tokens(source), T.tokens(answer)
    long = F.filter(own, lambda w: F.length(w) >= 4)
    asked = F.when(F.size(long) > 0, long).otherwise(own)
    five = lambda w: F.substr(w, F.lit(1), F.lit(5))
    found = lambda w: F.exists(said, lambda r: (w == r) | ((F.least(F.length(w), F.length(r)) >= 5) & (five(w) == five(r))))
    return (F.size(asked) > 0) & F.forall(asked, found)
