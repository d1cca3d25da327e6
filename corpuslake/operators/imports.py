"""Import of older conversations and of question-answer items: gates in order, canonical answers, small repairs of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.unicode import dedup_key, nfc
from .conversations import clean_style
from .qa import first_questions, ratio

#: Fixed values of the gates.
SYNTHETIC = ("synthetic_curated", "synthetic_computed")
BANNED_GENERATORS = {"curated_ru_smalltalk_v4": "low_diversity_smalltalk_v4", "short_context_planning_v5": "awkward_english_multi_turn_planning_v5"}
BANNED_PROPERTIES = ("P54", "P118", "P2437", "P1113", "P509", "P1196")
NO_ANSWER = ("неизвестно", "нет данных", "не найдено")
REPEATED = (
    ("на на каникулах", "на каникулах"),
    ("в в выходной", "в выходной"),
    ("в в субботу", "в субботу"),
    ("после после занятий", "после занятий"),
    ("после после работы", "после работы"),
)
LONGEST_ANSWER = 1600
SIMILAR = 0.90
#: Question-answer files as they are published.
ITEM = "uid long, question_text string, answer_text string, answers array<struct<label:string,wd_names:struct<ru:array<string>>>>, question_props array<string>, question_uris array<string>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON array files: file, uid, question, answer, props, uris, answers of (label, aliases)."""
    raw = spark.read.schema(ITEM).option("multiLine", "true").json(path)
    names = F.transform("answers", lambda a: F.struct(a["label"].alias("label"), a["wd_names"]["ru"].alias("aliases")))
    return raw.select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), "uid", F.col("question_text").alias("question"), F.col("answer_text").alias("answer"), F.col("question_props").alias("props"), F.col("question_uris").alias("uris"), names.alias("answers"))


def missing_fields(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """How many rows lack each required field."""
    named = rows.select(F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))).alias("field"))
    return named.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def legacy_reason(category: Column, kind: Column, generator: Column, messages: Column, answers: Column) -> Column:
    """The first gate that rejects an older row; `answers` are its assistant texts after style repair."""
    bare = F.forall(answers, lambda a: a.rlike(r"^\s*[-+]?\d+(?:[.,]\d+)?\s*$"))
    banned = reduce(lambda c, x: c.when(generator == x[0], x[1]), BANNED_GENERATORS.items(), F.when(F.coalesce(~kind.isin(*SYNTHETIC), F.lit(True)), "non_synthetic"))
    return (
        banned.when(messages.isNull(), "bad_schema")
        .when((F.size(answers) == 0) | F.exists(answers, lambda a: F.length(a) > LONGEST_ANSWER), "empty_or_long_answer")
        .when((category == "math") & bare, "bare_numeric_not_assistant_style")
        .when(category == "conversation", "conversation_examples_excluded")
    )


def legacy(rows: DataFrame) -> DataFrame:
    """Rows (id, category, kind, generator, messages array of (role, content)) with `reason` (null: imported)."""
    said = rows.select("id", F.posexplode_outer("messages").alias("at", "m")).where("m.role = 'assistant'").select("id", "at", clean_style(F.col("m.content")).alias("a"))
    answers = said.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "a"))).alias("s")).select("id", F.col("s.a").alias("answers"))
    held = rows.join(answers, "id", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<string>")))
    return held.withColumn("reason", legacy_reason(F.col("category"), F.col("kind"), F.col("generator"), F.col("messages"), F.col("answers"))).drop("answers")


def item_reason(capitals: tuple[str, ...]) -> Column:
    """The first gate that rejects a question-answer item by itself; `capitals` are the present ones, lower-cased."""
    q, a = F.trim(F.coalesce("question", F.lit(""))), F.btrim(F.coalesce("answer", F.lit("")), F.lit("'\"«» "))
    props = F.coalesce("props", F.array().cast("array<string>"))
    ids = F.transform(props, lambda p: F.substring_index(p, ":", -1))
    low = F.lower(a)
    return (
        F.when(F.coalesce(F.size("answers"), F.lit(-1)) != 1, "multi_or_missing_answer")
        .when(F.arrays_overlap(ids, F.array(*map(F.lit, BANNED_PROPERTIES))), "time_sensitive_or_cause_of_death")
        .when(F.array_contains(props, "wdt:P2067") & q.rlike(r"(?iuU)\b(сколько весит|весит|масса)\b"), "ambiguous_person_measurement")
        .when(q.rlike(r"(?iuU)^\s*(?:какие\b|перечислите\b|назовите\b)"), "plural_question_single_answer")
        .when(F.array_contains(props, "wdt:P36") & ~F.btrim(low, F.lit(" .")).isin(*capitals), "unverified_or_outdated_capital")
        .when((q == "") | (a == "") | (F.length(a) > 100) | (F.length(q) > 300), "empty_or_long")
        .when(F.concat(q, a).rlike(r"[\p{Cf}\p{Cs}]|[\p{Cc}&&[^\t\r\n]]"), "hidden_or_control_character")
        .when((low == "дениел редклиф") | a.rlike("[,;()]") | a.rlike(r"(?iuU)\b(регион|провинц|действующий|координат)\b"), "article_like_or_non_atomic_answer")
        .when(~q.rlike("[А-Яа-яЁё]") | T.contact_or_secret(F.concat(q, F.lit(" "), a)), "language_or_pii")
        .when(low.rlike("|".join(NO_ANSWER)), "no_answer_text")
    )


def items(rows: DataFrame, excluded: DataFrame, capitals: tuple[str, ...]) -> DataFrame:
    """(file, uid, reason): exclusions (file, uid) first, then the gates, then first-wins questions by (file, uid); null: imported."""
    listed = excluded.select("file", "uid").distinct().withColumn("listed", F.lit(True))
    judged = rows.join(listed, ["file", "uid"], "left").withColumn("reason", F.when(F.col("listed"), "manual_fact_review").otherwise(item_reason(capitals)))
    fine = judged.where("reason IS NULL").withColumn("place", F.concat_ws("\u0000", "file", F.lpad(F.col("uid").cast("string"), 20, "0")))
    first = first_questions(fine, "place").select("place", F.when(F.col("verdict") == "duplicate", "exact_duplicate_question").when(F.col("verdict") == "conflict", "exact_question_answer_conflict").alias("again"))
    late = fine.join(first, "place").select("file", "uid", F.col("again").alias("reason"))
    return judged.where("reason IS NOT NULL").select("file", "uid", "reason").unionByName(late)


def canonical(rows: DataFrame) -> DataFrame:
    """(file, uid, answer, how): an alias equal to the answer but for its case; else, where no alias holds the answer
    or is held by it, the most alike alias from 0.90 on; else the answer as it is."""
    every = F.concat(F.array(F.col("answers")[0]["label"]), F.coalesce(F.col("answers")[0]["aliases"], F.array().cast("array<string>")))
    own = rows.select("file", "uid", "answer", dedup_key(F.col("answer")).alias("k"), F.posexplode_outer(every).alias("at", "alias")).withColumn("ak", dedup_key(F.coalesce("alias", F.lit(""))))
    scored = own.where("ak <> ''").withColumn("s", ratio(F.col("k"), F.col("ak"))).withColumn("near", F.col("k").contains(F.col("ak")) | F.col("ak").contains(F.col("k")))
    best = scored.groupBy("file", "uid").agg(F.min(F.when(F.col("ak") == F.col("k"), F.struct("at", "alias"))).alias("same"), F.bool_or("near").alias("held"), F.max(F.struct("s", "alias")).alias("top"))
    joined = rows.select("file", "uid", "answer").join(best, ["file", "uid"], "left")
    exact = F.col("same").isNotNull() & (F.col("same.alias") != F.col("answer"))
    typo = F.col("same").isNull() & ~F.coalesce("held", F.lit(True)) & (F.col("top.s") >= SIMILAR)
    return joined.select("file", "uid", F.when(exact, F.col("same.alias")).when(typo, F.col("top.alias")).otherwise(F.col("answer")).alias("answer"), F.when(exact, "case").when(typo, "typo").otherwise("as_is").alias("how"))


def whole_question(question: Column) -> Column:
    """A question with its first letter in upper case and a mark at its end, in normal form."""
    q = F.trim(question)
    raised = F.concat(F.upper(F.substr(q, F.lit(1), F.lit(1))), F.substr(q, F.lit(2)))
    return nfc(F.when(raised.rlike(r"[.?!]$") | (q == ""), raised).otherwise(F.concat(raised, F.lit("?"))))


def plain_preposition(text: Column) -> Column:
    """Text without doubled prepositions that templates leave."""
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), REPEATED, text)


def tied(text: Column, activity: Column, tail: Column) -> Column:
    """Text that names the activity; where it doesn't, `tail` is put after it."""
    return F.when(text.contains(activity), text).otherwise(F.concat(text, F.lit(" "), tail))
