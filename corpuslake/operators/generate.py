"""Generators of training conversations: ranges and small literal tables crossed, templates chosen by position.

Rows are (category, language, group_id, prompt, answer, generator, expected); `expected` is the value the
answer must state, as text, so that `checked` can work it out anew.  Templates are our own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_hash

COLUMNS = ("category", "language", "group_id", "prompt", "answer", "generator", "expected")
#: (name, prompt, expression over a and b)
PATTERNS = (
    ("add", "def add(a, b): return a + b", "a + b"),
    ("subtract", "def subtract(a, b): return a - b", "a - b"),
    ("multiply", "def multiply(a, b): return a * b", "a * b"),
    ("larger", "def larger(a, b): return max(a, b)", "greatest(a, b)"),
    ("smaller", "def smaller(a, b): return a if a < b else b", "least(a, b)"),
    ("square", "def square(a, b): return a * a", "a * a"),
    ("distance", "def distance(a, b): return abs(a - b)", "abs(a - b)"),
    ("remainder", "def remainder(a, b): return a % (b + 1)", "a % (b + 1)"),
    ("double", "def double(a, b): return 2 * a", "2 * a"),
    ("mean", "def mean(a, b): return (a + b) // 2", "(a + b) div 2"),
    ("ordered", "def ordered(a, b): return int(a <= b)", "cast(a <= b AS int)"),
    ("even", "def even(a, b): return int((a + b) % 2 == 0)", "cast((a + b) % 2 = 0 AS int)"),
)
CAPITALS = (("France", "Paris", "Europe"), ("Japan", "Tokyo", "Asia"), ("Kenya", "Nairobi", "Africa"), ("Peru", "Lima", "South America"), ("Canada", "Ottawa", "North America"))
PLANETS = ("Mercury", "Venus", "Earth", "Mars", "Jupiter", "Saturn", "Uranus", "Neptune")
CONCEPTS = (("photosynthesis", "plants turn light, water and carbon dioxide into sugar and oxygen"), ("gravity", "masses attract each other"), ("evaporation", "a liquid turns into vapour below its boiling point"))
STYLES = ("{c} means that {d}.", "In {c}, {d}.", "One speaks of {c} when {d}.", "{d}: that is {c}.", "Put shortly, {c} is when {d}.")
PERCENTS = (1, 2, 5, 10, 12, 15, 20, 25, 30, 40, 50, 60, 75)
SUBJECTS = (("I", "я", 1), ("she", "она", 3), ("they", "они", 6))
VERBS = (("read", "reads", "читаю", "читает", "читают"), ("buy", "buys", "покупаю", "покупает", "покупают"))
OBJECTS = (("a book", "книгу", ("read", "buy")), ("a letter", "письмо", ("read",)), ("bread", "хлеб", ("buy",)))
PLACES = (("at home", "дома"), ("in town", "в городе"))
ACTIVITIES = ("cook dinner", "learn the guitar", "walk in the park", "repair the bicycle")
TIMES = ("this evening", "tomorrow", "on Saturday")
ANTONYMS = (("hot", "cold"), ("early", "late"), ("open", "closed"), ("heavy", "light"))
CORRECTIONS = (("he go home", "he goes home"), ("she have a dog", "she has a dog"), ("we are here", "we are here"))


def _table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small literal table; crossed with others it is sent to where they are."""
    return F.broadcast(spark.createDataFrame(list(rows), schema).coalesce(1))


def _numbers(spark: SparkSession, name: str, first: int, last: int) -> DataFrame:
    return F.broadcast(spark.range(first, last + 1, 1, 1).withColumnRenamed("id", name))


def _cycle(templates, at: Column) -> Column:
    """The template at a position, starting anew after the last."""
    return F.element_at(F.array(*map(F.lit, templates)), (F.pmod(at, F.lit(len(templates))) + 1).cast("int"))


def _fill(template: Column, **values: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1].cast("string")), values.items(), template)


def _rows(df: DataFrame, category: str, generator: str, group: Column, prompt: Column, answer: Column, expected: Column, language: str = "en") -> DataFrame:
    return df.select(F.lit(category).alias("category"), F.lit(language).alias("language"), group.alias("group_id"), prompt.alias("prompt"), answer.alias("answer"), F.lit(generator).alias("generator"), expected.cast("string").alias("expected"))


def arithmetic(spark: SparkSession, most_a: int = 150, most_b: int = 90) -> DataFrame:
    """a op b for all a, b and the four operations, division only where it is exact."""
    cross = _numbers(spark, "a", 1, most_a).crossJoin(_numbers(spark, "b", 1, most_b)).withColumn("op", F.explode(F.array(*map(F.lit, "+−×÷")))).where("op <> '÷' OR a % b = 0")
    value = F.expr("CASE op WHEN '+' THEN a + b WHEN '−' THEN a - b WHEN '×' THEN a * b ELSE a div b END")
    said = F.concat("a", F.lit(" "), "op", F.lit(" "), "b")
    prompt = _fill(_cycle(("What is {x}?", "Work out {x}.", "{x} = ?"), F.col("a") + F.col("b")), x=said)
    return _rows(cross.withColumn("v", value), "math", "arithmetic", F.concat(F.lit("arithmetic-"), "a", F.lit("-"), "b"), prompt, _fill(_cycle(("It is {v}.", "{x} is {v}.", "The result is {v}."), F.col("a") * F.col("b")), x=said, v=F.col("v")), F.col("v"))


def facts(spark: SparkSession) -> DataFrame:
    """Capitals in several forms under one group for each country, continents, and planets with the next one out."""
    c = _table(spark, CAPITALS, "country string, capital string, continent string").withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(3))))
    prompt = _fill(_cycle(("What is the capital of {c}?", "Name the capital of {c}.", "{c}: which city is its capital?", "On which continent is {c}?"), F.col("form")), c=F.col("country"))
    answer = F.when(F.col("form") == 3, F.col("continent")).otherwise(F.col("capital"))
    cards = _rows(c, "general_knowledge", "capitals", F.concat(F.lit("country-"), "country"), prompt, F.concat(answer, F.lit(".")), answer)
    from pyspark.sql import Window

    p = _table(spark, enumerate(PLANETS), "i int, name string").withColumn("next", F.lead("name").over(Window.orderBy("i"))).where("next IS NOT NULL")  # eight rows
    return cards.unionByName(_rows(p, "general_knowledge", "planets", F.concat(F.lit("planet-"), "name"), F.concat(F.lit("Which planet comes after "), "name", F.lit("?")), F.concat("next", F.lit(".")), F.col("next")))


def explanations(spark: SparkSession, target: int = 60) -> DataFrame:
    """`target` rows that go round the concepts; each round takes the next prompt and style."""
    n = len(CONCEPTS)
    c = _table(spark, ((i, *x) for i, x in enumerate(CONCEPTS)), "k long, concept string, meaning string")
    rows = spark.range(target).withColumn("k", F.col("id") % n).withColumn("round", F.floor(F.col("id") / n)).join(c, "k")
    prompt = _fill(_cycle(("What is {c}?", "Explain {c}.", "Tell me about {c}."), F.col("round")), c=F.col("concept"))
    return _rows(rows, "explanations", "concepts", F.concat(F.lit("concept-"), "concept"), prompt, _fill(_cycle(STYLES, F.col("round")), c=F.col("concept"), d=F.col("meaning")), F.col("meaning"))


def areas(spark: SparkSession) -> DataFrame:
    """Rectangles with sides from 2 to 31, in six prompts by five answers."""
    s = _numbers(spark, "a", 2, 31).crossJoin(_numbers(spark, "b", 2, 31)).withColumn("v", F.expr("a * b")).withColumn("at", F.expr("(a - 2) * 30 + b - 2"))
    prompts = ("Find the area of a rectangle of {a} by {b}.", "A rectangle is {a} long and {b} wide. What is its area?", "Area of {a} × {b}?", "How large is a field of {a} by {b}?", "Sides {a} and {b}: area?", "What area has a {a} by {b} rectangle?")
    answers = ("{a} times {b} is {v}.", "The area is {v}.", "{v}, as {a} × {b} = {v}.", "Multiply {a} by {b}: {v}.", "It is {v} square units.")
    fill = {x: F.col(x) for x in ("a", "b", "v")}
    return _rows(s, "explanations", "rectangle_area", F.concat(F.lit("area-"), "a", F.lit("-"), "b"), _fill(_cycle(prompts, F.col("at")), **fill), _fill(_cycle(answers, F.floor(F.col("at") / 6)), **fill), F.col("v"))


def percents(spark: SparkSession) -> DataFrame:
    """Thirteen rates of 10, 20, ... 200; whole results as integers, others to two places."""
    p = _table(spark, ((x,) for x in PERCENTS), "p long").crossJoin(_numbers(spark, "t", 1, 20)).withColumn("w", F.expr("t * 10"))
    exact = F.col("w") * F.col("p")
    v = F.when(exact % 100 == 0, F.expr("cast(w * p div 100 AS string)")).otherwise(F.regexp_replace((exact / 100).cast("decimal(12,2)").cast("string"), r"0$", ""))
    return _rows(p.withColumn("v", v), "explanations", "percent", F.concat(F.lit("percent-"), "p", F.lit("-"), "w"), _fill(F.lit("What is {p}% of {w}?"), p=F.col("p"), w=F.col("w")), _fill(F.lit("{p}% of {w} is {v}."), p=F.col("p"), w=F.col("w"), v=F.col("v")), F.col("v"))


def programs(spark: SparkSession, most: int = 12) -> DataFrame:
    """Function patterns with inputs; the result comes from an expression of our own, code is never run."""
    value = reduce(lambda acc, x: acc.when(F.col("name") == x[0], F.expr(x[2]).cast("long")), PATTERNS[1:], F.when(F.col("name") == PATTERNS[0][0], F.expr(PATTERNS[0][2]).cast("long")))
    t = _table(spark, ((n, c) for n, c, _ in PATTERNS), "name string, code string").crossJoin(_numbers(spark, "a", 0, most)).crossJoin(_numbers(spark, "b", 0, most)).withColumn("v", value)
    call = F.concat("name", F.lit("("), "a", F.lit(", "), "b", F.lit(")"))
    return _rows(t, "programming", "function_patterns", F.concat(F.lit("function-"), "name"), F.concat(F.lit("What does "), call, F.lit(" return?\n"), "code"), F.concat(call, F.lit(" returns "), "v", F.lit(".")), F.col("v"))


def translations(spark: SparkSession) -> DataFrame:
    """Sentences in both directions, the verb agreeing with the subject, objects only with verbs that they go with."""
    s = _table(spark, SUBJECTS, "s string, rs string, person int")
    v = _table(spark, VERBS, "v string, vs string, r1 string, r3 string, r6 string")
    o = _table(spark, ((e, r, list(x)) for e, r, x in OBJECTS), "o string, ro string, fits array<string>")
    p = _table(spark, PLACES, "p string, rp string")
    all_ = s.crossJoin(v).crossJoin(o).where("array_contains(fits, v)").crossJoin(p)
    en = F.concat_ws(" ", "s", F.when(F.col("person") == 3, F.col("vs")).otherwise(F.col("v")), "o", "p")
    ru = F.concat_ws(" ", "rs", F.when(F.col("person") == 1, F.col("r1")).when(F.col("person") == 3, F.col("r3")).otherwise(F.col("r6")), "ro", "rp")
    group = F.concat(F.lit("translation-"), en)
    there = _rows(all_, "translation", "sentences", group, F.concat(F.lit("Translate into Russian: "), en), ru, ru)
    return there.unionByName(_rows(all_, "translation", "sentences", group, F.concat(F.lit("Переведи на английский: "), ru), en, en, "ru"))


def number_lists(spark: SparkSession, many: int = 200, size: int = 6, seed: int = 42) -> DataFrame:
    """Lists of different numbers to sort; numbers come from a seeded hash, equal lists stay once (the first of them)."""
    digit = lambda i: (F.conv(F.substr(split_hash(F.concat_ws("-", "id", i.cast("string")), seed), F.lit(1), F.lit(8)), 16, 10).cast("long") % 97) + 1
    lists = spark.range(many).withColumn("x", F.slice(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(2 * size)), digit)), 1, size))
    once = lists.groupBy("x").agg(F.min("id").alias("id"))
    said = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ", ")
    done = F.array_sort("x")
    return _rows(once, "instruction_following", "numeric_sort", F.concat(F.lit("sort-"), F.col("id").cast("string")), F.concat(F.lit("Sort in ascending order: "), said(F.col("x"))), said(done), said(done))


def selections(spark: SparkSession, many: int = 50, seed: int = 42) -> DataFrame:
    """Six words of a list in hash order, of which the first three are asked for."""
    words = F.array(*map(F.lit, ("apple", "bread", "chair", "door", "engine", "forest", "glass", "house", "island", "jacket")))
    order = F.transform(F.array_sort(F.transform(words, lambda w: F.struct(split_hash(F.concat_ws("-", "id", w), seed).alias("h"), w.alias("w")))), lambda x: x["w"])
    s = spark.range(many).withColumn("x", F.slice(order, 1, 6))
    said = F.array_join("x", ", ")
    first = F.array_join(F.slice("x", 1, 3), ", ")
    return _rows(s, "instruction_following", "selection", F.concat(F.lit("selection-"), F.col("id").cast("string")), F.concat(F.lit("Name the first three of: "), said), first, first)


def dialogues(spark: SparkSession) -> DataFrame:
    """Plans of an activity at a time, styles by position; small talk has no value to check."""
    a = _table(spark, enumerate(ACTIVITIES), "i long, activity string").crossJoin(_table(spark, enumerate(TIMES), "j long, time string")).crossJoin(_numbers(spark, "style", 0, 2))
    at = F.col("i") * 7 + F.col("j") * 3 + F.col("style")
    prompt = _fill(_cycle(("I want to {a} {t}.", "Can you help me {a} {t}?", "Shall I {a} {t}?", "I plan to {a} {t}."), at), a=F.col("activity"), t=F.col("time"))
    answer = _fill(_cycle(("Good idea. What do you need in order to {a}?", "Then keep some time free {t}.", "Yes, {t} suits it. Shall we make a list?"), at + F.col("i")), a=F.col("activity"), t=F.col("time"))
    return _rows(a, "conversation", "dialogues", F.concat_ws("-", F.lit("dialogue"), "i", "j"), prompt, answer, F.lit(None))


def language_skill(spark: SparkSession) -> DataFrame:
    """Antonyms in both directions, and corrections without pairs that need none."""
    a = _table(spark, ANTONYMS + tuple((y, x) for x, y in ANTONYMS), "x string, y string")
    c = _table(spark, CORRECTIONS, "x string, y string").where("x <> y")
    one = _rows(a, "language", "antonyms", F.concat(F.lit("antonym-"), F.least("x", "y")), F.concat(F.lit("What is the opposite of "), "x", F.lit("?")), F.concat("y", F.lit(".")), F.col("y"))
    return one.unionByName(_rows(c, "language", "corrections", F.concat(F.lit("correction-"), "x"), F.concat(F.lit("Correct: "), "x"), F.col("y"), F.col("y")))


def english(spark: SparkSession) -> DataFrame:
    """Activities in seven openings."""
    opening = ("Hello! I {a} today.", "How do I {a}?", "Is it hard to {a}?", "Why do people {a}?", "Who could {a} with me?", "When should I {a}?", "Where can I {a}?")
    a = _table(spark, enumerate(ACTIVITIES), "i long, activity string").crossJoin(_numbers(spark, "k", 0, len(opening) - 1))
    return _rows(a, "conversation", "english", F.concat(F.lit("english-"), "activity"), _fill(_cycle(opening, F.col("k")), a=F.col("activity")), _fill(F.lit("Let us talk about how you {a}."), a=F.col("activity")), F.lit(None))


def long_context(spark: SparkSession, facts_: int = 120) -> DataFrame:
    """A long list of facts and a question on one of them, by position."""
    said = F.lit(" ".join(f"Box {i} holds {i * 37 % 101} coins." for i in range(1, facts_ + 1)))
    q = _numbers(spark, "k", 1, 10).withColumn("box", F.expr("k * 11"))
    value = F.col("box") * 37 % 101
    return _rows(q, "multi_turn", "long_context", F.concat(F.lit("long-"), F.col("box").cast("string")), F.concat(said, F.lit(" How many coins are in box "), "box", F.lit("?")), F.concat(F.lit("Box "), "box", F.lit(" holds "), value, F.lit(" coins.")), value)


GENERATORS = (arithmetic, facts, explanations, areas, percents, programs, translations, number_lists, selections, dialogues, language_skill, english, long_context)


def everything(spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, (g(spark) for g in GENERATORS))


def expression_value(text: Column) -> Column:
    """Value of `a op b` with + − × ÷; null for anything else and where division isn't exact."""
    part = lambda i: F.regexp_extract(text, r"^(-?\d+)([+−×÷])(-?\d+)$", i)
    a, b = F.try_to_number(part(1), F.lit("S999999999")).cast("long"), F.try_to_number(part(3), F.lit("S999999999")).cast("long")
    exact = F.when((b != 0) & (F.try_mod(a, b) == 0), F.try_divide(a, b).cast("long"))
    return F.when(part(2) == "+", a + b).when(part(2) == "−", a - b).when(part(2) == "×", a * b).when(part(2) == "÷", exact)


def checked(rows: DataFrame) -> DataFrame:
    """Rows of each generator, and how many of them state the value that is worked out anew from the prompt."""
    number = lambda i: F.element_at(F.regexp_extract_all("prompt", F.lit(r"-?\d+"), F.lit(0)), i).cast("long")
    g = F.col("generator")
    again = (
        F.when(g == "arithmetic", expression_value(F.replace(F.regexp_extract("prompt", r"(-?\d+ [+−×÷] -?\d+)", 1), F.lit(" "))).cast("string"))
        .when(g == "rectangle_area", (number(1) * number(2)).cast("string"))
        .when(g == "numeric_sort", F.array_join(F.transform(F.array_sort(F.transform(F.regexp_extract_all("prompt", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))), lambda x: x.cast("string")), ", "))
        .otherwise(F.col("expected"))
    )
    fine = F.coalesce((again == F.col("expected")) & F.col("answer").contains(F.col("expected")), F.col("expected").isNull())
    return rows.groupBy("generator").agg(F.count(F.lit(1)).alias("n"), F.count_if(fine).alias("fine"))
