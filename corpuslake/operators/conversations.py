"""Operators on conversations: turn order, keys, gates of a training set, loss masks, leak-free splits, audits.

Turns are rows (conv_id, turn, role, text); conversations have one row with `messages`, an array of (role, content).
Order is always explicit: first-wins rules go by `conv_id`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.unicode import dedup_key, folded, nfc
from ..session import ship, stash

#: Openings that make an answer sound templated, and what of them is cut off.
ARTIFICIAL_PREFIXES = (
    "можно ответить так", "если тебе интересно", "если вам интересно",
    "можно сказать так", "можно написать так", "можно объяснить так",
    "ответ получается таким", "ответ получается следующим образом", "результат получается таким",
    "короткий ответ", "если кратко", "в двух словах", "запомни коротко",
    "основная идея такая", "для простого объяснения", "попробую объяснить проще",
    "попросту говоря", "проще говоря", "иными словами", "представь так", "это можно представить так",
)
_OPENINGS = (
    r"можно ответить так|можно сказать так|можно написать так|можно объяснить так|ответ получается таким(?:\s+образом)?|ответ получается следующим образом|результат получается таким(?:\s+образом)?",
    r"если тебе интересно|если вам интересно|короткий ответ|если кратко|в двух словах|запомни коротко|основная идея такая|для простого объяснения|попробую объяснить проще|попросту говоря|проще говоря|иными словами|представь так|это можно представить так",
)
CATEGORIES = ("conversation", "general_knowledge", "explanations", "math", "language", "translation", "programming", "instruction_following", "multi_turn")
#: Least number of examples by category, largest share of calculation, and bounds of the languages in percent.
MINIMUMS = {"conversation": 9000, "multi_turn": 3500, "explanations": 2500, "general_knowledge": 2500, "language": 1200}
MOST_CALCULATION, RUSSIAN, ENGLISH = 30, (85, 95), (5, 15)
PROMPT_CAP = 8
TURN_ORDER = "^(system,)?user,assistant(,user,assistant)*$"


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation, its messages in turn order (role breaks ties)."""
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def turn_order(turns: DataFrame) -> DataFrame:
    """Roles in turn order, and whether they break: optional system, then user and assistant in turn, ending with assistant."""
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    roles = ordered.select("conv_id", F.array_join("t.role", ",").alias("roles"))
    return roles.withColumn("bad", ~F.col("roles").rlike(TURN_ORDER))


def turn_order_error(messages: Column) -> Column:
    """Why the roles of a conversation break the order, or null."""
    roles = F.array_join(F.transform(messages, lambda m: F.coalesce(m["role"], F.lit("?"))), ",")
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "no messages")
        .when(~roles.rlike("^(system|user|assistant)(,(system|user|assistant))*$"), "unknown role")
        .when(roles.rlike(TURN_ORDER), F.lit(None).cast("string"))
        .when(~roles.rlike("assistant$"), "doesn't end with the assistant")
        .otherwise("roles don't alternate")
    )


def clean_style(text: Column) -> Column:
    """An answer without its templated opening, its first letter in upper case; iOS keeps its spelling."""
    out = F.btrim(nfc(text), F.lit(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"))
    for p in _OPENINGS:
        out = F.regexp_replace(out, rf"(?iuU)^(?:{p})\s*[:,—-]?\s*", "")
    first = F.substr(out, F.lit(1), F.lit(1))
    return F.when(out.startswith("iOS") | (out == "") | (F.upper(first) == first), out).otherwise(F.concat(F.upper(first), F.substr(out, F.lit(2))))


def _keyed(turns: DataFrame) -> DataFrame:
    """Turns with their text after style repair and its key."""
    fixed = F.when(F.col("role") == "assistant", clean_style(F.col("text"))).otherwise(nfc(F.col("text")))
    return turns.select("conv_id", "turn", "role", fixed.alias("text"), (F.coalesce(F.col("text"), F.lit("")) != F.coalesce(fixed, F.lit(""))).alias("repaired")).withColumn("key", dedup_key(F.coalesce("text", F.lit(""))))


def gates(turns: DataFrame) -> DataFrame:
    """conv_id and the first gate that rejects it (null: accepted), in ascending order of conv_id.

    Gates that look at one conversation alone come first as expressions.  The others depend on what was accepted
    before: a prompt that was accepted eight times, an equal conversation, an answer that was seen.  Only
    conversations that share a prompt or answer with another can be touched by them; each connected
    component of such conversations is gone through in order, all components in parallel.  Equal conversations
    after the first, and those that fail alone, are never accepted and take no part in that.
    """
    keyed = stash(_keyed(turns), "keyed")
    per = keyed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "key", "text"))).alias("m"))
    of = lambda role: F.transform(F.filter("m", lambda x: x["role"] == role), lambda x: x["key"])
    per = per.select("conv_id", F.array_join("m.role", ",").alias("roles"), of("user").alias("prompts"), of("assistant").alias("answers"), F.array_join("m.text", "\n").alias("joined"), F.sha2(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["key"])), "\n"), 256).alias("conv_key"))
    alone = (
        F.when(~F.col("roles").rlike(TURN_ORDER), "invalid_turn_order")
        .when(F.exists("prompts", lambda k: k == ""), "repeated_user_prompt_cap")
        .when(T.contact_or_secret(F.col("joined")), "pii_or_secret")
        .when(F.exists("answers", lambda k: k == ""), "empty_assistant")
        .when(F.size(F.array_distinct("answers")) < F.size("answers"), "repeated_turn_in_conversation")
    )
    judged = stash(per.withColumn("alone", alone).select("conv_id", "alone", "prompts", "answers", "conv_key"), "gates")
    #: Only these can be accepted: the first of equal conversations, if it passes alone.  All others see their prompts' caps afterwards.
    firsts = judged.where("alone IS NULL").groupBy("conv_key").agg(F.min("conv_id").alias("conv_id")).select("conv_id")
    open_ = stash(judged.join(firsts, "conv_id", "left_semi"), "open")
    hashed = lambda c, kind: F.transform(F.array_distinct(c), lambda k: F.xxhash64(F.lit(kind), k))
    names = open_.select("conv_id", F.explode(F.concat(hashed("prompts", "p"), hashed("answers", "a"))).alias("name"))
    linked = components(names, "conv_id", "name").withColumnRenamed("least", "comp")

    def walk(batch):
        import pandas as pd

        counts, seen, out = {}, set(), []
        for r in batch.sort_values("conv_id").itertuples():
            prompts, answers, why = list(r.prompts), list(r.answers), None
            if any(counts.get(k, 0) >= PROMPT_CAP for k in prompts):
                why = "repeated_user_prompt_cap"
            elif seen.intersection(answers):
                why = "duplicate_assistant_response"
            else:
                seen.update(answers)
                for k in prompts:
                    counts[k] = counts.get(k, 0) + 1
            out.append((r.conv_id, why))
        return pd.DataFrame(out, columns=["conv_id", "reason"])

    sizes = linked.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = linked.join(sizes, "comp", "left_semi")
    ship(turns.sparkSession)
    walked = several.join(open_, "conv_id").groupBy("comp").applyInPandas(walk, "conv_id long, reason string")
    alone_ = open_.join(several, "conv_id", "left_anti").select("conv_id", F.lit(None).cast("string").alias("reason"))
    decided = stash(alone_.unionByName(walked), "decided")
    #: Where a prompt was accepted for the eighth time; few rows have a prompt accepted, whoever asks it.
    accepted = open_.join(decided.where("reason IS NULL"), "conv_id").select("conv_id", F.explode("prompts").alias("k")).groupBy("k", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    reached = accepted.withColumn("so_far", F.sum("n").over(Window.partitionBy("k").orderBy("conv_id"))).where(F.col("so_far") >= PROMPT_CAP).groupBy("k").agg(F.min("conv_id").alias("full"))
    others = judged.join(decided, "conv_id", "left_anti")
    asked = others.where("alone IS NULL OR alone != 'invalid_turn_order'").select("conv_id", F.explode("prompts").alias("k"))
    capped = asked.join(reached, "k").where("full < conv_id").select("conv_id").distinct().withColumn("capped", F.lit(True))
    leaders = open_.select("conv_key", "conv_id").join(decided, "conv_id").select("conv_key", F.coalesce("reason", F.lit("duplicate_conversation")).alias("led"))
    late = others.join(capped, "conv_id", "left").join(leaders, "conv_key", "left")
    why = F.when(F.col("capped"), "repeated_user_prompt_cap").otherwise(F.coalesce("alone", "led"))
    return decided.unionByName(late.select("conv_id", why.alias("reason")))


def components(names: DataFrame, node: str, name: str) -> DataFrame:
    """(node, least) of nodes that share names, directly or through others; least is the smallest node they reach.

    Each round takes the least label of a name's nodes and a node's names, and then the label's own label.
    """
    held = stash(names.select(F.col(node).alias("n"), F.col(name).alias("k")).distinct(), "names")
    #: A name of one node links nothing.
    held = stash(held.join(held.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "k", "left_semi"), "shared")
    labels = stash(names.select(F.col(node).alias("n")).distinct().withColumn("l", F.col("n")), "labels")
    while True:
        by_name = held.join(labels, "n").groupBy("k").agg(F.min("l").alias("l"))
        seen = held.join(by_name, "k").groupBy("n").agg(F.min("l").alias("s"))
        step = labels.join(seen, "n", "left").select("n", "l", F.least("l", F.coalesce("s", "l")).alias("t"))
        own = labels.select(F.col("n").alias("t"), F.col("l").alias("u"))
        after = stash(step.join(own, "t").select("n", F.least("t", "u").alias("l"), (F.least("t", "u") != F.col("l")).alias("moved")), "labels")
        labels = after.select("n", "l")
        if after.where("moved").isEmpty():
            return labels.select(F.col("n").alias(node), F.col("l").alias("least"))


def without_leaks(turns: DataFrame, held_out: DataFrame, text: str = "text") -> DataFrame:
    """Turns of the conversations none of whose user messages is, normalised, a held-out prompt."""
    key = lambda c: F.sha2(dedup_key(F.col(c)), 256)
    wanted = held_out.select(key(text).alias("k")).distinct()
    hit = turns.where("role = 'user'").select("conv_id", key("text").alias("k")).join(wanted, "k", "left_semi").select("conv_id").distinct()
    return turns.join(hit, "conv_id", "left_anti")


def group_split(turns: DataFrame, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """conv_id, component and split: conversations that share a user prompt stay together.

    Components go to validation in the order of a seeded hash until it has round(n f) conversations, at
    least one; the last one may overshoot.
    """
    named = turns.where("role = 'user'").select("conv_id", F.xxhash64(dedup_key(F.col("text"))).alias("k"))
    every = turns.select("conv_id").distinct()
    linked = components(named, "conv_id", "k")
    whole = stash(every.join(linked, "conv_id", "left").select("conv_id", F.coalesce("least", "conv_id").alias("component")), "members")
    sizes = whole.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("h", T.split_hash(F.col("component").cast("string"), seed))
    limit = max(1, round(whole.count() * fraction))
    from .clean import prefix_sum

    placed = prefix_sum(sizes.withColumn("__o", F.concat("h", F.lpad(F.col("component").cast("string"), 20, "0"))), "__o", "n", "before")
    split = F.when(F.col("before") < limit, "validation").otherwise("train")
    return whole.join(placed.select("component", split.alias("split")), "component").select("conv_id", "component", "split")


def row_ids(turns: DataFrame, category: Column, group: Column) -> DataFrame:
    """(conv_id, conv_key, id): SHA-256 over roles and keys, and the first 20 digits of that over category, group and key."""
    lines = turns.select("conv_id", "turn", F.concat("role", F.lit(":"), dedup_key(F.col("text"))).alias("line"))
    whole = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("m"))
    keyed = whole.select("conv_id", F.sha2(F.array_join("m.line", "\n"), 256).alias("conv_key"))
    return keyed.withColumn("id", F.substr(F.sha2(F.concat_ws("\n", category, group, "conv_key"), 256), F.lit(1), F.lit(20)))


def mask_sizes(turns: DataFrame) -> DataFrame:
    """Tokens of the serialised conversation (begin, role and words of each turn, end), and how many carry loss."""
    n = F.regexp_count("text", F.lit("[^ ]+"))
    trained = F.coalesce(F.sum(F.when(F.col("role") == "assistant", n)), F.lit(0)) + 1
    return turns.groupBy("conv_id").agg((F.sum(n + 1) + 2).cast("long").alias("n_tokens"), trained.cast("long").alias("n_trained"))


def encode_messages(messages: Column, special: dict[str, int]) -> Column:
    """(ids, mask) of an array of (role, ids): begin, role and content of each message, one end; answers and the end carry loss.

    `special` has the ids of bos, eos and the roles.
    """
    marker = lambda role: F.when(role == "system", special["system"]).when(role == "user", special["user"]).otherwise(special["assistant"])
    ids = F.flatten(F.transform(messages, lambda m: F.concat(F.array(marker(m["role"])), m["ids"])))
    mask = F.flatten(F.transform(messages, lambda m: F.concat(F.array(F.lit(False)), F.transform(m["ids"], lambda _: m["role"] == "assistant"))))
    return F.struct(F.concat(F.array(F.lit(special["bos"])), ids, F.array(F.lit(special["eos"]))).alias("ids"), F.concat(F.array(F.lit(False)), mask, F.array(F.lit(True))).alias("mask"))


def training_pair(encoded: Column) -> Column:
    """(inputs, labels): all ids but the last, and the next id where it carries loss, else -100."""
    n = F.size(encoded["ids"])
    labels = F.zip_with(F.slice(encoded["ids"], F.lit(2), n - 1), F.slice(encoded["mask"], F.lit(2), n - 1), lambda i, m: F.when(m, i).otherwise(-100))
    return F.struct(F.slice(encoded["ids"], F.lit(1), n - 1).alias("inputs"), labels.alias("labels"))


def chat_prompt(messages: Column, special: dict[str, int]) -> Column:
    """Ids of a history without its end, then the marker of the assistant."""
    ids = encode_messages(messages, special)["ids"]
    return F.concat(F.slice(ids, F.lit(1), F.size(ids) - 1), F.array(F.lit(special["assistant"])))


def message_language(messages: Column, declared: Column) -> Column:
    """The declared language if it is ru or en, else that of the user's text; ru where both have as many letters."""
    said = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"]), " ")
    return F.when(declared.isin("ru", "en"), declared).otherwise(T.spoken(said))


def row_errors(turns: DataFrame, longest: int = 3000) -> DataFrame:
    """conv_id and the names of the checks that its texts fail, sorted; only rows with an error."""
    given = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = given.withColumn("low", F.ltrim(folded(F.col("text"))))
    t = F.col("text")
    opening = reduce(Column.__or__, (F.col("low").startswith(p) for p in ARTIFICIAL_PREFIXES))
    checks = F.array(
        F.when(T.contact_or_secret(t), "pii_or_secret"),
        F.when(t.contains("�") | t.contains("\u0000") | (nfc(t) != t), "damaged_unicode"),
        F.when(t.rlike("[ÃÐÑ]"), "mojibake"),
        F.when((F.col("role") == "assistant") & (F.length(t) > longest), "long_answer"),
        F.when((F.col("role") == "assistant") & opening, "artificial_prefix"),
    )
    named = said.select("conv_id", F.explode(F.array_compact(checks)).alias("error"))
    return named.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("error")), ",").alias("errors"))


def template_families(texts: DataFrame, *by: str) -> DataFrame:
    """Counts of answers with the same words but for numbers, over all and for each value of `by`: families, largest share, excess."""
    shaped = texts.select(*by, T.template(folded(F.col("text"))).alias("shape"))
    counted = shaped.groupBy(*by, "shape").agg(F.count(F.lit(1)).alias("n"))

    def report(c: DataFrame, keys: list[Column]) -> DataFrame:
        return c.groupBy(*keys).agg(F.count(F.lit(1)).alias("families"), (F.max("n") / F.greatest(F.lit(1), F.sum("n"))).alias("largest_share"), F.sum(F.col("n") - 1).alias("excess"))

    every = counted.groupBy("shape").agg(F.sum("n").alias("n"))
    if not by:
        return report(every, [])
    whole = report(every, []).select(*[F.lit("*").alias(b) for b in by], "families", "largest_share", "excess")
    return whole.unionByName(report(counted, [F.col(b) for b in by]))


def top_per(texts: DataFrame, items: Column, k: int, *by: str) -> DataFrame:
    """The k most frequent items of each value of `by` (of all rows without), ties by item."""
    counted = texts.select(*by, F.explode(items).alias("item")).groupBy(*by, "item").agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counted.orderBy(F.desc("n"), "item").limit(k)
    return counted.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "item"))).where(F.col("r") <= k).drop("r")


def balance(rows: DataFrame) -> DataFrame:
    """Rules on the mix of categories and languages that rows (category, language) break, as (rule, value)."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES), *(F.count_if(F.col("language") == x).alias(x) for x in ("ru", "en")))
    share = lambda x, of: 100 * x / F.greatest(F.lit(1), of)
    known = F.col("ru") + F.col("en")
    rules = [F.struct(F.lit(f"least_{c}").alias("rule"), F.col(c).cast("double").alias("value"), (F.col(c) < m).alias("broken")) for c, m in MINIMUMS.items()]
    calc = share(F.col("math") + F.col("programming"), F.col("n"))
    rules.append(F.struct(F.lit("calculation").alias("rule"), calc.alias("value"), (calc > MOST_CALCULATION).alias("broken")))
    for name, (lo, hi) in (("ru", RUSSIAN), ("en", ENGLISH)):
        s = F.round(share(F.col(name), known), 2)
        rules.append(F.struct(F.lit(f"language_{name}").alias("rule"), s.alias("value"), (~s.between(lo, hi)).alias("broken")))
    return counts.select(F.explode(F.array(*rules)).alias("r")).select("r.*")
