"""Queries on conversations, question-answer items and generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _read, query
from .functions import text as T
from .functions.unicode import dedup_key, folded
from .operators import conversations as C
from .operators import generate, qa
from .session import stash

_KEY = r"trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\s\x0b]+', ' ', 'g'))"
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_ANSWERS = "FROM conversations WHERE role = 'assistant'"
_NAMED = "list_value(" + ",".join(f"'{c}'" for c in C.CATEGORIES) + ")"


def _turns(spark, sf_dir):
    return _read(spark, sf_dir, "conversations")


def _answers(spark, sf_dir):
    return _turns(spark, sf_dir).where("role = 'assistant'")


@query("prefix_top", rf"""WITH w AS (SELECT {_TOKENS} AS ws {_ANSWERS}), p AS (SELECT unnest(list_transform(range(3, least(10, len(ws)) + 1), lambda n: n || ':' || array_to_string(list_slice(ws, 1, n), ' '))) AS item FROM w)
SELECT item, count(*) AS n FROM p GROUP BY item ORDER BY n DESC, item LIMIT 50""")
def prefix_top(spark, sf_dir):
    return C.top_per(_answers(spark, sf_dir), T.prefixes(T.tokens(F.lower("text"))), 50)


@query("ngram5_top_by_turn", rf"""WITH w AS (SELECT turn, {_TOKENS} AS ws {_ANSWERS}), g AS (SELECT turn, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS item FROM w),
c AS (SELECT turn, item, count(*) AS n FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY n DESC, item) AS r FROM c) SELECT turn, item, n FROM r WHERE r <= 10""")
def ngram5_top_by_turn(spark, sf_dir):
    return C.top_per(_answers(spark, sf_dir), T.ngrams(T.tokens(F.lower("text")), 5), 10, "turn")


@query("template_families", rf"""WITH a AS (SELECT CAST(turn AS VARCHAR) AS turn, regexp_replace(regexp_replace(trim(lower(text), ' ' || chr(9) || chr(10)), '(^|[^\p{{L}}\p{{N}}_])[+-]?\p{{Nd}}+(?:[.,]\p{{Nd}}+)?($|[^\p{{L}}\p{{N}}_])', '\1{{N}}\2', 'g'), '\s+', ' ', 'g') AS shape {_ANSWERS}),
c AS (SELECT turn, shape, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT '*', shape, count(*) FROM a GROUP BY shape)
SELECT turn, count(*) AS families, max(n) / greatest(1, sum(n)) AS largest_share, CAST(sum(n - 1) AS BIGINT) AS excess FROM c GROUP BY turn""")
def template_families(spark, sf_dir):
    return C.template_families(_answers(spark, sf_dir).select(F.col("turn").cast("string").alias("turn"), "text"), "turn")


@query("duplicate_answers", f"WITH k AS (SELECT {_KEY} AS k {_ANSWERS}), g AS (SELECT k, count(*) AS n FROM k GROUP BY k) SELECT count(*) FILTER (n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS excess, count(*) / sum(n) AS unique_share FROM g")
def duplicate_answers(spark, sf_dir):
    g = _answers(spark, sf_dir).groupBy(dedup_key(F.col("text")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.col("n") - 1).alias("excess"), (F.count(F.lit(1)) / F.sum("n")).alias("unique_share"))


@query("turn_lengths", r"SELECT role, max(length(text)) AS max_chars, avg(length(text)) AS mean_chars, max(len(regexp_extract_all(text, '[^ ]+'))) AS max_words, avg(len(regexp_extract_all(text, '[^ ]+'))) AS mean_words FROM conversations GROUP BY role")
def turn_lengths(spark, sf_dir):
    n, w = F.length("text").cast("long"), F.regexp_count("text", F.lit("[^ ]+")).cast("long")
    return _turns(spark, sf_dir).groupBy("role").agg(F.max(n).alias("max_chars"), F.avg(n).alias("mean_chars"), F.max(w).alias("max_words"), F.avg(w).alias("mean_words"))


_SPOKEN = "WITH s AS (SELECT conv_id, lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '')) AS t FROM conversations GROUP BY conv_id)"


@query("prompt_language", f"{_SPOKEN} SELECT conv_id, CASE WHEN len(regexp_extract_all(t, '[a-z]')) > len(regexp_extract_all(t, '[а-яё]')) THEN 'en' ELSE 'ru' END AS language FROM s")
def prompt_language(spark, sf_dir):
    convs = C.conversations(_turns(spark, sf_dir))
    return convs.select("conv_id", C.message_language(F.col("messages"), F.lit(None).cast("string")).alias("language"))


@query("balance_rules", f"""{_SPOKEN}, c AS (SELECT {_NAMED}[conv_id % 9 + 1] AS category, CASE WHEN len(regexp_extract_all(t, '[a-z]')) > len(regexp_extract_all(t, '[а-яё]')) THEN 'en' ELSE 'ru' END AS language FROM s),
n AS (SELECT count(*) AS n, count(*) FILTER (category IN ('math', 'programming')) AS calc, count(*) FILTER (language = 'ru') AS ru, count(*) FILTER (language = 'en') AS en FROM c),
m AS (SELECT * FROM (VALUES ('conversation', 9000), ('multi_turn', 3500), ('explanations', 2500), ('general_knowledge', 2500), ('language', 1200)) t(c, m))
SELECT 'least_' || m.c AS rule, (SELECT count(*) FROM c WHERE category = m.c)::DOUBLE AS value, (SELECT count(*) FROM c WHERE category = m.c) < m.m AS broken FROM m
UNION ALL SELECT 'calculation', 100 * calc / greatest(1, n), 100 * calc / greatest(1, n) > 30 FROM n
UNION ALL SELECT 'language_ru', round(100 * ru / greatest(1, ru + en), 2), NOT round(100 * ru / greatest(1, ru + en), 2) BETWEEN 85 AND 95 FROM n
UNION ALL SELECT 'language_en', round(100 * en / greatest(1, ru + en), 2), NOT round(100 * en / greatest(1, ru + en), 2) BETWEEN 5 AND 15 FROM n""")
def balance_rules(spark, sf_dir):
    """Conversations have no category, so their number stands in for it."""
    convs = C.conversations(_turns(spark, sf_dir))
    named = F.element_at(F.array(*map(F.lit, C.CATEGORIES)), (F.col("conv_id") % 9 + 1).cast("int"))
    return C.balance(convs.select(named.alias("category"), C.message_language(F.col("messages"), F.lit(None).cast("string")).alias("language")))


@query("conversation_ids", f"""WITH t AS (SELECT conv_id, string_agg(role || ':' || {_KEY}, chr(10) ORDER BY turn) AS j FROM conversations GROUP BY conv_id), k AS (SELECT conv_id, sha256(j) AS conv_key FROM t)
SELECT conv_id, conv_key, substr(sha256('chat' || chr(10) || conv_id || chr(10) || conv_key), 1, 20) AS id FROM k""")
def conversation_ids(spark, sf_dir):
    return C.row_ids(_turns(spark, sf_dir), F.lit("chat"), F.col("conv_id").cast("string")).select("conv_id", "conv_key", "id")


_COMPONENTS = f"""u AS (SELECT DISTINCT conv_id, {_KEY} AS k FROM conversations WHERE role = 'user'), e AS (SELECT DISTINCT a.conv_id AS a, b.conv_id AS b FROM u a JOIN u b USING (k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT conv_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.conv_id), conv_id) AS component FROM (SELECT DISTINCT conv_id FROM conversations) d)"""


@query("prompt_components", f"WITH RECURSIVE {_COMPONENTS} SELECT conv_id, component FROM c")
def prompt_components(spark, sf_dir):
    return C.group_split(_turns(spark, sf_dir)).select("conv_id", "component")


@query("group_split", f"""WITH RECURSIVE {_COMPONENTS}, s AS (SELECT component, count(*) AS n, substr(sha256(concat('42', chr(0), CAST(component AS VARCHAR))), 1, 16) AS h FROM c GROUP BY component),
p AS (SELECT component, sum(n) OVER (ORDER BY h, component) - n AS before, sum(n) OVER () AS every FROM s)
SELECT conv_id, component, CASE WHEN before < greatest(1, round_even(every * 0.05::DOUBLE, 0)) THEN 'validation' ELSE 'train' END AS split FROM c JOIN p USING (component)""")
def group_split(spark, sf_dir):
    return C.group_split(_turns(spark, sf_dir))


@query("leak_free", f"SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'user' AND {_KEY} IN (SELECT {_KEY} FROM conversations WHERE role = 'user' AND conv_id % 10 = 3)) GROUP BY conv_id")
def leak_free(spark, sf_dir):
    """The prompts of every tenth conversation stand for a fixed evaluation set."""
    turns = _turns(spark, sf_dir)
    return C.without_leaks(turns, turns.where("role = 'user' AND conv_id % 10 = 3")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query("conversation_gates")
def conversation_gates(spark, sf_dir):
    return C.gates(_turns(spark, sf_dir))


_OPENINGS = " OR ".join(f"starts_with(ltrim(lower(t)), '{p}')" for p in C.ARTIFICIAL_PREFIXES)
_CHECKS = rf"""WITH s AS (SELECT conv_id, role, coalesce(text, '') AS t FROM conversations), e AS (SELECT conv_id, unnest([
CASE WHEN regexp_matches(t, '(?:^|[^\p{{L}}\p{{N}}_.+-])[\p{{L}}\p{{N}}_.+-]{{1,64}}@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}(?:[^\p{{L}}\p{{N}}_]|$)')
  OR regexp_matches(t, '(?i)(?:тел(?:ефон)?|phone|mobile|call|контакт|звонить|номер)\s*[:#-]?\s*\+?\p{{Nd}}[\p{{Nd}}\s().-]{{8,}}\p{{Nd}}')
  OR regexp_matches(t, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:api[_ -]?key|access[_ -]?token|client[_ -]?secret|password|пароль|секретный\s+ключ)\s*[:=]\s*[^\s,;]{{8,}}') THEN 'pii_or_secret' END,
CASE WHEN contains(t, '�') OR contains(t, chr(0)) OR nfc_normalize(t) <> t THEN 'damaged_unicode' END, CASE WHEN regexp_matches(t, '[ÃÐÑ]') THEN 'mojibake' END,
CASE WHEN role = 'assistant' AND length(t) > 3000 THEN 'long_answer' END, CASE WHEN role = 'assistant' AND ({_OPENINGS}) THEN 'artificial_prefix' END]) AS error FROM s)
SELECT conv_id, string_agg(DISTINCT error, ',' ORDER BY error) AS errors FROM e WHERE error IS NOT NULL GROUP BY conv_id"""


@query("row_errors", _CHECKS)
def row_errors(spark, sf_dir):
    return C.row_errors(_turns(spark, sf_dir))


_SPECIAL = {"bos": 2, "eos": 3, "system": 4, "user": 5, "assistant": 6}


def _encoded(spark, sf_dir):
    ids = F.transform(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)), lambda w: F.length(w) + 10)
    m = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", ids.alias("ids")))).alias("m"))
    return m.select("conv_id", "m", C.encode_messages(F.col("m"), _SPECIAL).alias("e"))


_FLAT = """WITH m AS (SELECT conv_id, turn, 0 AS i, CASE role WHEN 'system' THEN 4 WHEN 'user' THEN 5 ELSE 6 END AS id, false AS mask FROM conversations
UNION ALL SELECT conv_id, turn, unnest(range(len(w))) + 1, length(unnest(w)) + 10, role = 'assistant' FROM (SELECT conv_id, turn, role, regexp_extract_all(text, '[^ ]+') AS w FROM conversations)
UNION ALL SELECT DISTINCT conv_id, -1, 0, 2, false FROM conversations UNION ALL SELECT DISTINCT conv_id, 1000000, 0, 3, true FROM conversations),
s AS (SELECT conv_id, list(id ORDER BY turn, i) AS ids, list(mask ORDER BY turn, i) AS mask FROM m GROUP BY conv_id)"""


@query("encoded_messages", f"{_FLAT} SELECT conv_id, array_to_string(ids, ',') AS ids, array_to_string(list_transform(mask, lambda x: CAST(x AS INTEGER)), ',') AS mask FROM s")
def encoded_messages(spark, sf_dir):
    text = lambda c, t: F.array_join(F.transform(c, lambda x: x.cast(t).cast("string")), ",")
    return _encoded(spark, sf_dir).select("conv_id", text("e.ids", "int").alias("ids"), text("e.mask", "int").alias("mask"))


@query("training_pairs", f"{_FLAT} SELECT conv_id, array_to_string(list_slice(ids, 1, len(ids) - 1), ',') AS inputs, array_to_string(list_transform(range(2, len(ids) + 1), lambda i: CASE WHEN mask[i] THEN ids[i] ELSE -100 END), ',') AS labels FROM s")
def training_pairs(spark, sf_dir):
    p = _encoded(spark, sf_dir).select("conv_id", C.training_pair(F.col("e")).alias("p"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return p.select("conv_id", text("p.inputs").alias("inputs"), text("p.labels").alias("labels"))


@query("chat_prompts", f"{_FLAT} SELECT conv_id, array_to_string(list_append(list_slice(ids, 1, len(ids) - 1), 6), ',') AS ids FROM s")
def chat_prompts(spark, sf_dir):
    return _encoded(spark, sf_dir).select("conv_id", F.array_join(F.transform(C.chat_prompt(F.col("m"), _SPECIAL), lambda x: x.cast("string")), ",").alias("ids"))


#: Question-answer items by a rule, as Spark SQL; DuckDB's differs by the name of the array function.
_ITEMS = """SELECT id AS uid, CASE WHEN id % 3 = 0 THEN 'dev' ELSE 'test' END AS file, concat('Who wrote book number ', CAST(id % 220 AS STRING), ' of the ', CASE WHEN id % 5 = 0 THEN 'blue' ELSE 'green' END, ' shelf?') AS question,
CASE WHEN id % 17 = 0 THEN concat(CAST(1900 + id % 100 AS STRING), ' год') WHEN id % 13 = 0 THEN CAST(id * 3 AS STRING) WHEN id % 19 = 0 THEN 'North (old), part' ELSE concat('Author ', CAST(id * 7 % 50 AS STRING)) END AS answer,
CASE id % 6 WHEN 0 THEN array('wdt:P36') WHEN 1 THEN array('wdt:P50', 'wdt:P31') WHEN 2 THEN array('wdt:P569') WHEN 3 THEN array('wdt:P31') WHEN 4 THEN array('wdt:P999') ELSE array() END AS props,
array(concat('Q', CAST(id % 40 AS STRING))) AS uris FROM range(400)"""
_ITEMS_SQL = f"items AS ({_ITEMS.replace('array(', 'list_value(').replace('STRING', 'VARCHAR').replace('FROM range(400)', 'FROM range(400) t(id)').replace('list_value()', 'CAST([] AS VARCHAR[])')})"
_QN = r"array_to_string(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+'), ' ')"
_NORMED = f"{_ITEMS_SQL}, normed AS (SELECT *, {_QN.format('question')} AS qn, {_QN.format('answer')} AS an, coalesce(props[1], 'no_property') AS prop FROM items)"


def _items(spark):
    return spark.sql(_ITEMS).withColumn("props", F.col("props").cast("array<string>"))


@query("answer_kinds", rf"""WITH {_NORMED} SELECT CASE WHEN list_has_any(props, ['wdt:P569', 'wdt:P570', 'wdt:P571', 'wdt:P577', 'wdt:P585']) OR regexp_matches(answer, '\b\d{{3,4}}\s*(?:г\.?|год|до н\.?\s*э\.?)') THEN 'date_or_year'
WHEN list_has_any(props, ['wdt:P36', 'wdt:P17', 'wdt:P19', 'wdt:P20', 'wdt:P276', 'wdt:P131']) THEN 'place_or_country' WHEN list_has_any(props, ['wdt:P50', 'wdt:P57', 'wdt:P86', 'wdt:P170', 'wdt:P112', 'wdt:P61']) THEN 'person_or_creator'
WHEN regexp_full_match(trim(answer), '[+−-]?\d+(?:[.,]\d+)?') THEN 'number' WHEN list_has_any(props, ['wdt:P106', 'wdt:P31', 'wdt:P279', 'wdt:P136', 'wdt:P361', 'wdt:P527']) THEN 'concept_or_type' ELSE 'other' END AS kind, count(*) AS n FROM normed GROUP BY 1""")
def answer_kinds(spark, sf_dir):
    return qa.normed(_items(spark)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("qa_flags", f"WITH {_NORMED} SELECT 'compound_or_editorial_answer' AS flag, count(*) AS n FROM normed WHERE an <> '' AND regexp_matches(answer, '[,;()]')")
def qa_flags(spark, sf_dir):
    return qa.flags(_items(spark))


@query("qa_question_groups", f"WITH {_NORMED} SELECT qn, count(*) AS n, array_to_string(list_sort(list(DISTINCT an)), '|') AS answers, count(DISTINCT an) > 1 AS conflict FROM normed WHERE qn <> '' GROUP BY qn HAVING count(*) > 1")
def qa_question_groups(spark, sf_dir):
    return qa.question_groups(_items(spark))


@query("qa_fact_conflicts", f"WITH {_NORMED} SELECT uris[1] || '|' || prop AS fact, count(DISTINCT an) AS n_answers, array_to_string(list_slice(list_sort(list(DISTINCT an)), 1, 10), '|') AS answers, count(*) AS occurrences, prop IN ('wdt:P17', 'wdt:P36', 'wdt:P569', 'wdt:P570', 'wdt:P19', 'wdt:P20') AS functional FROM normed WHERE prop <> 'no_property' AND an <> '' GROUP BY uris[1], prop HAVING count(DISTINCT an) > 1")
def qa_fact_conflicts(spark, sf_dir):
    return qa.fact_conflicts(_items(spark))


@query("qa_first_questions", f"WITH {_NORMED}, f AS (SELECT qn, min(uid) AS uid, arg_min(an, uid) AS an FROM normed GROUP BY qn) SELECT n.uid, CASE WHEN n.uid = f.uid THEN 'kept' WHEN n.an = f.an THEN 'duplicate' ELSE 'conflict' END AS verdict FROM normed n JOIN f USING (qn)")
def qa_first_questions(spark, sf_dir):
    return qa.first_questions(_items(spark))


@query("qa_near_questions")
def qa_near_questions(spark, sf_dir):
    return qa.near_questions(_items(spark))


@query("qa_exclusions", f"WITH {_NORMED} SELECT uid FROM normed WHERE NOT (file = 'dev' AND uid % 2 = 0)")
def qa_exclusions(spark, sf_dir):
    items = _items(spark)
    return qa.without_listed(items, items.where("file = 'dev' AND uid % 2 = 0")).select("uid")


@query("qa_review", f"WITH {_NORMED} SELECT file, uid, CASE WHEN uid % 5 = 0 THEN 'pending' WHEN uid % 7 = 0 THEN 'rejected' ELSE 'ok' END AS status FROM normed")
def qa_review(spark, sf_dir):
    """Two lines of the log for each item; the later one counts."""
    items = _items(spark).select("file", "uid")
    log = items.where("uid % 5 <> 0").withColumn("line", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("status", F.when(F.col("line") == 1, "draft").when(F.col("uid") % 7 == 0, "rejected").otherwise("ok"))
    return qa.reviewed(items, log)


@query("stratified_sample")
def stratified_sample(spark, sf_dir):
    return qa.stratified(_items(spark), 60)


@query("arithmetic_rows", "SELECT a, b, op, CASE op WHEN '+' THEN a + b WHEN '−' THEN a - b WHEN '×' THEN a * b ELSE a // b END AS answer FROM range(1, 151) x(a), range(1, 91) y(b), (VALUES ('+'), ('−'), ('×'), ('÷')) o(op) WHERE op <> '÷' OR a % b = 0")
def arithmetic_rows(spark, sf_dir):
    r = generate.arithmetic(spark).withColumn("m", F.regexp_extract("prompt", r"(\d+ [+−×÷] \d+)", 1)).select(F.split("m", " ").alias("m"), "expected")
    return r.select(F.col("m")[0].cast("long").alias("a"), F.col("m")[2].cast("long").alias("b"), F.col("m")[1].alias("op"), F.col("expected").cast("long").alias("answer"))


@query("percent_rows", "SELECT p, w, CASE WHEN w * p % 100 = 0 THEN CAST(w * p // 100 AS VARCHAR) ELSE regexp_replace(CAST(CAST(w * p / 100.0 AS DECIMAL(12,2)) AS VARCHAR), '0$', '') END AS answer FROM (SELECT unnest([1, 2, 5, 10, 12, 15, 20, 25, 30, 40, 50, 60, 75]) AS p), (SELECT CAST(unnest(range(1, 21)) * 10 AS INTEGER) AS w)")
def percent_rows(spark, sf_dir):
    n = lambda i: F.element_at(F.regexp_extract_all("prompt", F.lit(r"\d+"), F.lit(0)), i).cast("int")
    return generate.percents(spark).select(n(1).alias("p"), n(2).alias("w"), F.col("expected").alias("answer"))


@query("sort_rows")
def sort_rows(spark, sf_dir):
    return generate.number_lists(spark).select("prompt", "answer")


@query("generated_rows", "SELECT * FROM (VALUES ('arithmetic', (SELECT count(*) FROM range(1, 151) x(a), range(1, 91) y(b), range(4) o(k) WHERE k < 3 OR a % b = 0)), ('capitals', 20), ('planets', 7), ('concepts', 60), ('rectangle_area', 900), ('percent', 260), ('function_patterns', 12 * 169), ('sentences', 48), ('numeric_sort', 200), ('selection', 50), ('dialogues', 36), ('antonyms', 8), ('corrections', 2), ('english', 28), ('long_context', 10)) t(generator, n), LATERAL (SELECT n AS fine)")
def generated_rows(spark, sf_dir):
    return generate.checked(stash(generate.everything(spark), "generated"))


@query("folded_keys", f"SELECT conv_id, turn, sha256({_KEY}) AS sha FROM conversations")
def folded_keys(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.sha2(dedup_key(F.col("text")), 256).alias("sha"))


@query("answer_traces", rf"""WITH a AS (SELECT conv_id, turn, {_TOKENS} AS said, list_slice({_TOKENS}, 1, 3) AS own {_ANSWERS}), b AS (SELECT *, list_filter(own, lambda w: length(w) >= 4) AS long FROM a), c AS (SELECT *, CASE WHEN len(long) > 0 THEN long ELSE own END AS asked FROM b)
SELECT conv_id, turn, len(asked) > 0 AS traced FROM c""")
def answer_traces(spark, sf_dir):
    """The first three words of an answer are traced in it."""
    first = F.array_join(F.slice(T.tokens(F.col("low")), 1, 3), " ")
    said = _answers(spark, sf_dir).withColumn("low", folded(F.col("text")))
    return said.select("conv_id", "turn", qa.traces(first, F.col("low")).alias("traced"))
