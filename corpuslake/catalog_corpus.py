"""Queries on documents, pages, logs and scores: near duplicates, blocks, token statistics, sampling, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _LOG, _WORDS, _read, query
from .operators import blocks, clean, near, sampling, telemetry

_PRINTS = f"""w AS (SELECT doc_id, sha256(text) AS sha, list_transform({_WORDS}, lambda x: lower(x)) AS ws FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, unnest(list_transform(range(0, len(ws) - 4, greatest(1, (len(ws) - 4) // 4096)), lambda i: CAST('0x' || substr(md5(array_to_string(list_slice(ws, i + 1, i + 5), ' ')), 1, 16) AS UBIGINT))) AS h FROM w WHERE len(ws) >= 5),
bits AS (SELECT doc_id, b, sum((h >> CAST(b AS UBIGINT)) & 1) AS ones, count(*) AS n FROM h, range(64) t(b) GROUP BY ALL),
f AS (SELECT doc_id, CAST(sum(CASE WHEN 2 * ones >= n THEN CAST(1 AS HUGEINT) << CAST(b AS INTEGER) ELSE 0 END) AS UBIGINT) AS fp FROM bits GROUP BY doc_id UNION ALL SELECT doc_id, 0 FROM w WHERE len(ws) < 5),
leaders AS (SELECT fp, min(doc_id) AS d FROM f GROUP BY fp),
e AS (SELECT x.d AS a, y.d AS b FROM leaders x JOIN leaders y ON x.d < y.d AND bit_count(xor(x.fp, y.fp)) <= 2)"""


@query("near_dup_pairs", f"WITH {_PRINTS} SELECT a, b FROM e")
def near_dup_pairs(spark, sf_dir):
    from .functions import text as T

    docs = _read(spark, sf_dir, "documents").where("text IS NOT NULL")
    prints = docs.select("doc_id", near.simhash(F.transform(T.words(F.col("text")), F.lower), "md5").alias("fp")).groupBy("fp").agg(F.min("doc_id").alias("ord"))
    return near.pairs(prints, 2)


@query(
    "near_dup_kept",
    f"""WITH RECURSIVE {_PRINTS}, nodes AS (SELECT d, row_number() OVER (ORDER BY d) AS rn FROM (SELECT a AS d FROM e UNION SELECT b FROM e)),
nb AS (SELECT b AS d, list(a) AS smaller FROM e GROUP BY b),
g(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT g.i + 1, CASE WHEN list_has_any(g.kept, coalesce(nb.smaller, CAST([] AS BIGINT[]))) THEN g.kept ELSE list_append(g.kept, nodes.d) END FROM g JOIN nodes ON nodes.rn = g.i + 1 LEFT JOIN nb ON nb.d = nodes.d),
last AS (SELECT kept FROM g ORDER BY i DESC LIMIT 1),
stays AS (SELECT fp, d, d NOT IN (SELECT d FROM nodes) OR list_contains((SELECT kept FROM last), d) AS s FROM leaders)
SELECT f.doc_id, CASE WHEN s AND f.doc_id = stays.d THEN 'kept' WHEN s AND w.sha = o.sha THEN 'exact' ELSE 'near' END AS verdict
FROM f JOIN w USING (doc_id) JOIN stays USING (fp) JOIN w o ON o.doc_id = stays.d""",
)
def near_dup_kept(spark, sf_dir):
    """With the hash that SQL has; `near_dup_simhash` uses the default one."""
    return near.near_duplicates(_read(spark, sf_dir, "documents"), kind="md5")


@query("near_dup_simhash")
def near_dup_simhash(spark, sf_dir):
    return near.near_duplicates(_read(spark, sf_dir, "documents"))


_IDS = "list_append(list_transform(regexp_extract_all(coalesce(text, ''), '[^ \\n]+'), lambda w: length(w) + 10), 1)"


@query("single_record_split", r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT *, least(greatest(1, CAST(round_even(len(ws) * 0.1::DOUBLE, 0) AS BIGINT)), len(ws) - 1) AS k FROM w)
SELECT doc_id, sha256(CASE WHEN len(ws) < 2 THEN text ELSE array_to_string(list_slice(ws, 1, len(ws) - k), ' ') END) AS train, sha256(CASE WHEN len(ws) >= 2 THEN array_to_string(list_slice(ws, len(ws) - k + 1, len(ws)), ' ') END) AS validation FROM k""")
def single_record_split(spark, sf_dir):
    s = clean.single_record_split(F.col("text"), 0.1)
    parts = _read(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return parts.select("doc_id", F.sha2("s.train", 256).alias("train"), F.sha2("s.validation", 256).alias("validation"))


@query("id_blocks", f"""WITH t AS (SELECT doc_id, {_IDS} AS ids FROM documents), p AS (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM t),
n AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM p), b AS (SELECT pos // 1025 AS block, array_to_string(list(id ORDER BY pos), ',') AS ids, count(*) AS n FROM n GROUP BY 1)
SELECT CAST(block AS BIGINT) AS block, sha256(ids) AS sha FROM b WHERE n = 1025""")
def id_blocks(spark, sf_dir):
    got = blocks.blocks(_read(spark, sf_dir, "documents"), blocks.word_ids(F.col("text")), 1025)
    return got.select("block", F.sha2(F.array_join(F.transform("tokens", lambda x: x.cast("string")), ","), 256).alias("sha"))


@query("token_stats", f"""WITH f AS (SELECT min(doc_id) AS doc_id, text, arg_min(lang, doc_id) AS lang FROM documents WHERE text IS NOT NULL GROUP BY text), h AS (SELECT *, substr(sha256(concat('42', chr(0), text)), 1, 16) AS h FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY h) AS r, count(*) OVER () AS n FROM h),
t AS (SELECT CASE WHEN r <= least(greatest(1, round_even(n * 0.01, 0)), n - 1) THEN 'validation' ELSE 'train' END AS split, coalesce(lang, 'unknown') AS language, len({_IDS}) AS n_tokens, len({_WORDS}) AS n_words FROM r),
c AS (SELECT split, language, count(*) AS docs, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_words) AS BIGINT) AS words FROM t GROUP BY CUBE (split, language))
SELECT *, round(tokens::DOUBLE / greatest(1, words), 4) AS tokens_per_word, round(tokens * 100.0::DOUBLE / (SELECT sum(n_tokens) FROM t), 4) AS token_share FROM c""")
def token_stats(spark, sf_dir):
    return blocks.token_stats(blocks.prepare(_read(spark, sf_dir, "documents"), blocks.word_ids(F.col("text"))))


@query("bpe_round_trip")
def bpe_round_trip(spark, sf_dir):
    """Whole texts to ids of a public tokenizer and back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return _read(spark, sf_dir, "documents").select("doc_id", blocks.round_trip(F.col("text"), path).alias("r")).select("doc_id", "r.n_tokens", "r.same")


_SCORES = "s AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS BIGINT) AS token, CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings)"
_PROB = "p AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM {}), q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM p)"


def _scores(spark, sf_dir):
    return telemetry.scores_of(_read(spark, sf_dir, "embeddings"))


@query("topk_scores", f"WITH {_SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY score DESC) AS r FROM s) SELECT vec_id, token, score FROM r WHERE r <= 5")
def topk_scores(spark, sf_dir):
    return sampling.top_k(_scores(spark, sf_dir), 5)


@query("topk_topp", f"WITH {_SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY score DESC) AS r FROM s), k AS (SELECT vec_id, token, score / 0.8::DOUBLE AS score FROM r WHERE r <= 50), {_PROB.format('k')}, c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY score DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q) SELECT vec_id, token, score FROM c WHERE b <= 0.9")
def topk_topp(spark, sf_dir):
    return sampling.nucleus(sampling.heat(sampling.top_k(_scores(spark, sf_dir), 50), 0.8), 0.9)


@query("greedy_penalized", f"WITH {_SCORES}, u AS (SELECT vec_id, token, CASE WHEN token % 3 = 0 THEN CASE WHEN score < 0 THEN score * 1.5::DOUBLE ELSE score / 1.5::DOUBLE END ELSE score END AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, token) AS r FROM u) SELECT vec_id, token, score FROM r WHERE r = 1")
def greedy_penalized(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    return sampling.heat(sampling.penalize(scores, scores.where("token % 3 = 0"), 1.5), 0)


@query("seeded_draw", f"""WITH {_SCORES}, {_PROB.format('s')}, c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY token) AS c FROM q),
u AS (SELECT *, CAST(CAST('0x' || substr(sha256(concat('7', chr(0), CAST(vec_id AS VARCHAR))), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM c)
SELECT vec_id, coalesce(min(token) FILTER (c > u), max(token)) AS token FROM u GROUP BY vec_id""")
def seeded_draw(spark, sf_dir):
    return sampling.draw(_scores(spark, sf_dir), sampling.uniform(F.col("vec_id"), 7))


_BATCHES = "SELECT user_id AS run, event_id AS step, value AS loss, event_id % 7 + 1 AS tokens, event_id % 5 / 2.0::DOUBLE AS seconds FROM events"


def _batches(spark, sf_dir):
    e = F.col("event_id")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), e.alias("step"), F.col("value").alias("loss"), (e % 7 + 1).alias("tokens"), (e % 5 / F.lit(2.0)).alias("seconds"))


@query("tokens_trained", f"WITH b AS ({_BATCHES}) SELECT run, step, CAST(sum(tokens) OVER (PARTITION BY run ORDER BY step) AS BIGINT) AS tokens_trained, tokens / nullif(seconds, 0) AS tokens_per_second FROM b")
def tokens_trained(spark, sf_dir):
    return telemetry.running(_batches(spark, sf_dir))


@query("weighted_loss", f"WITH b AS ({_BATCHES}) SELECT run, sum(loss * tokens) / sum(tokens) AS loss, exp(least(sum(loss * tokens) / sum(tokens), 20)) AS perplexity FROM b GROUP BY run")
def weighted_loss(spark, sf_dir):
    return telemetry.weighted_loss(_batches(spark, sf_dir))


@query("stop_step", f"WITH {_LOG}, r AS (SELECT *, loss > lag(loss) OVER (PARTITION BY run ORDER BY step) AS up FROM log), g AS (SELECT *, sum(CASE WHEN coalesce(up, false) THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY step) AS island FROM r), s AS (SELECT run, step, sum(CASE WHEN coalesce(up, false) THEN 1 ELSE 0 END) OVER (PARTITION BY run, island ORDER BY step) AS streak FROM g) SELECT run, min(step) FILTER (streak >= 4) AS stop FROM s GROUP BY run")
def stop_step(spark, sf_dir):
    return telemetry.stop_step(telemetry.log_of(_read(spark, sf_dir, "events")), 4)


@query("log_resume", "WITH l AS (SELECT event_id AS line, (event_id * 13) % 997 AS step, value AS loss FROM events WHERE event_id % 11 <> 0) SELECT step, arg_max(loss, line) AS loss FROM l WHERE step <= 500 GROUP BY step")
def log_resume(spark, sf_dir):
    """Every eleventh line is broken, and steps repeat."""
    e = F.col("event_id")
    record = F.to_json(F.struct((e * 13 % 997).alias("step"), F.col("value").alias("validation_loss")))
    return telemetry.resume(_read(spark, sf_dir, "events").select(e.alias("line"), F.when(e % 11 == 0, '{"step": 1').otherwise(record).alias("value")), 500)


@query("git_blob_sha", "SELECT doc_id, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS sha FROM documents")
def git_blob_sha(spark, sf_dir):
    from .functions.text import git_blob_sha as sha

    return _read(spark, sf_dir, "documents").select("doc_id", sha(F.col("text")).alias("sha"))


@query("wiki_urls", "SELECT page_id, 'https://simple.wikipedia.org/wiki/' || replace(replace(replace(replace(url_encode(replace(url, ' ', '_')), '%28', '('), '%29', ')'), '%21', '!'), '%2C', ',') AS url FROM pages")
def wiki_urls(spark, sf_dir):
    from .functions.text import wiki_url

    return _read(spark, sf_dir, "pages").select("page_id", wiki_url("https://simple.wikipedia.org/wiki/", F.col("url")).alias("url"))
