"""The suffix tree against a brute-force tree, and its growth with the corpus."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import suffix_tree

DEPTH = 7


def stream(t):
    return b"\n" * DEPTH + b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n"


def brute(texts, learned):
    """Scores, and how many contexts are retained by length."""
    after = defaultdict(Counter)
    for t in learned:
        s = stream(t)
        for i in range(DEPTH, len(s)):
            for k in range(DEPTH + 1):
                after[s[i - k : i]][s[i]] += 1
    root = after[b""]
    d = max(1, len(root))
    p = {b"": {b: (root[b] + d / 256) / (root.total() + d) for b in range(256)}}
    longest = lambda c: next(c[i:] for i in range(len(c) + 1) if c[i:] in p)
    retained = Counter()
    for c in sorted((c for c in after if c), key=len):
        q, n, kinds = p[longest(c)], after[c].total(), len(after[c])
        own = {b: (after[c][b] + kinds * q[b]) / (n + kinds) for b in range(256)}
        if n >= 2 and n * sum(x * math.log(x / q[b]) for b, x in own.items()) >= 0.5:
            p[c] = own
            retained[len(c)] += 1
    scores = []
    for t in texts:
        s = stream(t)
        scores.append(sum(math.log10(p[longest(s[i - DEPTH : i])][s[i]]) for i in range(DEPTH, len(s))))
    return scores, [retained[k] for k in range(1, DEPTH + 1)]


def sample(n, seed=4):
    rng = np.random.default_rng(seed)
    known = ["".join(rng.choice(list("abcdeéя"), rng.integers(2, 9))) for _ in range(60)]
    return [" ".join(known[int(60 * rng.random() ** 2)] for _ in range(rng.integers(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [6 << 20, 300])
def test_scores_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_tree, "GRAM_BYTES", chunk)
    texts = [None, "", "  ", *sample(60), "only held out: ЖЖЖ"]
    rows = [(i, t) for i, t in enumerate(texts)]
    learn = F.col("doc_id") % 4 != 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, retained = brute(texts, [t for i, t in rows if i % 4 != 3])
    got = {r.doc_id: r.score for r in suffix_tree.score(df, learn).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-5)
    assert suffix_tree.contexts(df, learn) == retained


def test_untrained_tree_is_its_root(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree.score(df, F.lit(False)).collect()}
    assert got == pytest.approx({1: 4 * math.log10(1 / 256), 2: math.log10(1 / 256)}, rel=1e-5)


def test_more_text_retains_more_contexts(spark):
    """A phrase that occurs four times in a megabyte is learned, however much other text there is."""
    rng = np.random.default_rng(9)
    other = [" ".join("".join(x) for x in rng.choice(list("abcdefgh"), (400, 5))) for _ in range(400)]
    phrase = "zwölf boxkämpfer jagen viktor quer"
    rows = [(i, t) for i, t in enumerate([phrase] + other + 4 * [phrase])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.score(df, F.col("doc_id") > 0).where("doc_id = 0").first().score
    assert got > -0.35 * len(stream(phrase))
    few = sum(suffix_tree.contexts(df.where("doc_id <= 80"), F.lit(True)))
    assert sum(suffix_tree.contexts(df, F.lit(True))) > 2 * few
