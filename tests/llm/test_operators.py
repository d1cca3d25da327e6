"""Operators against brute force on small fixtures with nulls, empty texts, repeats and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import codec, compression, decontamination, jaccard, packing, pii, substrings, suffix_tree, topk
from corpuslake.llm.tokens import encoder, tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def texts():
    rng = np.random.default_rng(7)
    long = " ".join(rng.choice(WORDS, 400).tolist())
    unique = [" ".join(f"w{i}x{j}" for j in range(120)) for i in range(4)]
    near = unique[0].split()
    near[5] = "changed"
    return [None, "", "   ", "one two", "One two", unique[0], unique[0], " ".join(near), unique[1] + " " + " ".join(unique[0].split()[10:90]), unique[2], long, unique[3] * 3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", 1, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")


def words(t):
    return (t or "").encode().split()


def test_packing_is_whole_and_gapless(docs):
    got = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=64).toPandas().sort_values(["sequence_id", "offset"])
    enc = encoder(tokenizer_path("byte_bpe_50k.json"), True)
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 64
    for d, g in got.sort_values("piece").groupby("doc_id"):
        ids = np.append(enc._whole(texts()[d] or ""), 2).astype("<u4")
        assert g["length"].sum() == len(ids)
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in g.itertuples()] == g["ids_crc32"].tolist()


def test_plan_places_every_item_once():
    counts = {700: 3, 500: 4, 342: 5, 341: 7, 100: 20, 1: 9}
    bins = packing.plan(counts, 1024)
    held = Counter()
    for b in bins:
        assert sum(n for n, _ in b.items) + b.gap == 1024
        for n, _ in b.items:
            held[n] += b.count
    assert held == counts


def test_codec_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 2, 2047, 2048, 2049, 5000):
        x = np.minimum(rng.zipf(1.2, n), 65535)
        assert (codec.decode_ids(codec.encode_ids(x)) == x).all()
    assert len(codec.decode_ids(b"")) == 0
    data = bytearray(codec.encode_ids(np.arange(100)))
    data[30] ^= 255
    with pytest.raises(ValueError):
        codec.decode_ids(bytes(data))


def test_codec_starts(docs):
    got = codec.read(codec.write(docs, tokenizer_path("word_bpe_49k.json"))).orderBy("doc_id").toPandas()
    assert got["start"].tolist() == (got["n_tokens"].cumsum() - got["n_tokens"]).tolist()
    assert len(got) == len(texts()) and got["n_tokens"][0] == 1


def test_suffix_tree_base(docs):
    got = {r.doc_id: r for r in suffix_tree.score(docs, F.col("doc_id") % 3 != 0).collect()}
    tok = lambda t: words((t or "").lower()) + [0]
    c = Counter(w for i, t in enumerate(texts()) if i % 3 for w in tok(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts()):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tok(t)), sum(w in c for w in tok(t)), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), rel_tol=1e-9)
        assert r.score < 0


def test_pii(spark):
    t = "Mail a.b@c.de now, card 4111 1111 1111 1111, ip 1.2.3.4 or 1.2.3.400, call +49 (30) 1234567-8; IBAN DE89 3704 0044 0532 0130 00."
    rows = [(1, t, "mine"), (2, None, "mine"), (3, "", "mine"), (4, "9" * 5000 + " clean", "mine")]
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string, start string")).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()
    want = [("email", "a.b@c.de"), ("card", "4111 1111 1111 1111"), ("ip", "1.2.3.4"), ("phone", "+49 (30) 1234567-8"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert got[0].s == ",".join(f"{k}:{t.index(x)}:{t.index(x) + len(x)}" for k, x in want)
    assert [r.s for r in got[1:]] == ["", "", ""]
    red = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, start string")).collect()
    assert red[0].text.startswith("Mail [EMAIL] now, card [CARD], ip [IP]") and red[1].text is None


def test_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(40, None), (60, [float("nan")] * 8), (7, [1.0] * 8)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20, k=5).collect()
    fine = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and np.isfinite(v).all()]
    for q, (i, v) in enumerate(fine):
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for p, (j, w) in enumerate(fine) if p != q)[:5]
            assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == best


@pytest.mark.parametrize("many", [512, 1])
def test_substrings(docs, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY", many)
    got = {r.doc_id: r for r in substrings.removed(docs, 50).collect()}
    first = {}
    for i, t in enumerate(texts()):
        w = words(t)
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)
    for i, t in enumerate(texts()):
        w = words(t)
        stay = [True] * len(w)
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < i:
                stay[a : a + 50] = [False] * 50
        kept = b" ".join(x for x, s in zip(w, stay, strict=True) if s)
        assert (got[i].n_words, got[i].kept_sha256) == (len(w), hashlib.sha256(kept).hexdigest())


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([("a", " ".join(texts()[9].split()[20:40])), ("b", "one TWO"), ("c", None), ("d", "w1x5")], "item_id string, text string")
    got = {r.doc_id: r for r in decontamination.matches(docs, bench).collect()}
    assert got[9]["items"] == ["a"] and got[9].n_hit == 20
    assert got[3]["items"] == got[4]["items"] == ["b"] and got[8]["items"] == ["d"] and got[0].n_words == 0
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == {i for i, r in got.items() if not r.n_hit}
    assert decontamination.matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_jaccard(docs):
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got[6] == got[7] == got[5] == 5 and got[4] == got[3] == 3
    assert all(got[i] == i for i in (0, 1, 2, 8, 9, 10, 11))
    assert {r.doc_id for r in jaccard.near_duplicates(docs).collect()} == {i for i, c in got.items() if i == c}
    assert jaccard.join(docs.limit(0)).count() == 0


def test_classifier_separates_held_out_texts(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(240):
        w = rng.choice(WORDS, 60).tolist()
        if i % 2:
            w[::6] = ["AWFUL"] * 10
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, y int")
    for settings in (compression.TOXICITY, compression.QUALITY):
        got = {r.doc_id: r.score for r in compression.score(docs, compression.train(docs, y.where("doc_id < 160"), settings)).collect()}
        assert sum((got[i] >= 0.5) == bool(i % 2) for i in range(160, 240)) >= 76
        assert 0 <= got[1000] <= 1 and 0 <= got[1001] <= 1
    assert compression.train(docs, y.limit(0), compression.QUALITY).prior == 0.5
