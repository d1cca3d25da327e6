"""Operators against sequential versions and literal cases."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.functions.unicode import dedup_key, normal_document, normalize_text, strip_html
from corpuslake.operators import blocks, clean, generate, near, qa, sampling, telemetry
from corpuslake.operators import conversations as C
from corpuslake.sources import files, sinks, wiki


def test_native_and_python_normalisation_agree(spark):
    texts = ["a  \r\nb\rc\n\n\n\nd\x0be ", "﻿x", "<p>a</p>b &amp;lt;", "é ", "", "a\x1cb \x1f\nc", "word\n" * 30 + "All rights reserved 2020\nmore", "All rights reserved\n" + "word\n" * 30, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_text(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [normal_document(t) for t in texts]
    assert normal_document("x *** y\n*** START OF THE PROJECT GUTENBERG EBOOK A ***\nbody\n*** END OF THIS PROJECT GUTENBERG EBOOK A ***\nz") == "body"
    got = spark.createDataFrame([("plain",), ("<div>a<br/>b<script>x</script></div>",), (None,)], "t string").select(strip_html(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["plain", "\na\nb\n", None]


def sequential(rows, distance):
    kept, out = [], {}
    for o, sha, fp in sorted(rows):
        if any(s == sha for _, s, _ in kept):
            out[o] = "exact"
        elif any((f ^ fp).bit_count() <= distance and any((f ^ fp) >> s & ((1 << w) - 1) == 0 for s, w in near.BANDS) for _, _, f in kept):
            out[o] = "near"
        else:
            kept.append((o, sha, fp))
            out[o] = "kept"
    return out


@pytest.mark.parametrize("distance", [0, 2, 5])
def test_near_duplicates_equal_sequential_rule(spark, distance):
    rng = np.random.default_rng(distance)
    rows, base = [], [int(x) for x in rng.integers(0, 1 << 63, 6)]
    for o in range(120):
        fp = base[int(rng.integers(0, 6))]
        for b in rng.integers(0, 64, int(rng.integers(0, 5))):
            fp ^= 1 << int(b)
        rows.append((o, f"t{fp}{rng.integers(0, 2)}", fp))
    signed = [(o, s, f - (1 << 64) if f >> 63 else f) for o, s, f in rows]
    got = near.dedup(spark.createDataFrame(signed, "ord long, sha string, fp long"), distance)
    assert {r.ord: r.verdict for r in got.collect()} == sequential(rows, distance)


def test_chain_keeps_both_ends(spark):
    rows = [(1, "a", 0), (2, "b", 0b11), (3, "c", 0b1111)]
    got = near.dedup(spark.createDataFrame(rows, "ord long, sha string, fp long"), 2)
    assert {r.ord: r.verdict for r in got.collect()} == {1: "kept", 2: "near", 3: "kept"}
    assert near.fingerprint(["a"] * 4) == 0


def test_blocks_pairs_and_files(spark):
    docs = spark.createDataFrame([(i, " ".join(["x" * (i % 5 + 1)] * (i % 9))) for i in range(60)], "doc_id long, text string").repartition(4)
    got = blocks.blocks(docs, blocks.word_ids(F.col("text")), 7)
    flat = [x for i in range(60) for x in [i % 5 + 11] * (i % 9) + [1]]
    want = [flat[a : a + 7] for a in range(0, len(flat) - 6, 7)]
    assert [list(r.tokens) for r in got.orderBy("block").collect()] == want
    assert [(list(r.inputs), list(r.targets)) for r in blocks.pairs(got).orderBy("block").collect()] == [(w[:-1], w[1:]) for w in want]
    data = blocks.packed(got)
    assert bytes(data.orderBy("block").first().data) == np.array(want[0], dtype="<u2").tobytes()
    assert [list(r.tokens) for r in blocks.unpacked(data, 7).orderBy("block").collect()] == want
    with pytest.raises(Exception, match="bytes"):
        blocks.unpacked(data, 8).collect()
    with pytest.raises(ValueError):
        blocks.prepare(docs.withColumn("lang", F.lit("en")), blocks.word_ids(F.col("text")), 1.5)


def test_split_sizes(spark):
    assert [clean.validation_count(n, 0.01) for n in (1, 2, 50, 150, 250)] == [0, 1, 1, 2, 2]
    rows = spark.createDataFrame([("a b c d e f g h i j",), ("one",), (" x  y ",)], "t string").select(clean.single_record_split(F.col("t"), 0.2).alias("s")).collect()
    assert [(r.s.train, r.s.validation) for r in rows] == [("a b c d e f g h", "i j"), ("one", None), ("x", "y")]


def test_lenient_reader_counts_bad_records(spark, tmp_path):
    (tmp_path / "rsd").mkdir()
    (tmp_path / "rsd" / "a.txt").write_bytes("﻿Grüße".encode())
    (tmp_path / "b.txt").write_bytes(b"bad \xff\xfe utf")
    lines = ['{"text": "one", "title": "T", "source_id": "s"}', '"two"', "", "{broken", '{"text": 3}', '{"text": "three"}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    (tmp_path / "raw_manifest.json").write_text("{}")
    rows, bad = files.read_lenient(spark, str(tmp_path))
    assert sorted((r.text, r.source_id, r.title) for r in rows.collect()) == [("Grüße", "rsd_public_domain", None), ("one", "s", "T"), ("three", "c", None), ("two", "c", None)]
    assert Counter(r.source_path for r in bad.collect()) == {"b.txt": 1, "c.jsonl": 2}
    assert [r.path.split("/")[-1] for r in files.find(spark, str(tmp_path)).collect()] == ["b.txt", "c.jsonl", "a.txt"]
    with pytest.raises(Exception, match="bad UTF-8|no text"):
        files.records(spark, str(tmp_path)).collect()


def test_strict_records(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\n\nsecond line\nmore\n \nthird")
    (tmp_path / "b.txt").write_text("one\ntwo\n\x20")
    (tmp_path / "c.jsonl").write_text('"one"\n{"text": " four ", "language": "en"}\n')
    got = files.records(spark, str(tmp_path))
    assert Counter(r.text for r in got.collect()) == Counter(["first", "second line\nmore", "third", "one", "two", "one", "four"])
    once = {r.text: r.copies for r in files.distinct_records(got).collect()}
    assert once["one"] == 2 and len(once) == 6


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "corpus")
    rows = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "ord long, text string, title string")
    sinks.write_jsonl(rows, out, "ord")
    assert sorted(json.loads(r.value)["text"] for r in spark.read.text(out).collect()) == ["a", "b"]
    assert sum(r.examples for r in sinks.file_facts(spark, out).collect()) == 2
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_jsonl(rows, out)
    old, new = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "id string, n int, keep int"), spark.createDataFrame([("b", 9), ("c", 3)], "id string, n int")
    assert sorted(map(tuple, sinks.upsert(old, new, "id").collect())) == [("a", 1, 5), ("b", 9, 6), ("c", 3, None)]


def test_wiki(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns>{}<revision><text>{}</text></revision></page>"
    body = "'''Bold''' [[Target|shown]] {{t|{{x}}}}<ref>no</ref> [[File:a.png|c]] == Head ==\n" + "word " * 80
    dump = "<mediawiki>" + page.format("A b (c)", 0, "", body.replace("<", "&lt;")) + page.format("T", 1, "", "x") + page.format("R", 0, '<redirect title="A"/>', "y") + page.format("S", 0, "", "short") + "</mediawiki>"
    (tmp_path / "simplewiki-1.xml").write_text(dump)
    pages = wiki.read_pages(spark, str(tmp_path / "simplewiki-1.xml"))
    assert {r.verdict: r.pages for r in wiki.counts(pages).collect()} == {"kept": 1, "namespace": 1, "redirect": 1, "short": 1}
    row = wiki.articles(pages, "simplewiki").first()
    assert row.text.startswith("A b (c)\nBold shown") and "no" not in row.text.split() and row.source_url.endswith("/A_b_(c)")


def gate_by_gate(convs):
    counts, seen, keys, out = Counter(), set(), set(), {}
    for i, m in convs:
        roles = ",".join(r for r, _ in m)
        key = lambda t: " ".join(t.lower().split())
        users, said = [key(t) for r, t in m if r == "user"], [key(t) for r, t in m if r == "assistant"]
        ck = "\n".join(f"{r}:{key(t)}" for r, t in m)
        import re

        if not re.fullmatch(C.TURN_ORDER[1:-1], roles):
            out[i] = "invalid_turn_order"
        elif any(not k or counts[k] >= 8 for k in users):
            out[i] = "repeated_user_prompt_cap"
        elif any("@" in t for _, t in m):
            out[i] = "pii_or_secret"
        elif any(not k for k in said):
            out[i] = "empty_assistant"
        elif len(set(said)) < len(said):
            out[i] = "repeated_turn_in_conversation"
        elif ck in keys:
            out[i] = "duplicate_conversation"
        elif seen & set(said):
            out[i] = "duplicate_assistant_response"
        else:
            out[i] = None
            keys.add(ck)
            seen |= set(said)
            counts.update(users)
    return out


def test_gates_equal_sequential_rule(spark):
    rng = np.random.default_rng(5)
    convs = []
    for i in range(220):
        m = []
        for _ in range(int(rng.integers(1, 3))):
            m += [("user", f"P{rng.integers(0, 6)}"), ("assistant", f"A{rng.integers(0, 90)}")]
        if rng.random() < 0.1:
            m = m[:-1]
        if rng.random() < 0.1:
            m[0] = ("user", ["", "mail me at a.b@example.org"][int(rng.integers(0, 2))])
        convs.append((i, list(convs[int(rng.integers(0, i))][1]) if i and rng.random() < 0.25 else m))
    rows = [(i, n, r, t) for i, m in convs for n, (r, t) in enumerate(m)]
    got = C.gates(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: r.reason for r in got.collect()} == gate_by_gate(convs)


def test_style_and_templates(spark):
    texts = ["Короткий ответ: да, верно", "iOS works", "hello", "Если кратко — Париж.", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(C.clean_style(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == ["Да, верно", "iOS works", "Hello", "Париж.", ""]
    got = spark.createDataFrame([("a 12 b3 -4,5 x",)], "t string").select(T.template(F.col("t")).alias("c")).first()
    assert got.c == "a {N} b3 {N} x"
    assert [r.k for r in spark.createDataFrame([(" ＡB  straße\n",)], "t string").select(dedup_key(F.col("t")).alias("k")).collect()] == ["ab strasse"]


def test_sampling_and_logs(spark):
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate([2.0, 1.0, 0.0, -1.0])], "vec_id long, token long, score double")
    assert sorted(r.token for r in sampling.nucleus(s, 0.7).collect()) == [0, 1]
    p = sampling.penalize(s, s.where("token IN (0, 3)").unionByName(s.where("token = 0")), 2.0).orderBy("token").collect()
    assert [r.score for r in p] == [1.0, 1.0, 0.0, -2.0]
    assert sampling.heat(s, 0).collect()[0].token == 0
    lines = spark.createDataFrame([(1, '{"step": 1, "validation_loss": 3.0}'), (2, "{broken"), (3, '{"step": 1, "validation_loss": 2.0}'), (4, '{"step": 9, "validation_loss": 1}'), (5, '{"step": 2}')], "line long, value string")
    assert [tuple(r) for r in telemetry.resume(lines, 5).collect()] == [(1, 2.0)]
    assert telemetry.parameters(32000, 512, 1408, 8) == 32000 * 512 + 8 * (4 * 512**2 + 3 * 512 * 1408 + 1024) + 512


def test_questions(spark):
    items = [("f", 1, "Who wrote the long winding book?", "Ann", ["wdt:P50"], ["Q1"]), ("f", 2, "who wrote the long winding book", "Ann", ["wdt:P50"], ["Q1"]), ("f", 3, "Who wrote the long winding book?!", "Bob", ["wdt:P50"], ["Q1"]), ("g", 4, "Who wrote the long winding boot?", "Cid", [], [])]
    df = spark.createDataFrame(items, "file string, uid long, question string, answer string, props array<string>, uris array<string>")
    assert {r.uid: r.verdict for r in qa.first_questions(df).collect()} == {1: "kept", 2: "duplicate", 3: "conflict", 4: "kept"}
    assert sorted((r.uid_a, r.uid_b) for r in qa.near_questions(df).collect()) == [(1, 4), (2, 4), (3, 4)]
    assert qa.stratified(df, 3).count() == 3
    assert [(r.fact, r.answers) for r in qa.fact_conflicts(df).collect()] == [("Q1|wdt:P50", "ann|bob")]


def test_expressions(spark):
    cases = [("2+3", 5), ("2−5", -3), ("4×6", 24), ("8÷2", 4), ("7÷2", None), ("7÷0", None), ("x", None)]
    got = spark.createDataFrame([(a,) for a, _ in cases], "t string").select(generate.expression_value(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [b for _, b in cases]


def test_streams(spark, tmp_path):
    from corpuslake.streaming import streams

    prose = " ".join(f"the {a} {b} was seen" for a in ("red", "green", "blue", "old", "new", "small") for b in ("house", "river", "garden", "window", "street", "bridge"))
    rows = [{"doc_id": i, "text": t, "at": "2024-01-01T00:00:00"} for i, t in enumerate([prose, prose, "short", prose + " again"])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    query = streams.write(streams.cleaned(streams.documents(spark, str(tmp_path / "in"))).select("doc_id", "sha"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) in ([0, 3], [1, 3])


def test_tokenizers_take_runs_of_bounded_size(spark, monkeypatch):
    """However many texts an Arrow batch brings, few are encoded at once: what a tokenizer holds is some hundred times as large."""
    import public_tokenizers
    import pyarrow as pa

    path, runs, taken = public_tokenizers.path("byte_bpe_50k.json"), [], []
    real = blocks._tokenizer(path)

    class Counting:
        def encode_batch_fast(self, texts, **more):
            taken.append(sum(len(str(t)) for t in texts))
            return real.encode_batch_fast([str(t) for t in texts], **more)

    monkeypatch.setattr(blocks, "_tokenizer", lambda _: Counting())
    for name in ("pandas_udf", "arrow_udf"):
        monkeypatch.setattr(F, name, lambda run, kind: lambda column: runs.append(run))
    blocks.encode(F.col("text"), path)
    texts = ["word " * 400] * 500 + ["long " * 100_000, "end"]
    found = runs[0](pa.array(texts))
    assert sum(taken) == sum(map(len, texts)) and max(taken) == 500_000 and sorted([0, *taken])[-2] <= 1 << 18
    assert [len(x) for x in found.to_pylist()[-3:]] == [len(real.encode(t).ids) for t in texts[-3:]]


def test_texts_to_ids_and_back(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "a b", "﻿цвет\x00 <|endoftext|> é", *(f"row {i} " * 300 for i in range(400)), "x" * 300_000]
    tokenizer = Tokenizer.from_file(path)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    both = docs.select("doc_id", "text", blocks.encode(F.col("text"), path, 7, 2).alias("ids"), blocks.round_trip(F.col("text"), path).alias("r"))
    got = both.select("*", blocks.decode(F.slice("ids", F.lit(2), F.size("ids") - 2), path).alias("back")).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [[7, *x, 2] for x in ids]
    backs = [tokenizer.decode(x) for x in ids]
    assert [r.back for r in got] == backs
    assert [tuple(r.r) for r in got] == [(len(x), b == (t or "")) for x, b, t in zip(ids, backs, texts, strict=True)]
    assert spark.createDataFrame([(None,)], "ids array<int>").select(blocks.decode(F.col("ids"), path)).first()[0] == ""
