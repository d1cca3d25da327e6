"""Decontamination against all windows: hits, items and longest matches, with short items and repeated words."""

import numpy as np

from corpuslake.llm import decontamination as D


def brute(texts, items, size):
    out = []
    for t in texts:
        w, hit, names, spans = D.words_of((t or "").encode()), set(), set(), set()
        for name, it in items:
            x = D.words_of((it or "").encode())
            if not x:
                continue
            k = min(size, len(x))
            pairs = {(p, q) for q in range(len(x) - k + 1) for p in range(len(w) - k + 1) if w[p : p + k] == x[q : q + k]}
            for p, q in pairs:
                hit |= set(range(p, p + k))
                names.add(name)
                if (p - 1, q - 1) not in pairs:
                    n = 0
                    while (p + n, q + n) in pairs:
                        n += 1
                    spans.add((p, n - 1 + k, name))
        out.append((len(w), len(hit), sorted(names), sorted(spans)))
    return out


def test_equals_all_windows(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ä", "x-y"]
    items = [(f"i{n}", " ".join(rng.choice(vocabulary, int(rng.integers(1, 30))).tolist())) for n in range(25)] + [("none", None), ("empty", "  ")]
    texts = [None, "", *(" ".join(rng.choice(vocabulary, int(rng.integers(1, 200))).tolist()) for _ in range(40))]
    texts += [f"start {items[n][1].upper()}, {items[n + 1][1]} end" for n in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), sorted({(s.start, s.length, s["item"]) for s in r.spans})) for r in D.matches(docs, bench, 4).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, items, 4)


def test_many_items_are_quick():
    """Text of benchmark words alone, 2,000 items: searched in seconds, not minutes."""
    import time

    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(3000)])
    items = [(str(n), D.words_of(" ".join(rng.choice(words, 50)).encode())) for n in range(2000)]
    matcher = D._Matcher(items, 10)
    texts = [" ".join(rng.choice(words, 1000)).encode() for _ in range(400)]
    began = time.process_time()
    matcher(texts)
    assert time.process_time() - began < 30
