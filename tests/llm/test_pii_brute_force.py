"""Base spans of personal data against plain regular expressions, over random and awkward texts."""

import hashlib
import re

import numpy as np

from corpuslake.llm import pii

KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def fits(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def base(text):
    found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if fits(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_base_spans_equal_plain_patterns(spark):
    rng = np.random.default_rng(6)
    parts = ["a.b@c.de", "x@y", "@", "me@a-b.c-d.e.", "1.2.3.4", "1.2.3.400", "10.0.0.1.5", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111 1111 1111 1112", "5500000000000004", "+49 (30) 1234567-8", "+1", "+1 555 010 0199", "++49 30 123456789", "12", "0007.1.1.1", "é", "日本 ", "card", "-", ".", " ", "\n", "a" * 70 + "@b.cc", "9" * 25]
    texts = [None, "", *("".join(rng.choice(parts, int(rng.integers(1, 12)))) for _ in range(600))]
    texts.append(" ".join(f"u{i}@m{i}.org 4111 1111 1111 1111" for i in range(300)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = pii.F.filter("spans", lambda s: s["rank"] < len(pii.BASE))
    got = {r.doc_id: r.s for r in pii.find_spans(df).select("doc_id", pii.written(kept).alias("s")).collect()}
    wrong = [(t, got[i], base(t)) for i, t in enumerate(texts) if hashlib.sha256(got[i].encode()).digest() != hashlib.sha256(base(t).encode()).digest()]
    assert not wrong, wrong[:3]
