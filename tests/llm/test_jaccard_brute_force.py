"""The Jaccard join against all pairs, with pairs that reach 75 % exactly, dense groups, null and repeated ids."""

import numpy as np
import pytest

from corpuslake.llm import jaccard


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row; a null id counts as one id, less than all others."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    key = lambda i: -1 if rows[i][0] is None else rows[i][0]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), key(i)), key(i))
    return sorted((key(i), len(s), least[find(i)]) for i, s in enumerate(sets))


def corpus():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    base = rng.choice(words, 60).tolist()
    rows = [None, "", " \t", "one two", "ONE two", "one two three"]
    a = [f"a{i}" for i in range(11)]  # 7 shingles
    rows += [" ".join(a), " ".join(a[:10]), " ".join([*a[:9], "x"])]
    b = [f"b{i}" for i in range(8)]  # 4 shingles against 3 of them: exactly 75 %
    rows += [" ".join(b), " ".join(b[:7]), " ".join(b[:6])]
    for changes in (0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8) * 5:
        w = list(base)
        for i in rng.integers(0, 60, changes):
            w[i] = f"c{rng.integers(0, 6)}"
        rows.append(" ".join(w[int(rng.integers(0, 4)) :]))
    rows += [" ".join(rng.choice(words, 30).tolist()) for _ in range(10)]
    return rows


@pytest.mark.parametrize("tile", [1024, 3])
def test_components_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    if tile == 3:  # all links come from the tiles
        monkeypatch.setattr(jaccard, "_stars", lambda classes, t: classes.selectExpr("cls AS a", "cls AS b").limit(0))
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    assert got == brute(rows)


def test_bitmaps_never_understate_overlap():
    rng = np.random.default_rng(2)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
        a, b = (np.sort(rng.choice(pool, int(rng.integers(1, 2500)), replace=False)) for _ in range(2))
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        x, y = jaccard.folded([x, y], min(len(x), len(y)))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))
