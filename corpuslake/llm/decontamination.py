"""Benchmark decontamination by suffix arrays over shards of the documents.

A shard is a few megabytes of documents.  Its suffix array orders all word positions that can
begin a match (a match has words of the benchmark only, so runs of other words are left out
before sorting); the suffixes of all benchmark items are then searched in it together by bisection, to
their first `size` words (whole items, where shorter).  The interval of the array gives all places of
a window, and windows that follow each other in item and text join into the longest verbatim matches.

The benchmark is looked at in blocks of at most BLOCK_WORDS words, each sent to the executors whole;
documents are read once for each block and are not shuffled while there is one block.

Cases: null text has no words; items without words are passed over; an empty table on either
side gives no hits; repeated items and documents are judged each; other columns are left out.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_chunks

#: Bound of the benchmark words that are sent to executors at once.
BLOCK_WORDS = 2_000_000
#: A-Z to a-z, other ASCII but digits and letters to a blank; bytes of other characters stay.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class SuffixArray:
    """Suffixes of an integer sequence ordered by their first `depth` symbols, by doubling; 0 ends a match."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.symbols, self.depth = symbols, depth
        n = len(symbols)
        rank, width = symbols.astype(np.int64), 1
        self.order = np.argsort(rank, kind="stable")
        while width < depth:
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - width)] = rank[width:]
            key = rank * (int(rank.max(initial=0)) + 2) + after
            self.order = np.argsort(key, kind="stable")
            held = key[self.order]
            rank = np.empty(n, dtype=np.int64)
            rank[self.order] = np.cumsum(np.concatenate(([1], held[1:] != held[:-1]))) if n else held
            width *= 2

    def intervals(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end index of the suffixes that begin with each pattern (rows, of `lengths` symbols), all bisected together."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), len(self.order), dtype=np.int64)
        for k in range(patterns.shape[1]):
            on = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(on):
                break
            c = patterns[on, k]
            first = self._bound(lo[on], hi[on], c, k, np.less)
            hi[on] = self._bound(first, hi[on], c, k, np.less_equal)
            lo[on] = first
        return lo, hi

    def _bound(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, k: int, goes_on) -> np.ndarray:
        a, b = a.copy(), b.copy()
        on = np.flatnonzero(a < b)
        while len(on):
            m = (a[on] + b[on]) // 2
            at = self.order[m] + k
            x = np.where(at < len(self.symbols), self.symbols[np.minimum(at, len(self.symbols) - 1)], 0)
            right = goes_on(x, c[on])
            a[on[right]] = m[right] + 1
            b[on[~right]] = m[~right]
            on = on[a[on] < b[on]]
        return a


def _blocks(bench: DataFrame) -> list[list[tuple[str, list[bytes]]]]:
    blocks, now = [[]], 0
    for r in bench.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        w = words_of((r["text"] or "").encode())
        if not w:
            continue
        if now + len(w) > BLOCK_WORDS and blocks[-1]:
            blocks.append([])
            now = 0
        blocks[-1].append(("" if r["item_id"] is None else r["item_id"], w))
        now += len(w)
    return blocks


class _Matcher:
    def __init__(self, items: list[tuple[str, list[bytes]]], size: int) -> None:
        self.names = [n for n, _ in items]
        vocabulary: dict[bytes, int] = {}
        self.items = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], dtype=np.int64) for _, ws in items]
        self.size, self.get = size, vocabulary.get
        self.least = min([size, *map(len, self.items)])
        #: Equal windows are searched once; owners are the (item, place in it) of each, in order of the windows.
        windows: dict[bytes, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            for a in range(max(1, len(item) - size + 1)):
                windows.setdefault(item[a : a + size].tobytes(), []).append((i, a))
        self.lengths = np.fromiter((len(w) // 8 for w in windows), dtype=np.int64, count=len(windows))
        self.patterns = np.full((len(windows), size), -1, dtype=np.int64)
        for row, w in zip(self.patterns, windows, strict=True):
            own = np.frombuffer(w, dtype=np.int64)
            row[: len(own)] = own
        self.many = np.fromiter(map(len, windows.values()), dtype=np.int64, count=len(windows))
        self.owners = np.array([o for x in windows.values() for o in x], dtype=np.int64).reshape(-1, 2)
        self.first = np.cumsum(self.many) - self.many

    def __call__(self, texts: list[bytes]):
        """(words of each text, hit words of each text, set of items of each text, (text, start, length, item) of the longest matches)."""
        lists = [words_of(t) for t in texts]
        count = np.array([len(x) for x in lists], dtype=np.int64)
        ids = np.zeros(int(count.sum()) + len(lists), dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(count + 1)))
        for x, a in zip(lists, starts, strict=False):
            ids[a : a + len(x)] = [self.get(w, 0) for w in x]
        #: Keep runs of benchmark words that are long enough, with one 0 after each.
        known = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
        edge = np.diff(known)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = b - a >= self.least
        a, b = a[long], b[long]
        found: list[set[int]] = [set() for _ in texts]
        matches: list[tuple[int, int, int, int]] = []
        depth = np.zeros(len(ids) + 1, dtype=np.int64)
        if len(a):
            size = b - a + 1
            at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            held = np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], 0)
            array = SuffixArray(held, self.size)
            lo, hi = array.intervals(self.patterns, self.lengths)
            w = np.flatnonzero(hi > lo)
            many = (hi - lo)[w]
            window = np.repeat(w, many)
            place = at[array.order[np.repeat(lo[w] - (np.cumsum(many) - many), many) + np.arange(many.sum())]]
            np.add.at(depth, place, 1)
            np.add.at(depth, place + self.lengths[window], -1)
            matches = self._longest(window, place, starts)
            for d, _, _, i in matches:
                found[d].add(i)
        sums = np.concatenate(([0], np.cumsum(np.cumsum(depth)[:-1] > 0)))
        return count, sums[starts[1:]] - sums[starts[:-1]], found, matches

    def _longest(self, window: np.ndarray, place: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Windows of an item that follow each other in item and text are one match, as long as it can be."""
        if not len(window):
            return []
        many = self.many[window]
        o = self.owners[np.repeat(self.first[window] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        place, length = np.repeat(place, many), np.repeat(self.lengths[window], many)
        item, shift = o[:, 0], place - o[:, 1]
        order = np.lexsort((place, shift, item))
        item, shift, place, length = item[order], shift[order], place[order], length[order]
        new = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] != place[:-1] + 1))))
        last = np.append(new[1:], len(item)) - 1
        doc = np.searchsorted(starts, place[new], "right") - 1
        size = place[last] + length[last] - place[new]
        return list(zip(doc.tolist(), (place[new] - starts[doc]).tolist(), size.tolist(), item[new].tolist(), strict=True))


def matches(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids as strings of the items that occur) and spans, the
    longest verbatim matches: first word, number of words, item."""
    #: Each block of items adds to the rows that the blocks before it return, so rows need no key.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.lit(None).cast(t).alias(c) for c, t in _FOUND.items()))
    for items in _blocks(bench):

        def run(batches, items=items):
            m = _Matcher(items, size)
            for batch, texts in text_chunks(batches, 8 << 20):
                n, hit, names, where = m(texts)
                spans = [x or [] for x in batch.column("spans").to_pylist()]
                before = [bool(x) for x in spans]
                for d, p, k, i in where:
                    spans[d].append({"start": p, "length": k, "item": m.names[i]})
                for d in {x[0] for x in where}:
                    if before[d]:  # hit words of several blocks count once
                        hit[d] = len(set().union(*(range(x["start"], x["start"] + x["length"]) for x in spans[d])))
                hit = [h if h or not old else old for h, old in zip(hit.tolist(), batch.column("n_hit").to_pylist(), strict=True)]
                names = [sorted({m.names[i] for i in f} | set(old or [])) for f, old in zip(names, batch.column("items").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string())])))],
                    names=["doc_id", "text", *_FOUND],
                )

        found = map_arrow(found, run, found.schema)
    return found.drop("text")


_FOUND = {"n_words": "long", "n_hit": "long", "items": "array<string>", "spans": "array<struct<start:long,length:long,item:string>>"}


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """The documents without those in which a window of the benchmark occurs; all columns stay."""
    blocks = _blocks(bench)
    for items in blocks:

        def clean(batches, items=items):
            m = _Matcher(items, size)
            for batch, texts in text_chunks(batches, 8 << 20):
                yield batch.filter(pa.array(m(texts)[1] == 0))

        docs = map_arrow(docs, clean, docs.schema)
    return docs


