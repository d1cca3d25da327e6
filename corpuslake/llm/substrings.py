"""Removal of word passages that an earlier document has, by FM-indexes over shards of segments.

A window is `size` consecutive words.  Its anchor is the leftmost of its ANCHOR-word grams with the least
hash, so equal windows have equal anchors; consecutive windows with one anchor form a segment, and
segments are dealt to shards by the hash of their anchor.  Equal windows thus meet in one shard, and
nothing needs to be searched elsewhere.  Segments whose anchor occurs once are left out.

A shard lays its different segments end to end and keeps the Burrows-Wheeler transform of their words in
a wavelet matrix of packed bits with counts per word of 64 bits.  Backward search, for all segments
of the shard in step, finds the longest match before every end with a range of suffixes among whose
documents one is earlier; matches of `size` words or more are the intervals reported.

An anchor with more than MANY different segments could fill a shard, so its different segments are cut
into single windows, of which those that several documents have go to shards by their own hash.  Windows
travel as packed records; each task names the least documents of a window before anything is shuffled, and
what was found is told to the windows bucket by bucket, so a hot window needs no task of its own.

Windows are judged on the input.  Cases: null and empty texts have no words; texts shorter than a window
lose none; a document's own repeats stay, and rows with equal doc_id are not earlier than each
other; a null doc_id counts as less than all others; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WordHasher, gram_hashes, map_arrow, mix, partitions, stash, text_chunks

ANCHOR = 8
#: Different segments of an anchor that may share a shard.
MANY = 512
#: Words of a shard, about.
SHARD_WORDS = 200_000
#: Windows of hot anchors in a bucket, about.
BUCKET_WINDOWS = 2_000_000
NO_ID, NEVER = -(1 << 63), (1 << 63) - 1
#: Rows of groups that may be sent to every executor, and tasks for the segments of one group beyond that.
SMALL, SALTS = 200_000, 16
_SEG = np.dtype([("a", "<u8"), ("g", "<u8"), ("d", "<i8"), ("i", "<u4"), ("n", "<u4")])
_WINDOW = np.dtype([("w", "<i8"), ("g", "<i8"), ("d", "<i8"), ("second", "<i8"), ("i", "<u4"), ("n", "<u4"), ("rel", "<u4")])
_FIRST = np.dtype([("w", "<i8"), ("d", "<i8"), ("second", "<i8"), ("i", "<i8")])
_HIT = np.dtype([("g", "<i8"), ("rel", "<u4"), ("d", "<i8"), ("i", "<u4"), ("n", "<u4"), ("own", "?"), ("copied", "?")])


class _Hashed:
    """Word hashes of a chunk, with prefix sums for the hash of any run of words."""

    BASE = 0xC2B2AE3D27D4EB4F

    def __init__(self, texts: list[bytes], hasher: WordHasher) -> None:
        self.words, self.first, *_ = hasher(texts)
        n = len(self.words)
        if not hasattr(hasher, "runs") or len(hasher.runs[0]) <= n:
            inv, size = pow(self.BASE, -1, 1 << 64), max(n + 1, 1 << 20)
            tables = []
            for x in (self.BASE, inv):
                p = np.full(size, x, dtype=np.uint64)
                p[0] = 1
                tables.append(np.multiply.accumulate(p))
            hasher.runs = tables
        up, self.down = hasher.runs
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * up[:n], dtype=np.uint64)))

    def run(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of the n words from a on."""
        return mix((self.sums[a + n] - self.sums[a]) * self.down[a] + n.astype(np.uint64))


def _segments(h: _Hashed, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word in the chunk, number of words, anchor hash) of the segments."""
    none = np.zeros(0, dtype=np.int64)
    grams = gram_hashes(h.words, ANCHOR)
    span = size - ANCHOR + 1
    if len(grams) < span:
        return none, none, none, none.astype(np.uint64)
    #: The index of a gram takes the low bits of its key, so windows are taken in blocks of fewer than 2**24 grams.
    low, block = np.uint64((1 << 24) - 1), (1 << 24) - span
    parts = []
    for a in range(0, len(grams) - span + 1, block):
        g = grams[a : a + block + span - 1]
        key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        parts.append((key & low).astype(np.int64) + a)
    at = np.concatenate(parts)
    starts = np.arange(len(at))
    doc = np.searchsorted(h.first, starts, side="right") - 1
    ok = starts + size <= h.first[doc + 1]
    starts, doc, at = starts[ok], doc[ok], at[ok]
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    many = np.diff(np.append(new, len(starts)))
    return doc[new], starts[new], many + size - 1, grams[at[new]]


def _anchors(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    def run(batches):
        hasher = WordHasher(SPACES)
        for batch, texts in text_chunks(batches):
            h = _Hashed(texts, hasher)
            doc, at, n, a = _segments(h, size)
            rec = np.empty(len(doc), dtype=_SEG)
            rec["a"], rec["g"], rec["i"], rec["n"] = a, h.run(at, n), at - h.first[doc], n
            rec["d"] = np.array(batch.column("doc_id").to_pylist(), dtype=np.int64)[doc] if len(doc) else 0
            yield _packed(rec, a % np.uint64(buckets), buckets)

    return map_arrow(docs, run, "bucket int, data binary")


def _candidates(anchors: DataFrame, buckets: int) -> DataFrame:
    """Segments of anchors that several documents have.

    `lead`: the first row of a content, in its least document; `copy`: in a later document; neither: the
    least document has the content again.  `second`: the least document that has a copy; `hot`: the anchor has many different segments.
    """

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, d in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                held.setdefault(b, []).append(d)
        for parts in held.values():
            x = np.frombuffer(b"".join(parts), dtype=_SEG)
            parts.clear()
            o = np.argsort(x["a"], kind="stable")
            same = x["a"][o][1:] == x["a"][o][:-1]
            x = x[o][np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            if not len(x):
                continue
            x = x[np.lexsort((x["i"], x["d"], x["g"], x["a"]))]
            start = np.concatenate(([True], x["a"][1:] != x["a"][:-1]))
            lead = start | np.concatenate(([True], x["g"][1:] != x["g"][:-1]))
            group, content = np.cumsum(start) - 1, np.cumsum(lead) - 1
            docs_least = np.minimum.reduceat(x["d"], np.flatnonzero(start))
            docs_most = np.maximum.reduceat(x["d"], np.flatnonzero(start))
            kinds = np.bincount(group, weights=lead).astype(np.int64)
            own = x["d"][np.flatnonzero(lead)][content]
            copy = x["d"] > own
            first_copy = np.full(content[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(first_copy, content[copy], x["d"][copy])
            keep = (docs_least < docs_most)[group]
            cols = [x["d"], x["i"].astype(np.int64), x["n"].astype(np.int64), np.ascontiguousarray(x["a"]).view(np.int64), np.ascontiguousarray(x["g"]).view(np.int64), copy, lead, first_copy[content], kinds[group] > MANY]
            for a in range(0, len(x), 100_000):
                k = keep[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[a : a + 100_000][k])) for c in cols], names=["d", "i", "n", "a", "g", "copy", "lead", "second", "hot"])

    return map_arrow(anchors.repartition(buckets, "bucket"), run, "d long, i long, n long, a long, g long, copy boolean, lead boolean, second long, hot boolean")


def _contents(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The words of wanted segments (d, i, n, g, second, a)."""
    own = wanted.groupBy("d").agg(F.collect_list(F.struct("i", "n", "g", "second", "a")).alias("segments"))

    def run(batches):
        hasher = WordHasher(SPACES)
        for batch, texts in text_chunks(batches):
            h = _Hashed(texts, hasher)
            out: list[list] = [[] for _ in range(7)]
            for t, d, segments, a, b in zip(texts, batch.column("d").to_pylist(), batch.column("segments").to_pylist(), h.first[:-1].tolist(), h.first[1:].tolist(), strict=True):
                words = t.split()
                fits = [s for s in segments if s["i"] + s["n"] <= b - a]
                if not fits:
                    continue
                at, n = (np.array([s[k] for s in fits], dtype=np.int64) for k in ("i", "n"))
                true = h.run(at + a, n).view(np.int64).tolist()  # rows with equal doc_id may have other texts
                for s, g in zip(fits, true, strict=True):
                    if g != s["g"]:
                        continue
                    for col, x in zip(out, (d, s["i"], s["n"], g, s["second"], s["a"], b" ".join(words[s["i"] : s["i"] + s["n"]])), strict=True):
                        col.append(x)
            types = (pa.int64(),) * 6 + (pa.binary(),)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["d", "i", "n", "g", "second", "a", "words"])

    both = docs.join(own, docs["doc_id"] == own["d"]).select("d", "segments", "text")
    return map_arrow(both, run, "d long, i long, n long, g long, second long, a long, words binary")


class WaveletMatrix:
    """Rank of symbols in a sequence: a packed bit vector for each bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels = []
        s = symbols.astype(np.int64)
        for l in range(self.bits - 1, -1, -1):
            bit = (s >> l) & 1
            padded = np.zeros(-(-(len(s) + 1) // 64) * 64, dtype=np.uint8)
            padded[: len(s)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))[:-1]
            self.levels.append((words, before, len(s) - int(bit.sum())))
            s = np.concatenate((s[bit == 0], s[bit == 1]))
        self.base = self._follow(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _follow(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for l, (words, before, zeros) in enumerate(self.levels):
            w = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[w] + np.bitwise_count(words[w] & mask).astype(np.int64)
            i = np.where((c >> (self.bits - 1 - l)) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before position i."""
        return self._follow(c, i) - self.base[c]


class FMIndex:
    """Index over segments of symbols with the document of each; answers ranges of suffixes and their least document."""

    def __init__(self, segments: list[np.ndarray], docs: np.ndarray, words: int) -> None:
        m = len(segments)
        size = np.array([len(s) for s in segments])
        self.start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        n = int((size + 1).sum())
        #: Each segment ends in a symbol of its own, so the order of suffixes is settled within a segment.
        text = np.empty(n, dtype=np.int64)
        for k, s in enumerate(segments):
            text[self.start[k] : self.start[k] + len(s)] = s + m
            text[self.start[k] + len(s)] = k
        self.text, self.n, sigma = text, n, m + words
        rank, width = text.copy(), 1
        order = np.argsort(rank, kind="stable")
        while width <= int(size.max(initial=0)) + 1:
            after = np.zeros(n, dtype=np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (n + sigma + 2) + after
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank[order] = np.cumsum(np.concatenate(([0], (k[1:] != k[:-1]).astype(np.int64))))
            width *= 2
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        level = np.repeat(docs, size + 1)[order].astype(np.int32)
        self.least = [level]
        width = 1
        while 2 * width <= n:
            level = np.minimum(level[:-width], level[width:])
            self.least.append(level)
            width *= 2
        self.log = np.zeros(n + 1, dtype=np.int64)
        for k in range(1, len(self.least)):
            self.log[1 << k :] = k
        self.flat = np.concatenate(self.least)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in self.least])))
        self.least = []

    def back(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
        return self.less[c] + both[: len(c)], self.less[c] + both[len(c) :]

    def least_doc(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = self.log[np.maximum(hi - lo, 1)]
        return np.minimum(self.flat[self.at[k] + lo], self.flat[self.at[k] + hi - (np.int64(1) << k)])

    def earlier(self, which: np.ndarray, length: np.ndarray, bound: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        """(segment, start, end) of the longest matches of at least `size` symbols with a document before the bound."""
        out: list[tuple[int, int, int]] = []
        end, at = length.copy(), length.copy()
        lo, hi = np.zeros(len(which), dtype=np.int64), np.full(len(which), self.n)
        while len(which):
            c = self.text[self.start[which] + at - 1]
            nlo, nhi = self.back(c, lo, hi)
            ok = (nhi > nlo) & (self.least_doc(np.minimum(nlo, self.n - 1), np.maximum(nhi, np.minimum(nlo, self.n - 1) + 1)) < bound)
            at, lo, hi = np.where(ok, at - 1, at), np.where(ok, nlo, lo), np.where(ok, nhi, hi)
            stop = ~ok | (at == 0)
            if stop.any():
                full = stop & (end - at >= size)
                out.extend(zip(which[full].tolist(), at[full].tolist(), end[full].tolist(), strict=True))
                #: Ends down to at + size are covered by a match; after a shorter one the next end is tried.
                end = np.where(stop, np.where(full, at + size - 1, end - 1), end)
                done = stop & ((end < size) | (at == 0))
                at, lo, hi = np.where(stop, end, at), np.where(stop, 0, lo), np.where(stop, self.n, hi)
                go = ~done
                which, end, at, lo, hi, bound = which[go], end[go], at[go], lo[go], hi[go], bound[go]
        return out


def _search(segments: DataFrame, shards: int, size: int) -> DataFrame:
    """(g, d, i, rel, n, copies): matches of the least document's segment, and whether all copies match whole."""
    spread = segments.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int"))

    def look(rows):
        ids: dict[bytes, int] = {}
        seqs = [np.array([ids.setdefault(w, len(ids)) for w in r[5].split(b" ")], dtype=np.int64) for r in rows]
        docs = np.array([r[1] for r in rows], dtype=np.int64)
        order = np.unique(docs)
        rank = np.searchsorted(order, docs)
        index = FMIndex(seqs, rank, len(ids))
        length = np.array([len(s) for s in seqs])
        found = [(k, a, b, False) for k, a, b in index.earlier(np.arange(len(rows)), length, rank, size)]
        second = np.array([r[4] for r in rows], dtype=np.int64)
        copied = np.flatnonzero(second != np.iinfo(np.int64).max)
        found += [(k, a, b, True) for k, a, b in index.earlier(copied, length[copied], np.searchsorted(order, second[copied]), size)]
        cols = [pa.array([f(k, a, b, c) for k, a, b, c in found], t) for f, t in ((lambda k, a, b, c: rows[k][0], pa.int64()), (lambda k, a, b, c: rows[k][1], pa.int64()), (lambda k, a, b, c: rows[k][2] + a, pa.int64()), (lambda k, a, b, c: a, pa.int64()), (lambda k, a, b, c: b - a, pa.int64()), (lambda k, a, b, c: c, pa.bool_()))]
        return pa.RecordBatch.from_arrays(cols, names=["g", "d", "i", "rel", "n", "copies"])

    def run(batches):
        last, rows, seen = None, [], set()
        for batch in batches:
            for shard, *r in zip(*(batch.column(c).to_pylist() for c in ("shard", "g", "d", "i", "n", "second", "words")), strict=True):
                if shard != last:
                    if rows:
                        yield look(rows)
                    last, rows, seen = shard, [], set()
                if r[0] not in seen:  # a repeated row gives its segment twice
                    seen.add(r[0])
                    rows.append(r)
        if rows:
            yield look(rows)

    return map_arrow(spread.repartition(partitions(segments.sparkSession), "shard").sortWithinPartitions("shard").select("shard", "g", "d", "i", "n", "second", "words"), run, "g long, d long, i long, rel long, n long, copies boolean")


def _packed(rec: np.ndarray, key: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Records by bucket of a signed key, a row for each bucket."""
    b = (key % buckets).astype(np.int32)
    o = np.argsort(b, kind="stable")
    rec, b = rec[o], b[o]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    data = [x.tobytes() for x in np.split(rec, cut[1:])] if len(b) else []
    return pa.RecordBatch.from_arrays([pa.array(b[cut], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])


def _cut(docs: DataFrame, hot: DataFrame, size: int, buckets: int) -> DataFrame:
    """Packed windows of the hot segments."""
    own = hot.groupBy("d").agg(F.collect_list(F.struct("i", "n", "g", "second")).alias("segments"))

    def run(batches):
        hasher = WordHasher(SPACES)
        for batch, texts in text_chunks(batches):
            h = _Hashed(texts, hasher)
            parts = []
            for d, segments, a, b in zip(batch.column("d").to_pylist(), batch.column("segments").to_pylist(), h.first[:-1].tolist(), h.first[1:].tolist(), strict=True):
                fits = [s for s in segments if s["i"] + s["n"] <= b - a]
                if not fits:
                    continue
                i, n, g, second = (np.array([s[k] for s in fits], dtype=np.int64) for k in ("i", "n", "g", "second"))
                true = h.run(i + a, n).view(np.int64) == g  # rows with equal doc_id may have other texts
                i, n, g, second = i[true], n[true], g[true], second[true]
                many = n - size + 1
                rel = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                rec = np.empty(len(rel), dtype=_WINDOW)
                for name, x in (("g", g), ("second", second), ("i", i), ("n", n)):
                    rec[name] = np.repeat(x, many)
                rec["d"], rec["rel"] = d, rel
                rec["w"] = h.run(rec["i"].astype(np.int64) + rel + a, np.full(len(rel), size)).view(np.int64)
                parts.append(rec)
            if parts:
                rec = np.concatenate(parts)
                yield _packed(rec, rec["w"], buckets)

    return map_arrow(docs.join(own, docs["doc_id"] == own["d"]).select("d", "segments", "text"), run, "bucket int, data binary")


def _least_two(rec: np.ndarray) -> np.ndarray:
    """One record for each window: its least document with the place there, and the next document."""
    rec = rec[np.lexsort((rec["i"], rec["d"], rec["w"]))]
    start = np.flatnonzero(np.concatenate(([True], rec["w"][1:] != rec["w"][:-1]))) if len(rec) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(rec))))
    out = rec[start].copy()
    other = np.where(rec["d"] > out["d"][group], rec["d"], rec["second"])
    if len(rec):
        out["second"] = np.minimum.reduceat(np.minimum(other, rec["second"]), start)
    return out


def _shared_windows(windows: DataFrame, size: int, buckets: int) -> DataFrame:
    """Windows that several documents have, as segments (d, i, n, g, second, a) of their least document."""

    def partial(batches):
        held, n = [], 0
        for batch in batches:
            for x in batch.column("data").to_pylist():
                seen = np.frombuffer(x, dtype=_WINDOW)
                rec = np.empty(len(seen), dtype=_FIRST)
                rec["w"], rec["d"], rec["second"], rec["i"] = seen["w"], seen["d"], seen["second"], seen["i"] + seen["rel"]
                held.append(rec)
                n += len(rec)
            if n > 2_000_000:
                held = [_least_two(np.concatenate(held))]
                yield _packed(held[0], held[0]["w"], buckets)
                held, n = [], 0
        if held:
            rec = _least_two(np.concatenate(held))
            yield _packed(rec, rec["w"], buckets)

    def final(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, x in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                held.setdefault(b, []).append(np.frombuffer(x, dtype=_FIRST))
                if len(held[b]) > 64:
                    held[b] = [_least_two(np.concatenate(held[b]))]
        for parts in held.values():
            rec = _least_two(np.concatenate(parts))
            rec = rec[rec["second"] != NEVER]
            w = pa.array(np.ascontiguousarray(rec["w"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rec["d"])), pa.array(np.ascontiguousarray(rec["i"])), pa.array(np.full(len(rec), size, np.int64)), w, pa.array(np.ascontiguousarray(rec["second"])), w], names=["d", "i", "n", "g", "second", "a"])

    return map_arrow(map_arrow(windows, partial, "bucket int, data binary").repartition(buckets, "bucket"), final, "d long, i long, n long, g long, second long, a long")


def _hot_matches(docs: DataFrame, hot: DataFrame, size: int, buckets: int) -> DataFrame:
    """What _search gives, for the different segments of hot anchors, by their windows."""
    many = max(buckets, hot.agg(F.sum(F.col("n") - (size - 1))).first()[0] // BUCKET_WINDOWS)
    windows = stash(_cut(docs, hot, size, many), "windows")
    shared = stash(_shared_windows(windows, size, many), "shared")
    found = _search(_contents(docs, shared, size), max(buckets, shared.count() * size // SHARD_WORDS), size)
    told = found.where("copies").groupBy(F.pmod("g", F.lit(many)).cast("int").alias("bucket")).agg(F.collect_list(F.struct("g", "d")).alias("told"))

    def tell(batches):
        for batch in batches:
            for data, told in zip(batch.column("data").to_pylist(), batch.column("told").to_pylist(), strict=True):
                rec = np.frombuffer(data, dtype=_WINDOW)
                w, own = (np.array([t[k] for t in told], dtype=np.int64) for k in ("g", "d"))
                o = np.argsort(w)
                w, own = w[o], own[o]
                at = np.minimum(np.searchsorted(w, rec["w"]), len(w) - 1)
                hit = w[at] == rec["w"]
                rec, own = rec[hit], own[at[hit]]
                out = np.empty(len(rec), dtype=_HIT)
                for name in ("g", "d", "i", "n", "rel"):
                    out[name] = rec[name]
                out["own"], out["copied"] = own < rec["d"], rec["second"] != NEVER
                yield _packed(out, out["g"], many)

    def join_up(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, x in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                held.setdefault(b, []).append(np.frombuffer(x, dtype=_HIT))
        for parts in held.values():
            rec = np.unique(np.concatenate(parts))
            mine = rec[rec["own"]]
            new = np.concatenate(([True], (mine["g"][1:] != mine["g"][:-1]) | (mine["rel"][1:] != mine["rel"][:-1] + 1))) if len(mine) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            runs = np.diff(np.append(first, len(mine)))
            x = mine[first]
            #: A copy is covered whole once every window of its segment is.
            g, at, count = np.unique(rec["g"][rec["copied"]], return_index=True, return_counts=True)
            y = rec[rec["copied"]][at]
            y = y[count == y["n"] - (size - 1)]
            cols = [np.concatenate((x["g"], y["g"])), np.concatenate((x["d"], y["d"])), np.concatenate((x["i"].astype(np.int64) + x["rel"], y["i"].astype(np.int64))), np.concatenate((x["rel"].astype(np.int64), np.zeros(len(y), np.int64))), np.concatenate((runs + size - 1, y["n"].astype(np.int64))), np.repeat([False, True], [len(x), len(y)])]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["g", "d", "i", "rel", "n", "copies"])

    hits = map_arrow(windows.join(told, "bucket").select("data", "told"), tell, "bucket int, data binary")
    return map_arrow(hits.repartition(many, "bucket"), join_up, "g long, d long, i long, rel long, n long, copies boolean")


def _meet(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Segments (d, i, g) with what is known of their group g; one group may hold most segments.

    Groups are sent to the segments while they are few (counted), beyond that segments of a group go to SALTS tasks.
    """
    if groups.count() <= SMALL:
        return segments.join(F.broadcast(groups), "g")
    dealt = segments.withColumn("salt", F.pmod(F.xxhash64("d", "i"), F.lit(SALTS)).cast("int"))
    return dealt.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"]).drop("salt")


def repeated(docs: DataFrame, size: int = 50) -> DataFrame:
    """(d, i, n): words i to i + n of document d stand in windows that an earlier document has."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    buckets = max(32, partitions(spark))
    cand = stash(_candidates(_anchors(docs, size, buckets), buckets), "segments")
    wanted = cand.where("lead")
    shards = max(buckets, wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // SHARD_WORDS)
    texts = stash(_contents(docs, wanted.where("not hot"), size), "contents")
    found = stash(_search(texts, shards, size), "matches")
    hot = wanted.where("hot")
    if not hot.isEmpty():
        found = found.unionByName(stash(_hot_matches(docs, hot, size, buckets), "hot"))
    copies = _meet(cand.where("copy").select("d", "i", "n", "g"), found.where("copies").select("g").distinct()).select("d", "i", "n")
    own = found.where("not copies")
    again = _meet(cand.where("not lead and not copy").select("d", "i", "g"), own.select("g", "rel", F.col("n").alias("many")))
    again = again.select("d", (F.col("i") + F.col("rel")).alias("i"), F.col("many").alias("n"))
    return own.select("d", "i", "n").unionByName(copies).unionByName(again)


def removed(docs: DataFrame, size: int = 50) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words left, joined by blanks) and its SHA-256."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    spans = repeated(docs, size).groupBy("d").agg(F.collect_list(F.struct("i", "n")).alias("spans"))

    def run(batches):
        for batch, texts in text_chunks(batches):
            out: list[list] = [[] for _ in range(4)]
            for t, spans in zip(texts, batch.column("spans").to_pylist(), strict=True):
                words, n_removed = t.split(), 0
                n = len(words)
                if spans:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    for s in spans:
                        if s["i"] + s["n"] <= n:
                            gone[s["i"]] += 1
                            gone[s["i"] + s["n"]] -= 1
                    stay = np.cumsum(gone)[:n] == 0
                    words = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
                    n_removed = n - len(words)
                kept = b" ".join(words)
                for col, x in zip(out, (n, n_removed, kept.decode(), hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(x)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    both = docs.select("doc_id", key.alias("k"), "text").join(spans, F.col("k") == F.col("d"), "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return map_arrow(both, run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
