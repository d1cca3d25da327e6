"""Exact Jaccard join of documents on their word shingles, and the components of its links.

Documents with the same set are one class; classes are compared.  Candidates come from prefixes:
with the shingles of every set in one order for all, two sets at or above the threshold t share a
shingle among the first n - ceil(t n) + 1 of each.  The order is by hash, with shingles that a bounded
sample finds frequent last; any order gives the same links, a good one fewer candidates.

First large groups of near copies are joined with few comparisons: every class has a few keys of two
minima of its hashes each, and is held against the least class that has the same key.  It is a
shortcut only, whatever it misses is found after it.  Classes that share a prefix shingle are a group.  First
each tile gives a forest of the pairs of different components that their bitmaps find most alike,
so that dense groups become one component without all their pairs.  Then, only in groups that still hold several
components, classes of different components are compared in tiles: members are dealt to tiles of
bounded size, sorted by set size, and in each pair of tiles only classes within the size band are
held against each other, first by hashed bitmaps (every bit in which two bitmaps differ is a shingle
that one set lacks, which bounds the overlap from above), then by intersecting the sorted arrays.
So no pair of documents in different components is left out, and no group is expanded into all its pairs.

Cases: null, empty and blank texts have no shingles and are their own component; texts of
fewer than `k` words are one shingle; repeated rows and equal ids share an id's least component;
null ids count as one id, less than all others; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WordHasher, gram_hashes, map_arrow, mix, partitions, stash, text_chunks

#: Documents looked at for frequent shingles, and in how many of them a shingle is frequent.
SAMPLE_DOCS, SAMPLE_FREQUENT = 4000, 4
#: Members of a tile, least and most bits of a bitmap.
TILE, BITS, MOST_BITS = 1024, 1024, 1 << 14
#: Rows (of two numbers) that may be sent to every executor.
SMALL = 200_000
#: Residues of hashes whose minima make the keys of a class.
PAIRED = np.array([(0, 1), (2, 3), (4, 5), (6, 7), (0, 4), (1, 5)]).T
#: Stands for a null doc_id inside.
NO_ID = -(1 << 63)


def shingle_sets(texts: list[bytes], hasher: WordHasher, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first, *_ = hasher(texts)
    grams, out = gram_hashes(words, k), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix(gram_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _class_of(s: np.ndarray) -> int:
    """Signed 64-bit name of a set; 0 for the empty set."""
    if not len(s):
        return 0
    h = mix(np.bitwise_xor.reduce(mix(s))[None] + np.sum(s * np.uint64(0x9FB21C651E98DF25), dtype=np.uint64)[None])
    return int(h.view(np.int64)[0]) or 1


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bitmap of at least twice as many bits as the set has items, a power of two between the limits.

    A bit is set if an odd number of items falls on it, so items of both sets cancel out where two bitmaps are
    compared, and every bit in which they differ still stands for an item that one of the sets lacks.
    """
    size = min(MOST_BITS, max(BITS, 1 << (2 * len(s) - 1).bit_length()))
    at = ((s >> np.uint64(20)) % np.uint64(size)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """The bitmaps at `size` bytes, which is what the sets' bitmaps of that size would be."""
    out = np.empty((len(maps), size // 8), dtype=np.uint64)
    for row, m in zip(out, maps, strict=True):
        row[:] = np.bitwise_xor.reduce(np.frombuffer(m, dtype=np.uint64).reshape(-1, size // 8), axis=0)
    return out


def sketch(s: np.ndarray) -> bytes:
    """Keys of two minima each; sets with much in common share some of them."""
    least = np.full(8, s[0])  # stands in where a residue has no hash
    least[(s & np.uint64(7))[::-1].astype(np.int64)] = s[::-1]  # sorted: the first of a residue is set last
    return mix(least[PAIRED[0]] * np.uint64(0x9FB21C651E98DF25) + least[PAIRED[1]] + np.arange(len(PAIRED[0]), dtype=np.uint64)).tobytes()


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles of at least SAMPLE_FREQUENT of at most SAMPLE_DOCS documents; it steers the order, never the result."""

    def run(batches):
        hasher = WordHasher(SPACES, lower=True)
        for _, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts, hasher, k)).view(np.int64))], names=["s"])

    sample = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    ids = [r[0] for r in sample.collect() if r[0] is not None]
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "doc_id long"))
    rows = map_arrow(docs.join(chosen, "doc_id").select("text"), run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLE_FREQUENT)
    #: At most SAMPLE_DOCS / SAMPLE_FREQUENT times the shingles of a document.
    return np.sort(rows.select("s").toPandas()["s"].to_numpy(dtype=np.int64).view(np.uint64))


def _scan(docs: DataFrame, k: int, t: Fraction, buckets: int, frequent: np.ndarray, prefixes: bool) -> DataFrame:
    """Documents with their class and bitmap, or else (`prefixes`) buckets of (shingle, class, size).

    The buckets are the larger part; they go straight into a shuffle and are never stored.
    """

    def run(batches):
        hasher, seen = WordHasher(SPACES, lower=True), set()
        for batch, texts in text_chunks(batches):
            sets = shingle_sets(texts, hasher, k)
            names = [_class_of(s) for s in sets]
            fresh, maps = [], []
            for s, c in zip(sets, names, strict=True):
                new = c != 0 and c not in seen
                maps.append(sketch(s) + bitmap(s) if new and not prefixes else None)
                if new:
                    if len(seen) < 500_000:
                        seen.add(c)
                    if not prefixes:
                        continue
                    n = len(s)
                    keep = n - -(-n * t.numerator // t.denominator) + 1
                    late = frequent[np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))] == s if len(frequent) else np.zeros(n, dtype=bool)
                    p = np.concatenate((s[~late], s[late]))[:keep]
                    fresh.append((p, c, n))
            size = [len(s) for s in sets]
            none = pa.nulls(len(names), pa.int32())
            if not prefixes:
                yield pa.RecordBatch.from_arrays([none, batch.column("doc_id").cast(pa.int64()), batch.column("h"), pa.array(names, pa.int64()), pa.array(size, pa.int64()), pa.array(maps, pa.binary())], names=["bucket", "doc_id", "h", "cls", "n", "data"])
            if fresh:
                token = np.concatenate([p for p, _, _ in fresh])
                many = [len(p) for p, _, _ in fresh]
                rec = np.empty(len(token), dtype=[("s", "<u8"), ("c", "<i8"), ("n", "<u4")])
                rec["s"], rec["c"], rec["n"] = token, np.repeat([c for _, c, _ in fresh], many), np.repeat([n for _, _, n in fresh], many)
                b = (token % np.uint64(buckets)).astype(np.int64)
                rec, b = rec[np.argsort(b, kind="stable")], np.sort(b)
                at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
                blobs = [x.tobytes() for x in np.split(rec, at[1:])]
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(b[at], pa.int32()), none, none, none, none, pa.array(blobs, pa.binary())], names=["bucket", "doc_id", "h", "cls", "n", "data"])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), run, "bucket int, doc_id long, h long, cls long, n long, data binary")


def _groups(blobs: DataFrame, buckets: int, t: Fraction) -> DataFrame:
    """(s, cls, n) of the sets s of classes that share prefix shingles."""

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, d in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                held.setdefault(b, []).append(d)
        for parts in held.values():
            rec = np.frombuffer(b"".join(parts), dtype=[("s", "<u8"), ("c", "<i8"), ("n", "<u4")])
            parts.clear()
            o = np.argsort(rec["s"], kind="stable")
            s, c, n = rec["s"][o], rec["c"][o], rec["n"][o]
            same = s[1:] == s[:-1]
            several = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            s, c, n = s[several], c[several], n[several]
            o = np.lexsort((c, s))
            s, c, n = s[o], c[o], n[o]
            new = np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])))[: len(s)]
            s, c, n = s[new], c[new], n[new].astype(np.int64)
            #: In order of size, a group falls apart where the next set is too large for all before it.
            o = np.lexsort((c, n, s))
            s, c, n = s[o], c[o], n[o]
            joined = (s[1:] == s[:-1]) & (n[:-1] * t.denominator >= n[1:] * t.numerator)
            several = np.concatenate(([False], joined)) | np.concatenate((joined, [False])) if len(s) else np.zeros(0, dtype=bool)
            begins = (np.concatenate(([True], ~joined)) if len(s) else several)[several]
            s, c, n = s[several], c[several], n[several]
            first = np.flatnonzero(begins)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))
            #: Groups with the same members give the same candidates: one of them stays.
            name = mix(np.add.reduceat(mix(c.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)), first)) if len(s) else s
            one = np.unique(name, return_index=True)[1]
            chosen = np.zeros(len(first), dtype=bool)
            chosen[one] = True
            stay = chosen[group]
            s, c, n = name[group][stay], c[stay], n[stay]
            for a in range(0, len(s), 100_000):
                cut = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s[cut].view(np.int64), c[cut], n[cut])], names=["s", "cls", "n"])

    return map_arrow(blobs.repartition(buckets, "bucket").select("bucket", "data"), run, "s long, cls long, n long").distinct()


def _stars(classes: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) of each class and the least classes that share its keys."""

    def run(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(x[: 8 * len(PAIRED[0])] for x in batch.column("keys").to_pylist()), dtype=np.int64)
            again = lambda c: pa.array(np.repeat(np.asarray(batch.column(c)), len(PAIRED[0])))
            yield pa.RecordBatch.from_arrays([pa.array(keys), again("cls"), again("n")], names=["key", "cls", "n"])

    keyed = map_arrow(classes.select("cls", "n", "keys"), run, "key long, cls long, n long")
    least = keyed.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("star"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "star")
    both = keyed.join(least, "key").where((F.col("star.cls") != F.col("cls")) & _near_enough(F.col("n"), F.col("star.n"), t))
    return both.select(F.col("star.cls").alias("a"), F.col("cls").alias("b")).distinct()


def _near_enough(a, b, t: Fraction):
    return F.least(a, b) * t.denominator >= F.greatest(a, b) * t.numerator


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose exact overlap reaches the threshold, by intersecting sorted arrays."""
    one = sets.select(F.col("cls").alias("a"), F.col("items").alias("xa"))
    two = sets.select(F.col("cls").alias("b"), F.col("items").alias("xb"))
    both = pairs.join(one, "a").join(two, "b")

    def run(batches):
        for batch in batches:
            for cut in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                keep = []
                for x, y in zip(cut.column("xa").to_pylist(), cut.column("xb").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(common * t.denominator >= (len(x) + len(y) - common) * t.numerator)
                cut = cut.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([cut.column("a"), cut.column("b")], names=["a", "b"])

    return map_arrow(both.select("a", "b", "xa", "xb"), run, "a long, b long")


def _bounded(pairs: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that the bitmaps don't rule out."""
    a = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("data").alias("ma"))
    b = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("data").alias("mb"))

    def run(batches):
        for x in (batch.slice(i, 1024) for batch in batches for i in range(0, batch.num_rows, 1024)):
            differ = np.zeros(x.num_rows, dtype=np.int64)
            for i, (m, o) in enumerate(zip(x.column("ma").to_pylist(), x.column("mb").to_pylist(), strict=True)):
                m, o = folded([m, o], min(len(m), len(o)))
                differ[i] = int(np.bitwise_count(m ^ o).sum())
            both = np.asarray(x.column("na")) + np.asarray(x.column("nb"))
            most = (both - differ) // 2
            ok = pa.array(most * t.denominator >= (both - most) * t.numerator)
            yield pa.RecordBatch.from_arrays([x.column("a").filter(ok), x.column("b").filter(ok)], names=["a", "b"])

    return map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ma", "mb"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(cls, comp) of the nodes of links (a, b); comp is the least name in the component."""
    edges = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.first("a"), F.min("b")).alias("comp"))
    while True:
        near = edges.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("seen"))
        step = labels.join(near, "cls").select("cls", F.least("comp", "seen").alias("next"), "comp")
        #: Pointer jumping: the label's own label.
        own = labels.select(F.col("cls").alias("next"), F.col("comp").alias("further"))
        after = stash(step.join(own, "next", "left").select("cls", F.least("next", F.coalesce("further", "next")).alias("comp"), (F.least("next", F.coalesce("further", "next")) != F.col("comp")).alias("moved")), "labels")
        labels = after.select("cls", "comp")
        if after.where("moved").isEmpty():
            return labels


def _tiles(groups: DataFrame, comps: DataFrame, classes: DataFrame, t: Fraction, best: bool = False) -> DataFrame:
    """Candidate pairs of different components in the groups that hold several, tile by tile.

    With `best`, a tile gives only a forest of the pairs that the bitmaps find most alike, which spans all its pairs.
    """
    named = groups.join(comps, "cls", "left").select("s", "cls", "n", F.coalesce("comp", "cls").alias("comp"))
    #: Members of a group's largest component are held against its other members only, so it isn't dealt against itself.
    sizes = named.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("s").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("comps"))
    tiles = lambda m: F.ceil(m / TILE).cast("int")
    mixed = sizes.where("comps > 1").select("s", F.col("most.comp").alias("large"), tiles(F.col("m") - F.col("most.m")).alias("rest"), tiles(F.col("most.m")).alias("chunks"))
    rows = named.join(mixed, "s").join(classes.select("cls", "data"), "cls").withColumn("h", F.xxhash64("cls"))
    is_large = F.col("comp") == F.col("large")
    own = F.when(is_large, -1 - F.pmod("h", "chunks")).otherwise(F.pmod("h", "rest")).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    others = F.when(is_large, every(F.col("rest"))).otherwise(F.concat(every(F.col("rest")), F.transform(every(F.col("chunks")), lambda i: -1 - i)))
    dealt = rows.withColumn("own", own).select("s", "cls", "n", "comp", "data", "own", F.explode(others).alias("other"))
    dealt = dealt.select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "n", "comp", "data")

    def compare(x, y, same: bool, strict: bool = False):
        """Pairs of a member of x and one of y of at least (`strict`: more than) its size; both are sorted by size."""
        (c, n, comp, maps), (cy, ny, compy, mapsy) = x, y
        size = np.array([len(m) for m in maps])
        for bytes_ in np.unique(size).tolist():  # sizes grow with n
            first, last = np.searchsorted(size, [bytes_, bytes_ + 1]).tolist()
            low = first if same else int(np.searchsorted(ny, n[first], side="left"))
            mx, my = folded(maps[first:last], bytes_), folded(mapsy[low : int(np.searchsorted(ny, int(n[last - 1]) * t.denominator // t.numerator, side="right"))], bytes_)
            step = max(1, 32768 // bytes_)
            for a in range(first, last, step):
                stop = min(a + step, last)
                begin = a if same else int(np.searchsorted(ny, n[a], side="left"))
                end = int(np.searchsorted(ny, int(n[stop - 1]) * t.denominator // t.numerator, side="right"))
                if begin < end:
                    yield from tile((c[a:stop], n[a:stop], comp[a:stop], mx[a - first : stop - first]), (cy[begin:end], ny[begin:end], compy[begin:end], my[begin - low : end - low]), same, strict)

    def tile(x, y, same: bool, strict: bool):
        (c, n, comp, mx), (cy, ny, compy, my) = x, y
        differ = np.bitwise_count(mx[:, None, :] ^ my[None, :, :]).sum(2).astype(np.int64)
        both = n[:, None] + ny[None, :]
        most = (both - differ) // 2
        ok = (most * t.denominator >= (both - most) * t.numerator) & (comp[:, None] != compy[None, :]) & (n[:, None] * t.denominator >= ny[None, :] * t.numerator)
        if same:
            ok = np.triu(ok, 1)
        else:
            ok &= ny[None, :] > n[:, None] if strict else ny[None, :] >= n[:, None]
        i, j = np.nonzero(ok)
        yield c[i], cy[j], comp[i], compy[j], (most[i, j] / np.maximum(both[i, j] - most[i, j], 1))

    def run(batches):
        last, held = None, []

        def flush():
            if not held:
                return
            sides = {}
            for own in {h[0] for h in held}:
                mine = sorted((h for h in held if h[0] == own), key=lambda h: h[2])
                sides[own] = tuple(np.array([h[i] for h in mine], dtype=np.int64) for i in (1, 2, 3)) + ([h[4] for h in mine],)
            _, i, j = last
            if i == j:
                found = compare(sides[i], sides[i], True)
            elif i in sides and j in sides:
                found = chain(compare(sides[i], sides[j], False), compare(sides[j], sides[i], False, True))
            else:
                return
            found = [x for x in found if len(x[0])]
            if not found:
                return
            if best:
                whole = [np.concatenate(x) for x in zip(*found, strict=True)]
                keep = forest(*whole[2:])
                found = [[x[keep] for x in whole]]
            for a, b, *_ in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            for s, i, j, *row in zip(*(batch.column(x).to_pylist() for x in ("s", "i", "j", "own", "cls", "n", "comp", "data")), strict=True):
                if (s, i, j) != last:
                    yield from flush()
                    last, held = (s, i, j), []
                held.append(row)
        yield from flush()

    found = map_arrow(dealt.repartition(F.col("s"), F.col("i"), F.col("j")).sortWithinPartitions("s", "i", "j"), run, "a long, b long")
    return found.distinct()


def forest(one: np.ndarray, other: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Places of edges (one, other) that span all the edges do, the most alike first; at most one fewer than there are nodes."""
    nodes, ends = np.unique(np.concatenate((one, other)), return_inverse=True)
    label, x, y = np.arange(len(nodes)), ends[: len(one)], ends[len(one) :]
    left, chosen = np.argsort(-alike, kind="stable"), []
    while len(left):
        a, b = label[x[left]], label[y[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        #: The best edge of every tree, in order, so that edges between two trees agree.
        first = np.unique(np.unique(np.stack((a, b), 1).ravel(), return_index=True)[1] // 2)
        for i in first.tolist():
            p, q = label[x[left[i]]], label[y[left[i]]]
            if p != q:
                label[label == max(p, q)] = min(p, q)
                chosen.append(left[i])
    return np.array(chosen, dtype=np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, items) of the wanted (doc_id, cls), with the sorted set as bytes."""

    def run(batches):
        hasher = WordHasher(SPACES, lower=True)
        for batch, texts in text_chunks(batches):
            sets = shingle_sets(texts, hasher, k)
            #: A repeated doc_id may have other texts.
            own = pa.array([_class_of(s) == c for s, c in zip(sets, batch.column("cls").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("cls").filter(own), pa.array([s.tobytes() for s in sets], pa.binary()).filter(own)], names=["cls", "items"])

    return map_arrow(docs.select("doc_id", "text").join(wanted, "doc_id").select("cls", "text"), run, "cls long, items binary").dropDuplicates(["cls"])


def join(docs: DataFrame, threshold: Fraction = Fraction(3, 4), k: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id that its links reach), cls (name of its set)."""
    no = F.lit(NO_ID)
    return _joined(docs, threshold, k).select(F.nullif("doc_id", no).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "doc_id"), no).alias("component_id"), "cls")


def _joined(docs: DataFrame, threshold: Fraction, k: int) -> DataFrame:
    """Per document: doc_id (NO_ID for null), h (hash of the text), cls, n, comp (least class of its component) and component (its least doc_id)."""
    spark, t = docs.sparkSession, Fraction(threshold)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    buckets = partitions(spark)
    frequent = _frequent(docs, k)
    rows = stash(_scan(docs, k, t, buckets, frequent, False).select("doc_id", "h", "cls", "n", "data"), "jaccard")
    #: A class is represented by its least document.
    classes = rows.where("cls != 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max("data").alias("data"))
    keys = 8 * len(PAIRED[0])
    classes = stash(classes.select("cls", "doc_id", "n", F.substring("data", 1, keys).alias("keys"), F.substring("data", keys + 1, MOST_BITS // 8).alias("data")), "classes")
    stars = _stars(classes, t)
    stars = stash(_bounded(stars, classes, t), "stars")
    links = stash(_verified(stars, _items(docs, classes, stars, k), t), "links")
    labels = components(links)
    groups = stash(_groups(_scan(docs, k, t, buckets, frequent, True), buckets, t), "groups")
    tried = stars
    for best in (True, False):
        rest = stash(_tiles(groups, labels, classes, t, best).join(tried, ["a", "b"], "left_anti"), "rest")
        more = stash(_verified(rest, _items(docs, classes, rest, k), t), "more")
        tried = tried.unionByName(rest)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    least_doc = classes.join(labels, "cls").groupBy("comp").agg(F.min("doc_id").alias("component"))
    by_class = classes.join(labels, "cls", "left").join(least_doc, "comp", "left").select("cls", F.coalesce("comp", "cls").alias("comp"), F.coalesce("component", "doc_id").alias("component"))
    return rows.join(by_class, "cls", "left").select("doc_id", "h", "cls", "n", "comp", "component")


def _items(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    chosen = stash(classes.select("cls", "doc_id").join(wanted, "cls"), "wanted")
    #: Sent to executors only while it is small; beyond that the documents are shuffled.
    return stash(_sets(docs, F.broadcast(chosen) if chosen.count() <= SMALL else chosen, k), "sets")


def near_duplicates(docs: DataFrame, threshold: Fraction = Fraction(3, 4), k: int = 5) -> DataFrame:
    """One row of each component, that of least doc_id (null: before all), class and hash of the text; all columns stay, whatever their names.

    A row is a document by its doc_id and text together, so other texts under a null or repeated id are documents
    of their own.  Texts without shingles are linked to none and stay.
    """
    found = _joined(docs, threshold, k)
    linked = found.where("cls != 0").groupBy("comp").agg(F.min(F.struct("doc_id", "cls", "h")).alias("s")).select("s.doc_id", "s.h")
    kept = linked.unionByName(found.where("cls = 0").select("doc_id", "h")).toDF("__doc", "__hash").distinct()
    #: Repeated rows meet in partial aggregates first.
    one = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__hash", F.xxhash64("text")).dropDuplicates(["__doc", "__hash"])
    return one.join(kept, ["__doc", "__hash"], "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
