"""Language-model scoring by a probabilistic suffix tree.

Tokens are words and one end; the tree predicts the bytes that spell them (a blank ends a word, a
line end the text), each from the longest context that the tree retains, at most DEPTH bytes.

* Counting: each chunk of texts names its distinct (DEPTH + 1)-grams with their counts in training texts,
  in buckets by the three bytes before the predicted one.  Shorter contexts are their marginals.
* Retaining: a context stays if it was seen at least LEAST times and its gain over the longest retained
  suffix, its count times the divergence, is at least MIN_GAIN.  Neither bound follows the size of the
  corpus, so more text retains more contexts.
* Smoothing: the distribution of a context is mixed with that of its longest retained suffix, weighted by
  the number of different symbols seen after it; the root is mixed with equal shares of all 256 bytes.
* Where it is: contexts of up to two bytes (bounded by the alphabet) are sent to executors; longer ones are
  tables of their bucket, which is where the grams of all chunks meet them.
* Scoring: log10 probabilities of all bytes of the text, the end included; each chunk gets those of its
  distinct grams back from the buckets.

The base score needs the count of every word.  The most frequent words (at most HEAD of them) are sent
to executors; the others meet their counts in buckets by hash, and their counts go back to their documents.
Words are named by 64-bit hashes.

Cases: null and empty texts are the end alone; without training texts N and V are 0 and the tree is its
root; repeated rows count and are scored each; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WordHasher, map_arrow, mix, partitions, stash, text_chunks

#: A gram of DEPTH bytes and the next one fills 64 bits.
DEPTH = 7
#: Contexts of more bytes are in buckets.
UPPER = 2
LEAST = 2
#: In nats.
MIN_GAIN = 0.5
#: Bytes of text that name their grams together.
GRAM_BYTES = 6 << 20
HEAD = 1 << 17
#: Probabilities travel with so many binary digits after the point.
STEP_BITS = 19
#: Name of the end token among the word hashes.
END = np.uint64(0x5851F42D4C957F2D)
_PAD = b"\n" * DEPTH
_PAIR = np.dtype([("k", "<u8"), ("n", "<u8")])
_TAIL = np.dtype([("k", "<u8"), ("d", "<u4")])
_SEEN = np.dtype([("k", "<u4"), ("n", "<u8")])
_SUMS = np.dtype([("known", "<i8"), ("log", "<f8")])


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, whether each is scored, end of each text): lower-cased words and blanks, then a line end."""
    parts = [_PAD + b"".join([w + b" " for w in t.lower().split()]) + b"\n" for t in texts]
    s = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
    return s, _scored(ends), ends


def _scored(ends: np.ndarray) -> np.ndarray:
    """All bytes but the DEPTH before each text."""
    scored = np.ones(ends[-1] if len(ends) else 0, dtype=bool)
    starts = np.concatenate(([0], ends[:-1]))
    for i in range(DEPTH):
        scored[starts + i] = False
    return scored


def _windows(s: np.ndarray, kind: str) -> np.ndarray:
    """The bytes that end at each byte (zeros before the first), read as numbers of that kind."""
    size = np.dtype(kind).itemsize
    buf = np.concatenate((np.zeros(size - 1, dtype=np.uint8), s))
    return np.ndarray(len(s), dtype=kind, buffer=buf, strides=(1,))


def _grams(s: np.ndarray) -> np.ndarray:
    """Code of each byte with the DEPTH before it; the byte itself is lowest, the byte before it next."""
    return _windows(s, ">u8").astype(np.uint64)


def _turned_grams(s: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """The codes of scored bytes with their own bytes in opposite order: sorted, the predicted byte comes first, then the newest."""
    return _windows(s, "<u8").astype(np.uint64)[scored]


def _ranks(keys: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Rank of each key below `size` among those that occur, and how many do."""
    there = np.zeros(size, dtype=bool)
    there[keys] = True
    rank = np.cumsum(there, dtype=np.uint32) - np.uint32(1)
    return rank[keys], int(rank[-1]) + 1


def _numbered(s: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct turned grams, number of each scored byte's among them).

    A gram is two runs of four bytes, and those are two of two; where the ranks of both runs leave room for the
    place, all three are sorted as one number, which is far cheaper than sorting places by grams.
    """
    g = _turned_grams(s, scored)
    rank, kinds = _ranks(_windows(s, "<u2"), 1 << 16)
    if kinds <= 1 << 12 and len(s) > 4:
        before = np.concatenate((rank[:2], rank[:-2]))
        rank, kinds = _ranks(rank * np.uint32(kinds) + before, kinds * kinds)
        bits, place = max(1, (kinds - 1).bit_length()), max(1, len(g).bit_length())
        if 2 * bits + place <= 64:
            key = (rank.astype(np.uint64) << np.uint64(bits) | np.concatenate((rank[:4], rank[:-4])))[scored]
            key <<= np.uint64(place)
            key |= np.arange(len(g), dtype=np.uint64)
            key.sort()
            at = (key & np.uint64((1 << place) - 1)).astype(np.int64)
            key >>= np.uint64(place)
            first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=bool)
            back = np.empty(len(g), dtype=np.int64)
            back[at] = np.cumsum(first) - 1
            return g[at[first]], back
    return np.unique(g, return_inverse=True)


def _sum_pairs(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    o = np.argsort(k, kind="stable")
    k, n = k[o], n[o]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, dtype=np.int64)
    out = np.empty(len(at), dtype=_PAIR)
    out["k"], out["n"] = k[at], np.add.reduceat(n, at) if len(at) else n
    return out


class _Counts:
    """Counts of 64-bit names, summed whenever many have been added."""

    def __init__(self) -> None:
        self.held = [np.zeros(0, dtype=_PAIR)]
        self.size = 0

    def add(self, names: np.ndarray) -> None:
        k, n = np.unique(names, return_counts=True)
        p = np.empty(len(k), dtype=_PAIR)
        p["k"], p["n"] = k, n
        self.add_pairs(p)

    def add_pairs(self, p: np.ndarray) -> None:
        self.held.append(p)
        self.size += len(p)
        if self.size > 2 * len(self.held[0]) + 3_000_000:
            self.sum()

    def sum(self) -> np.ndarray:
        x = np.concatenate(self.held)
        self.held = [_sum_pairs(x["k"], x["n"])]
        self.size = len(self.held[0])
        return self.held[0]


def _by_bucket(pairs: np.ndarray, bucket: np.ndarray):
    o = np.argsort(bucket, kind="stable")
    pairs, bucket = pairs[o], bucket[o]
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    return bucket[at].astype(np.int32) if len(at) else np.zeros(0, np.int32), [_pack(x) for x in np.split(pairs, at[1:])] if len(at) else []


def _count(train: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        words, hasher = _Counts(), WordHasher(SPACES, lower=True)
        for _, texts in text_chunks(batches):
            words.add(np.concatenate((hasher(texts)[0], np.full(len(texts), END))))
        p = words.sum()
        bucket, data = _by_bucket(p, (p["k"] % np.uint64(buckets)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return map_arrow(train.select("text"), run, "bucket int, data binary")


def _gather(batches):
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, d in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
            held.setdefault(b, []).append(d)
    for b, parts in held.items():
        x = np.concatenate([_unpack(d, _PAIR) for d in parts])
        parts.clear()
        yield b, _sum_pairs(x["k"], x["n"])


def _words(counted: DataFrame, buckets: int) -> DataFrame:
    """A row per bucket: its counts, how many words and tokens, and how many words have a count of 2**i or more."""

    def run(batches):
        for b, p in _gather(batches):
            at_least = [int((p["n"] >= (1 << i)).sum()) for i in range(48)]
            cols = ([b], [_pack(p)], [len(p)], [int(p["n"].sum())], [at_least])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["bucket", "data", "v", "n", "at_least"])

    return map_arrow(counted.repartition(buckets, "bucket"), run, "bucket int, data binary, v long, n long, at_least array<long>")


def _low(g: np.ndarray, k: int) -> np.ndarray:
    """The grams' last k bytes."""
    return g & np.uint64((1 << 8 * k) - 1)


def _bucket_of(g: np.ndarray, buckets: int) -> np.ndarray:
    """Grams meet by the three bytes before the predicted one, so contexts from three bytes on are whole in a bucket."""
    return (mix((g >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int32)


def _find(sorted_names: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each name."""
    if not len(sorted_names):
        return np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
    return at, sorted_names[at] == names


def _squeeze(*parts: np.ndarray, level: int = 3) -> bytes:
    """Arrays of one length, compressed: all first bytes of the items, then all second bytes, and so on."""
    return zstandard.ZstdCompressor(level=level).compress(b"".join(p.view(np.uint8).reshape(len(p), -1).T.tobytes() for p in parts))


def _expand(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(sum(sizes), -1)
    return [np.ascontiguousarray(y.T).view(k).ravel() for y, k in zip(np.split(x, np.cumsum(sizes)[:-1]), kinds, strict=True)]


def _pack(rec: np.ndarray) -> bytes:
    """Records, compressed; their k travel as steps, which are small where they are sorted."""
    return _squeeze(np.diff(rec["k"], prepend=rec["k"].dtype.type(0)), *(np.ascontiguousarray(rec[c]) for c in rec.dtype.names[1:])) if len(rec) else b""


def _unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=kind)
    steps, *others = _expand(data, *(kind[c] for c in kind.names))
    out = np.empty(len(steps), dtype=kind)
    out["k"] = np.cumsum(steps, dtype=steps.dtype)
    for c, x in zip(kind.names[1:], others, strict=True):
        out[c] = x
    return out


def _fixed(x: np.ndarray) -> np.ndarray:
    """Logarithms (0 or less) in steps of 2**-STEP_BITS; the highest of the four bytes is hardly ever used, so it travels for nothing."""
    return np.rint(x * -float(1 << STEP_BITS)).astype(np.uint32)


def _distinct(names: np.ndarray) -> np.ndarray:
    names = np.sort(names)
    return names[np.concatenate(([True], names[1:] != names[:-1]))] if len(names) else names


def _merged(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams, place of each among them) of parts that are sorted with their bytes turned: a stable sort merges such runs."""
    turned = g.byteswap()
    o = np.argsort(turned, kind="stable")
    turned = turned[o]
    first = np.concatenate(([True], turned[1:] != turned[:-1])) if len(g) else np.zeros(0, dtype=bool)
    names = turned[first].byteswap()
    order = np.argsort(names)
    place = np.empty(len(names), dtype=np.int64)
    place[order] = np.arange(len(names))
    back = np.empty(len(g), dtype=np.int64)
    back[o] = place[np.cumsum(first) - 1]
    return names[order], back


@dataclass
class Level:
    """The contexts of one length.

    names: contexts with a next byte that was seen after them; best: its probability after the longest
    retained suffix, the context itself included; contexts, logs: the retained ones and the logarithm of the share
    that bytes never seen after them take from the suffix.
    """

    names: np.ndarray
    best: np.ndarray
    contexts: np.ndarray
    logs: np.ndarray


def grow(pairs: np.ndarray, k: int, below: Level) -> Level:
    """Retain and smooth the contexts of k bytes; `pairs` are sorted by name, `below` has those of k - 1 bytes."""
    c = pairs["k"] >> np.uint64(8)  # sorted by the oldest byte first, so a context's names stand together
    at = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, dtype=np.int64)
    if not len(c):
        return Level(pairs["k"], np.zeros(0), c, np.zeros(0))
    kinds = np.diff(np.append(at, len(c)))
    count = pairs["n"].astype(np.float64)
    n = np.add.reduceat(count, at)
    #: What follows a context follows its suffixes too.
    q = below.best[np.searchsorted(below.names, _low(pairs["k"], k))]
    p = (count + np.repeat(kinds, kinds) * q) / np.repeat(n + kinds, kinds)
    share = kinds / (n + kinds)
    #: Bytes that were never seen after the context have `share` of their probability after the suffix.
    unseen = np.maximum(0, 1 - np.add.reduceat(q, at))
    gain = n * (np.add.reduceat(p * np.log(p / q), at) + unseen * share * np.log(share))
    keep = (n >= LEAST) & (gain >= MIN_GAIN)
    return Level(pairs["k"], np.where(np.repeat(keep, kinds), p, q), c[at][keep], np.log(share[keep]))


@dataclass
class Upper:
    """The root and the contexts of up to UPPER bytes."""

    root: np.ndarray
    levels: list[Level]


def upper(pairs: np.ndarray) -> Upper:
    """From the counts of all contexts of UPPER bytes and the next byte."""
    first = _sum_pairs(_low(pairs["k"], 1), pairs["n"])
    counts = np.zeros(256)
    counts[first["k"].astype(np.int64)] = first["n"]
    d = max(1, len(first))
    root = (counts + d / 256) / (counts.sum() + d)
    levels = [Level(first["k"], root[first["k"].astype(np.int64)], np.zeros(0, dtype=np.uint64), np.zeros(0))]
    for k in range(1, UPPER + 1):
        levels.append(grow(_sum_pairs(_low(pairs["k"], k + 1), pairs["n"]), k, levels[-1]))
    return Upper(root, levels)


def predict(top: Upper, pairs: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """log10 probability of each gram of a bucket, and its levels; grams of held-out texts alone have a count of 0."""
    seen, levels = pairs[pairs["n"] > 0], list(top.levels)
    for k in range(UPPER + 1, DEPTH + 1):
        levels.append(grow(seen if k == DEPTH else _sum_pairs(_low(seen["k"], k + 1), seen["n"]), k, levels[-1]))
    out = np.empty(len(pairs))
    out[pairs["n"] > 0] = np.log(levels[-1].best)
    g = pairs["k"][pairs["n"] == 0]
    log = np.log(top.root)[_low(g, 1).astype(np.int64)]
    for k in range(1, DEPTH + 1):
        at, known = _find(levels[k].names, _low(g, k + 1))
        in_tree, retained = _find(levels[k].contexts, _low(g, k + 1) >> np.uint64(8))
        log[retained] += levels[k].logs[in_tree[retained]]
        log[known] = np.log(levels[k].best[at[known]])
    out[pairs["n"] == 0] = log
    return out / np.log(10), levels[UPPER + 1 :]


def _scan(docs: DataFrame, learn: Column) -> DataFrame:
    """Per chunk of documents: itself; per task: the short contexts."""

    def run(batches):
        from pyspark import TaskContext

        part, short = TaskContext.get().partitionId(), _Counts()

        def rows(kind, no, bucket, data, *chunk):
            m = len(data)
            cols = ([kind] * m, [part] * m, [no] * m, bucket, *(chunk or [[None] * m] * 5), data)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCAN_TYPES, strict=True)], names=_SCAN_NAMES)

        for no, (batch, texts) in enumerate(text_chunks(batches, GRAM_BYTES)):
            s, scored, ends = _stream(texts)
            sizes = np.diff(ends, prepend=0)
            learn = np.array(batch.column("learn").to_pylist(), dtype=bool)
            n = np.add.reduceat((s == 32).astype(np.int64), ends - sizes) + 1  # a blank ends each word
            yield rows("chunk", no, [-1], [None], [batch.column("doc_id").to_pylist()], [n.tolist()], [sizes.tolist()], [learn.tolist()], [_squeeze(s, level=7)])
            g = _windows(s, ">u4").astype(np.uint32)[scored & np.repeat(learn, sizes)]
            mine, n = np.unique(g & np.uint32((1 << 8 * (UPPER + 1)) - 1), return_counts=True)
            del s, scored, g
            less = np.empty(len(mine), dtype=_PAIR)
            less["k"], less["n"] = mine, n
            short.add_pairs(less)
        p = short.sum()
        b, data = _by_bucket(p, (mix(p["k"]) % np.uint64(SHORT)).astype(np.int64))
        yield rows("short", -1, b, data)

    learned = F.coalesce(learn, F.lit(False)).alias("learn")
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", learned), run, _SCAN)


#: Buckets of the counts of short contexts.
SHORT = 16
_SCAN_NAMES = ["kind", "part", "no", "bucket", "ids", "tokens", "sizes", "learn", "stream", "data"]
_SCAN_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary())
_SCAN = "kind string, part int, no int, bucket int, ids array<long>, tokens array<long>, sizes array<long>, learn array<boolean>, stream binary, data binary"


def _rare(scanned: DataFrame, head: np.ndarray, buckets: int) -> DataFrame:
    """Per chunk: the rarer words by bucket, and (`own`) the sums over the others."""

    def run(batches):
        hasher = WordHasher(SPACES)
        for batch in batches:
            for part, no, sizes, stream in zip(*(batch.column(c).to_pylist() for c in ("part", "no", "sizes", "stream")), strict=True):
                s, ends = _expand(stream, np.uint8)[0].tobytes(), np.cumsum(np.array(sizes, dtype=np.int64)).tolist()
                texts = [s[b - size + DEPTH : b] for b, size in zip(ends, sizes, strict=True)]
                h, first, *_ = hasher(texts)
                doc = np.repeat(np.arange(len(texts)), np.diff(first))
                h, doc = np.concatenate((h, np.full(len(texts), END))), np.concatenate((doc, np.arange(len(texts))))
                at, known = _find(head["k"], h)
                sums = np.zeros(len(texts), dtype=_SUMS)
                sums["known"] = np.bincount(doc[known], minlength=len(texts))
                if len(head):
                    sums["log"] = np.bincount(doc[known], weights=np.log10(head["n"][at[known]] + 1.0), minlength=len(texts))
                rare = np.zeros(int((~known).sum()), dtype=_TAIL)
                rare["k"], rare["d"] = h[~known], doc[~known]
                rare = rare[np.argsort(rare["k"], kind="stable")]
                del h, doc, at, known
                b, data = _by_bucket(rare, (rare["k"] % np.uint64(buckets)).astype(np.int64))
                b, data, m = [(31 * part + no) % buckets, *b.tolist()], [sums.tobytes(), *data], len(data) + 1
                yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([no] * m, pa.int32()), pa.array(b, pa.int32()), pa.array([i == 0 for i in range(m)]), pa.array(data, pa.binary())], names=["part", "no", "bucket", "own", "data"])

    return map_arrow(scanned.where("kind = 'chunk'").select("part", "no", "sizes", "stream"), run, "part int, no int, bucket int, own boolean, data binary")


def _by_gram(scanned: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket: the distinct grams with their counts in training texts."""

    def run(batches):
        for batch in batches:
            for part, no, sizes, learn, stream in zip(*(batch.column(c).to_pylist() for c in ("part", "no", "sizes", "learn", "stream")), strict=True):
                scored = _scored(np.cumsum(np.array(sizes, dtype=np.int64)))
                own = np.repeat(np.array(learn, dtype=bool), sizes)[scored]
                #: Sorted by the predicted byte first, then the newest, grams compress best; their buckets keep the order.
                g = _turned_grams(_expand(stream, np.uint8)[0], scored)
                mine, n = np.unique(g[own], return_counts=True)
                names = _distinct(np.concatenate((mine, g[~own])))
                del g, own, scored
                counts = np.zeros(len(names), dtype=np.uint32)
                counts[np.searchsorted(names, mine)] = n
                names = names.byteswap()
                b = _bucket_of(names, buckets)
                o = np.argsort(b, kind="stable")
                cut = np.concatenate((np.flatnonzero(np.diff(b[o], prepend=-1)), [len(o)]))
                data = [_squeeze(names[o[x:y]], counts[o[x:y]], level=6) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(data), pa.int32()), pa.array([no] * len(data), pa.int32()), pa.array(b[o[cut[:-1]]], pa.int32()), pa.array(data, pa.binary())], names=["part", "no", "bucket", "data"])

    chunks = scanned.where("kind = 'chunk'").select("part", "no", "sizes", "learn", "stream")
    return map_arrow(chunks, run, "part int, no int, bucket int, data binary")


def _short(scanned: DataFrame) -> np.ndarray:
    """Counts of all contexts of UPPER bytes with the next byte, at most 256**(UPPER + 1)."""

    def run(batches):
        for _, p in _gather(batches):
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary())], names=["data"])

    got = map_arrow(scanned.where("kind = 'short'").select("bucket", "data").repartition(SHORT, "bucket"), run, "data binary").collect()
    return np.sort(np.frombuffer(b"".join(r["data"] for r in got), dtype=_PAIR), order="k")


def _answer(scanned: DataFrame, top: Upper, buckets: int) -> DataFrame:
    """log10 probabilities of the grams of each chunk and bucket, in their order; `contexts` counts what a bucket retains, by length."""

    def run(batches):
        def flush(bucket, held):
            if not held:
                return
            raw = [_expand(d, np.uint64, np.uint32) for _, _, d in held]
            size = [len(x) for x, _ in raw]
            g, n = (np.concatenate(x) for x in zip(*raw, strict=True))
            raw.clear()
            names, back = _merged(g)
            pairs = np.empty(len(names), dtype=_PAIR)
            pairs["k"], pairs["n"] = names, np.bincount(back, weights=n, minlength=len(names)).astype(np.uint64)
            del g, n, names
            log, levels = predict(top, pairs)
            found = _fixed(log)[back]
            data = [_squeeze(x) for x in np.split(found, np.cumsum(size)[:-1])]
            retained = [[len(x.contexts) for x in levels]] + [None] * (len(held) - 1)
            cols = ([h[0] for h in held], [h[1] for h in held], [bucket] * len(held), data, retained)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["part", "no", "bucket", "data", "contexts"])

        last, held = None, []
        for batch in batches:
            for part, no, b, data in zip(*(batch.column(c).to_pylist() for c in ("part", "no", "bucket", "data")), strict=True):
                if b != last:
                    yield from flush(last, held)
                    last, held = b, []
                held.append((part, no, data))
        yield from flush(last, held)

    return map_arrow(_by_gram(scanned, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, "part int, no int, bucket int, data binary, contexts array<long>")


def _look_up(rare: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """Counts of the rarer words with their documents, per chunk and bucket; words without a count are left out, sums pass."""
    both = words.select(F.lit(-1).alias("part"), F.lit(-1).alias("no"), "bucket", F.lit(False).alias("own"), "data").unionByName(rare)

    def run(batches):
        bucket, counts = None, np.zeros(0, dtype=_PAIR)
        for batch in batches:
            for part, no, b, own, data in zip(*(batch.column(c).to_pylist() for c in ("part", "no", "bucket", "own", "data")), strict=True):
                if b != bucket:
                    bucket, counts = b, np.zeros(0, dtype=_PAIR)
                if part < 0:
                    counts = _unpack(data, _PAIR)
                    continue
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([True]), pa.array([data], pa.binary())], names=["part", "no", "own", "data"])
                    continue
                x = _unpack(data, _TAIL)
                at, ok = _find(counts["k"], x["k"])
                if ok.any():
                    seen = np.empty(int(ok.sum()), dtype=_SEEN)
                    o = np.argsort(x["d"][ok], kind="stable")
                    seen["k"], seen["n"] = x["d"][ok][o], counts["n"][at[ok]][o]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([False]), pa.array([_pack(seen)], pa.binary())], names=["part", "no", "own", "data"])

    return map_arrow(both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "part", "no"), run, "part int, no int, own boolean, data binary")


def _learn(docs: DataFrame, learn: Column):
    """(buckets, words, their totals, the most frequent, scanned documents, short contexts, answers): what `score` puts together and `contexts` counts."""
    spark = docs.sparkSession
    buckets = max(32, partitions(spark))
    words = stash(_words(_count(docs.where(learn), buckets), buckets), "words")
    total = words.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.coalesce(F.sum(F.col("at_least")[i]), F.lit(0)).alias(f"a{i}") for i in range(48))).first()
    enough = next((1 << i for i in range(48) if total[f"a{i}"] <= HEAD), 1 << 48)

    def frequent(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                p = _unpack(data, _PAIR)
                yield pa.RecordBatch.from_arrays([pa.array([p[p["n"] >= enough].tobytes()], pa.binary())], names=["data"])

    got = map_arrow(words.select("data"), frequent, "data binary").collect()
    head = np.sort(np.frombuffer(b"".join(r["data"] for r in got), dtype=_PAIR), order="k")
    scanned = stash(_scan(docs, learn), "scan")
    top = upper(_short(scanned))
    return buckets, words, total, head, scanned, top, _answer(scanned, top, buckets)


def contexts(docs: DataFrame, learn: Column) -> list[int]:
    """How many contexts the tree retains, by length in bytes from 1 to DEPTH."""
    *_, top, answers = _learn(docs, learn)
    row = answers.agg(*(F.coalesce(F.sum(F.col("contexts")[i]), F.lit(0)).alias(f"c{i}") for i in range(DEPTH - UPPER))).first()
    return [len(x.contexts) for x in top.levels[1:]] + list(row)


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """Score all documents (doc_id, text), learning from those of which `learn` holds.

    Rows: doc_id, n_tokens, n_known, train_tokens, base_score, score.
    """
    buckets, words, total, head, scanned, _, answers = _learn(docs, learn)
    rare = _look_up(_rare(scanned, head, buckets), words, buckets)
    chunks = scanned.where("kind = 'chunk'").select("part", "no", F.lit(-3).alias("bucket"), "ids", "tokens", "sizes", "stream", "data")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("tokens", "array<long>"), ("sizes", "array<long>"), ("stream", "binary"))]
    both = chunks.unionByName(rare.select("part", "no", F.when(F.col("own"), -2).otherwise(-1).alias("bucket"), *none, "data")).unionByName(answers.select("part", "no", "bucket", *none, "data"))
    floor = float(np.log10(total["n"] + total["v"] + 1))

    def finish(batches):
        last, own, sums, logs = None, None, None, []

        def flush():
            if own is not None:
                ids, tokens, sizes, stream = own
                tokens = np.array(tokens, dtype=np.int64)
                s, ends = _expand(stream, np.uint8)[0], np.cumsum(np.array(sizes, dtype=np.int64))
                scored = _scored(ends)
                names, back = _numbered(s, scored)
                log = np.empty(len(names))
                log[np.argsort(_bucket_of(names.byteswap(), buckets), kind="stable")] = np.concatenate([_expand(x, np.uint32)[0] for x in logs]) / -float(1 << STEP_BITS)
                along = np.concatenate(([0.0], np.cumsum(log[back], dtype=np.float64)))
                bounds = np.concatenate(([0], ends - DEPTH * np.arange(1, len(ends) + 1)))
                scores = along[bounds[1:]] - along[bounds[:-1]]
                cols = (pa.array(ids, pa.int64()), pa.array(tokens), pa.array(sums["known"].copy()), pa.array(sums["log"] - tokens * floor), pa.array(scores))
                yield pa.RecordBatch.from_arrays(list(cols), names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for part, no, bucket, ids, tokens, sizes, stream, data in zip(*(batch.column(c).to_pylist() for c in ("part", "no", "bucket", "ids", "tokens", "sizes", "stream", "data")), strict=True):
                if (part, no) != last:
                    yield from flush()
                    last, own, sums, logs = (part, no), None, None, []
                if bucket >= 0:
                    logs.append(data)
                    continue
                if bucket == -3:
                    own = (ids, tokens, sizes, stream)
                elif bucket == -2:
                    sums = np.frombuffer(data, dtype=_SUMS).copy()
                else:
                    x = _unpack(data, _SEEN)
                    sums["known"] += np.bincount(x["k"], minlength=len(sums))
                    sums["log"] += np.bincount(x["k"], weights=np.log10(x["n"] + 1.0), minlength=len(sums))
        yield from flush()

    done = map_arrow(both.repartition("part", "no").sortWithinPartitions("part", "no", "bucket"), finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "n_tokens", "n_known", F.lit(int(total["n"])).cast("long").alias("train_tokens"), "base_score", "score")
