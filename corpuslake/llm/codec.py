"""Token ids as files of range-coded blocks.

A block is up to BLOCK ids; its header has the number of ids, the number of bytes and a CRC-32 of the ids.
Its contexts start anew, so it is decoded without the others.  Three predictions are mixed for each id: the
last id seen after the two before it (order 2), the last id seen after the one before it (order 1), and id
frequencies (order 0).  The share of an id is the sum of the weights of the predictions that are of it, order 0
giving its weight to all other ids by their frequencies.  The mixture drives a range coder with a 64-bit range.
(Order 0 also gives the ids predicted by the others a part that isn't used.)

The contexts and the confidence in them adapt with each id.  The weights in each state (both confidences, and
whether the first two agree) follow the place in the block, in _PARTS parts, and order 0 has the frequencies of
the ids that it codes: both are counted over the up to 1.5 LANES blocks of a group and stand before them.

A decoder can't look ahead, so blocks are the lanes of NumPy arrays: one step codes one id in every lane.

Files are rows of (part, seq, doc_ids, lengths, n_tokens, data) in ascending order of doc_id, data being whole
blocks; they are written by Spark's writer, so a lost executor leaves no half-written file.

Cases: null and empty texts are the end id alone; repeated ids are ordered by a hash of their text; a null
doc_id comes first; an empty table gives no rows; other columns are left out; ids may be up to 65,535.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_ids, map_arrow, stash
from .tokens import encoder, text_batches

BLOCK, LANES = 4096, 1536
_HEAD = struct.Struct("<III")
#: Slots of each order's table in a lane, as a power of two, and the parts of a block with weights of their own.
_SLOT_BITS, _PARTS = 12, 8
#: Binary digits of weights and of order-0 frequencies; both together divide the range.
_WEIGHT_BITS, _COUNT_BITS = 12, 18
_ALL = 1 << _COUNT_BITS
_BITS = np.uint64(_WEIGHT_BITS + _COUNT_BITS)
_WORD, _LEAST, _FULL = np.uint64(32), np.uint64(1 << 32), np.uint64((1 << 64) - 1)
#: Largest id; table entries are laid out for it.
TOP_ID = (1 << 16) - 1
#: Table entries are an id and two bits of confidence; no id is NONE.
_NONE = TOP_ID + 1
#: Confidence of an entry whose id came (by the one before) or didn't come (the last).
_SURER = np.array([1, 2, 3, 3, 0], np.uint32)
#: Steps whose arrays are computed together.
_STEPS = 16


def _key(ids: np.ndarray) -> np.ndarray:
    return ids * np.uint32(0x9E3779B1)


def _turned(key: np.ndarray) -> np.ndarray:
    """The key of an id as the earlier one of two."""
    return (key >> np.uint32(7)) * np.uint32(0x85EBCA6B)


class _Contexts:
    """The last id seen after each context of orders 1 and 2, in the tables of n lanes."""

    def __init__(self, n: int) -> None:
        self.last = np.full(2 * n << _SLOT_BITS, _NONE << 2, np.uint32)
        self.base = (np.arange(2 * n, dtype=np.uint32) << np.uint32(_SLOT_BITS)).reshape(2, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Places of the contexts with these keys (order, lane)."""
        return ((keys >> np.uint32(32 - _SLOT_BITS)) + self.base[:, : keys.shape[-1]]).astype(np.intp)

    def learn(self, at: np.ndarray, e: np.ndarray, x4: np.ndarray) -> None:
        self.last[at] = x4 | _SURER.take(np.minimum(e ^ x4, np.uint32(4)))


def _state(e1: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Of 32: both confidences, and whether the two orders agree (their shares are then one)."""
    return (e1 & np.uint32(3)) | (e2 & np.uint32(3)) << np.uint32(2) | ((e1 ^ e2) < 4).astype(np.uint32) << np.uint32(4)


def _portions(counts: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers from 1 in proportion to the counts of a row, `total` in all."""
    n = np.maximum(counts.sum(-1, keepdims=True), 1)
    f = 1 + counts * (total - counts.shape[-1]) // n
    f[np.arange(len(f)), f.argmax(-1)] += total - f.sum(-1)
    return f


class _Model:
    """What the blocks of a group share: weights of order 2, 1 and 0 by part and state, and the order-0 frequencies."""

    def __init__(self, weights: np.ndarray, ids: np.ndarray, freq: np.ndarray) -> None:
        self.weights, self.ids, self.freq = weights, ids, freq
        w = weights.astype(np.int64)
        self.low = (np.cumsum(w, axis=1) - w << _COUNT_BITS).reshape(_PARTS, -1)
        self.weight = w.reshape(_PARTS, -1)
        #: An id that order 0 doesn't code, NONE, takes the whole weight.
        self.size, self.start = np.zeros(_NONE + 1, np.int64), np.zeros(_NONE + 1, np.int64)
        self.size[ids], self.size[_NONE] = freq, _ALL
        self.start[ids] = np.cumsum(freq) - freq

    @classmethod
    def fit(cls, seen: np.ndarray, new: np.ndarray) -> _Model:
        """From how often each order was right, by part and state, and the counts of the ids that order 0 codes."""
        ids = np.flatnonzero(new)
        return cls(_portions(seen.reshape(-1, 3), 1 << _WEIGHT_BITS), ids, _portions(new[ids][None], _ALL)[0])

    def packed(self) -> bytes:
        return zlib.compress(self.weights.astype("<u2").tobytes() + np.diff(self.ids, prepend=0).astype("<u2").tobytes() + (self.freq - 1).astype("<u4").tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> _Model:
        raw = zlib.decompress(data)
        at = _PARTS * 32 * 3 * 2
        k = (len(raw) - at) // 6
        weights = np.frombuffer(raw, "<u2", _PARTS * 32 * 3).reshape(-1, 3)
        return cls(weights, np.cumsum(np.frombuffer(raw, "<u2", k, at), dtype=np.int64), np.frombuffer(raw, "<u4", k, at + 2 * k).astype(np.int64) + 1)


def _part(t: int) -> int:
    return t * _PARTS // BLOCK


def _code_blocks(blocks: list[np.ndarray]) -> tuple[_Model, list[bytes]]:
    size = np.array([len(b) for b in blocks])
    order = np.argsort(-size, kind="stable")
    n, longest = len(blocks), int(size.max())
    ids = np.zeros((longest, n), np.uint16)
    for lane, b in enumerate(order):
        ids[: size[b], lane] = blocks[b]
    active = np.searchsorted(-size[order], -np.arange(longest), side="left")

    # What the contexts say of each id: its state, and which order is the first to be right.
    contexts, how = _Contexts(n), np.empty((longest, n), np.uint8)
    seen, new = np.zeros((_PARTS, 128), np.int64), np.zeros(_NONE, np.int64)
    before = np.zeros((2, n), np.uint32)
    for t in range(0, longest, _STEPS):
        x = ids[t : t + _STEPS].astype(np.uint32)
        key = np.concatenate((before, _key(x)))
        before = key[-2:]
        at = contexts.slots(np.stack((key[1:-1], key[1:-1] ^ _turned(key[:-2])), axis=1))
        e = np.empty(at.shape, np.uint32)
        x4 = x << np.uint32(2)
        for i in range(len(x)):
            m = active[t + i]
            if m == n:
                contexts.last.take(at[i], out=e[i], mode="clip")
                contexts.learn(at[i], e[i], x4[i])
            else:
                e[i, :, :m] = contexts.last[at[i, :, :m]]
                contexts.learn(at[i, :, :m], e[i, :, :m], x4[i, :m])
        e1, e2 = e[:, 0], e[:, 1]
        right = np.where((e2 ^ x4) < 4, 0, np.where((e1 ^ x4) < 4, np.uint32(1), np.uint32(2)))
        how[t : t + _STEPS] = _state(e1, e2) << np.uint32(2) | right
        valid = np.arange(n) < active[t : t + _STEPS, None]
        seen[_part(t)] += np.bincount(how[t : t + _STEPS][valid], minlength=128)
        new += np.bincount(x[valid & (right == 2)], minlength=_NONE)
    del contexts, e, at
    model = _Model.fit(seen.reshape(_PARTS, 32, 4)[:, :, :3], new)

    low, wide = np.zeros(n, np.uint64), np.full(n, _FULL, np.uint64)
    out, pos = np.zeros((longest + 3, n), np.uint64), np.zeros(n, np.int64)
    flat, lane = out.reshape(-1), np.arange(n)
    for t in range(0, longest, _STEPS):
        code = how[t : t + _STEPS]
        y = np.where(code & 3 == 2, ids[t : t + _STEPS].astype(np.int64), _NONE)
        own = (code >> 2) * np.intp(3) + (code & 3)
        weight = model.weight[_part(t)].take(own)
        lows = (model.low[_part(t)].take(own) + weight * model.start.take(y)).astype(np.uint64)
        sizes = (weight * model.size.take(y)).astype(np.uint64)
        for i in range(len(code)):
            m = active[t + i]
            r = wide[:m] >> _BITS
            step = r * lows[i, :m]
            low[:m] += step
            np.multiply(r, sizes[i, :m], out=wide[:m])
            over = np.flatnonzero(low[:m] < step)
            if len(over):
                flat[(pos[over] - 1) * n + over] += np.uint64(1)
            w = np.flatnonzero(wide[:m] < _LEAST)
            if len(w):
                a = low[w]
                flat[pos[w] * n + w] = a >> _WORD
                pos[w] += 1
                low[w] = a << _WORD
                wide[w] <<= _WORD
    for shift in (_WORD, np.uint64(0)):
        flat[pos * n + lane] = (low >> shift) & (_LEAST - np.uint64(1))
        pos += 1
    out = out[: pos.max()]
    while len((carry := np.nonzero(out >> _WORD))[0]):
        out[carry] &= _LEAST - np.uint64(1)
        out[carry[0] - 1, carry[1]] += np.uint64(1)
    words = np.ascontiguousarray(out.T.astype("<u4"))
    result: list[bytes] = [b""] * n
    for i, b in enumerate(order):
        result[b] = words[i, : pos[i]].tobytes()
    return model, result


def _decode_blocks(model: _Model, data: list[bytes], size: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(-size, kind="stable")
    n, longest = len(data), int(size.max())
    #: A damaged block may ask for more words than it has.
    words = np.zeros((n, max(map(len, data)) // 4 + 3), np.uint64)
    for lane, b in enumerate(order):
        words[lane, : len(data[b]) // 4] = np.frombuffer(data[b], "<u4", len(data[b]) // 4)
    width, flat = words.shape[1], words.reshape(-1)
    ids = np.zeros((longest, n), np.uint16)
    contexts = _Contexts(n)
    value, wide = words[:, 0] << _WORD | words[:, 1], np.full(n, _FULL, np.uint64)
    pos = np.arange(n) * width + 2
    end = pos + width - 3
    symbol = np.repeat(model.ids.astype(np.uint32), model.freq)
    start, sizes = model.start, model.size
    last = len(symbol) - 1
    active = np.searchsorted(-size[order], -np.arange(longest), side="left")
    keys, before = np.zeros((2, n), np.uint32), np.zeros(n, np.uint32)
    for t in range(longest):
        m, part = int(active[t]), _part(t)
        if t % (BLOCK // _PARTS) == 0:
            low, weight = model.low[part], model.weight[part]
            per = 1 / weight
            second, third = low[1::3].copy(), low[2::3].copy()
        at = contexts.slots(keys[:, :m])
        e = contexts.last.take(at)
        state = _state(e[0], e[1]).astype(np.intp)
        r = wide[:m] >> _BITS
        v = (value[:m] // r).view(np.int64)
        old = v >= third.take(state)
        own = state * 3 + (v >= second.take(state)) + old
        base, w = low.take(own), weight.take(own)
        u = ((v - base + 0.5) * per.take(own)).astype(np.intp)
        y = np.where(old, symbol.take(u, mode="clip"), np.uint32(_NONE))
        x = np.where(old, y, np.where(own == state * 3, e[1], e[0]) >> np.uint32(2))
        value[:m] -= r * (base + w * start.take(y)).view(np.uint64)
        np.multiply(r, (w * sizes.take(y)).view(np.uint64), out=wide[:m])
        k = np.flatnonzero(wide[:m] < _LEAST)
        if len(k):
            value[k] = value[k] << _WORD | flat.take(np.minimum(pos[k], end[k]))
            pos[k] += 1
            wide[k] <<= _WORD
        ids[t, :m] = x
        contexts.learn(at, e, x << np.uint32(2))
        np.multiply(x, np.uint32(0x9E3779B1), out=keys[0, :m])
        np.bitwise_xor(keys[0, :m], before[:m], out=keys[1, :m])
        before[:m] = _turned(keys[0, :m])
    result: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for lane, b in enumerate(order):
        result[b] = ids[: size[b], lane]
    return result


def encode_ids(ids: np.ndarray) -> bytes:
    """Blocks of a run of ids, each with its header, in groups with theirs; an id above TOP_ID is an error."""
    if len(ids) and int(ids.max()) > TOP_ID:
        raise ValueError(f"ids go up to {TOP_ID}, not {int(ids.max())}")
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    out, groups = [], max(1, round(len(blocks) / LANES))  # of like sizes: a step of few lanes takes as long as one of many
    for i in range(groups if blocks else 0):
        own = blocks[len(blocks) * i // groups : len(blocks) * (i + 1) // groups]
        model, coded = _code_blocks(own)
        packed = model.packed()
        out += [_HEAD.pack(len(own), len(packed), zlib.crc32(packed)), packed]
        for b, data in zip(own, coded, strict=True):
            out += [_HEAD.pack(len(b), len(data), crc_ids(b)), data]
    return b"".join(out)


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of whole blocks; a block that doesn't give the ids of its checksum is an error."""
    out, at = [np.zeros(0, np.uint16)], 0
    while at < len(data):
        n, size, crc = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        if zlib.crc32(data[at : at + size]) != crc:
            raise ValueError("the model of a group doesn't match its checksum")
        model = _Model.unpacked(data[at : at + size])
        at += size
        heads, parts = [], []
        for _ in range(n):
            heads.append(_HEAD.unpack_from(data, at))
            at += _HEAD.size
            parts.append(data[at : at + heads[-1][1]])
            at += heads[-1][1]
        got = _decode_blocks(model, parts, np.array([h[0] for h in heads]))
        for h, x in zip(heads, got, strict=True):
            if crc_ids(x) != h[2]:
                raise ValueError("a block doesn't match its checksum")
        out += got
    return np.concatenate(out)


_FILE = "part int, seq int, doc_ids array<long>, lengths array<long>, n_tokens long, data binary"


def write(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode (doc_id, text) in ascending order of doc_id; the rows of the files."""

    def run(batches):
        from pyspark import TaskContext

        encode, part, seq = encoder(tokenizer, False, keeps=True).many, TaskContext.get().partitionId(), 0
        ids, runs, size = [], [], 0

        def flush():
            data = encode_ids(np.concatenate(runs))
            cols = ([part], [seq], [ids], [[len(r) for r in runs]], [size], [data])
            types = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "seq", "doc_ids", "lengths", "n_tokens", "data"])

        for batch, texts in text_batches(batches):
            for i, own in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids.append(i)
                runs.append(np.append(own, np.uint32(end_id)))
                size += len(runs[-1])
                if size >= 2 * BLOCK * LANES:
                    yield flush()
                    ids, runs, size, seq = [], [], 0, seq + 1
        if runs:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return stash(map_arrow(ordered, run, _FILE, remembers=True), "token-files")


def read(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for part, seq, ids, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_ids", "lengths", "data")), strict=True):
                x = decode_ids(data)
                ends = np.cumsum(lengths)
                crc = [crc_ids(x[e - n : e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                k = len(ids)
                cols = ([part] * k, [seq] * k, ids, ends - np.array(lengths), lengths, crc)
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    found = map_arrow(files, run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    #: One row per partition of the files.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = files.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("inside"))
    base = own.join(before, "part").select("part", "seq", (F.col("inside") + F.col("before")).alias("base"))
    return found.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
