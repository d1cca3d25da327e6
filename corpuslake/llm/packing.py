"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method: items above a third of the capacity fit at most twice in a bin and are paired
greedily, largest first, each with the largest that still fits; smaller items then go,
largest first, into the tightest gap that holds them, and into new bins after that.

Lengths are integers up to the capacity, so the plan needs only the number of items of
each length, at most `capacity` numbers whatever the size of the corpus.  The plan says which
ranks among the items of one length go to which bins; every item finds its own place from
its rank.  So the packing is that of all items together, and no task sees all items.

Cases: a null or empty text is the end id alone; repeated documents are packed each;
an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stash
from .tokens import encoder, text_batches

#: Rows that may be sent to every executor.
SMALL = 200_000
PIECES = "part int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


@dataclass
class _Bins:
    """Bins that are filled alike: how many, the gap, and the (length, first rank) of what they hold, in order."""

    count: int
    gap: int
    items: list[tuple[int, int]] = field(default_factory=list)


def plan(counts: dict[int, int], capacity: int) -> list[_Bins]:
    """Groups of alike bins that hold counts[n] items of each length n < capacity."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)

    def take(n: int, k: int) -> int:
        used[n] += k
        left[n] -= k
        return used[n] - k

    third, done = capacity // 3, []
    large = sorted(n for n in left if 3 * n > capacity)
    gaps: list[int] = []  # sorted gaps of which there are bins
    by_gap: dict[int, list[_Bins]] = {}

    def put(b: _Bins) -> None:
        if b.count <= 0:
            return
        if not b.gap:
            done.append(b)
            return
        if b.gap not in by_gap:
            bisect.insort(gaps, b.gap)
        by_gap.setdefault(b.gap, []).append(b)

    for n in reversed(large):
        while left[n]:
            i = bisect.bisect_right(large, min(n, capacity - n)) - 1
            while i >= 0 and (not left[large[i]] or large[i] == n and left[n] < 2):
                i -= 1
            if i < 0:
                k = left[n]
                put(_Bins(k, capacity - n, [(n, take(n, k))]))
                continue
            m = large[i]
            k = left[n] // 2 if m == n else min(left[n], left[m])
            put(_Bins(k, capacity - n - m, [(n, take(n, k)), (m, take(m, k))]))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        assert n <= third
        while left[n]:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                full, rest = divmod(left[n], each)
                b = _Bins(full + (rest > 0), capacity)
            else:
                b = by_gap[gaps[at]].pop()
                if not by_gap[gaps[at]]:
                    del by_gap[gaps[at]]
                    gaps.pop(at)
                each = min(b.gap // n, left[n])
                full, rest = divmod(left[n], each)
                if full >= b.count:
                    full, rest = b.count, 0
            #: `full` of these bins get `each` items, one gets `rest`, the others stay.
            parts = ((full, each, 0), (int(rest > 0), rest, full), (b.count - full - (rest > 0), 0, full + (rest > 0)))
            for k, per, skip in parts:
                if k > 0:
                    items = [(m, first + skip) for m, first in b.items]
                    put(_Bins(k, b.gap - per * n, items + [(n, take(n, k)) for _ in range(per)]))
    for g in gaps:
        done.extend(by_gap[g])
    return done


def places(bins: list[_Bins]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per length, the (first rank, end rank, first bin, offset) of its runs of ranks, in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for b in bins:
        offset = 0
        for n, first in b.items:
            out.setdefault(n, []).append((first, first + b.count, base, offset))
            offset += n
        base += b.count
    return {n: sorted(x) for n, x in out.items()}


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece; rank counts the pieces of the same length before it in the same partition."""

    def run(batches):
        from pyspark import TaskContext

        kind = encoder(path, True, keeps=True).id_type
        encode, part, seen = encoder(path, True, keeps=True), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch, texts in text_batches(batches):
            rows: list[list] = [[] for _ in range(8)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.many(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                cut = len(ids) % capacity or capacity
                for k, a in enumerate((0, *range(cut, len(ids), capacity))):
                    own = ids[a : cut + k * capacity].astype("<u4")
                    data = own.tobytes()
                    for col, x in zip(rows, (part, int(seen[len(own)]), doc_id, k, a, len(own), zlib.crc32(data), own.astype(kind).tobytes() if keep_ids else None), strict=True):
                        col.append(x)
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["part", "rank", "doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES, remembers=True)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pack every document of (doc_id, text); rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Documents longer than the capacity are cut, the first piece being the shorter one, so all
    others are whole bins.  Sequence ids of whole bins are negative.  The pieces are written
    once to the shared folder, so that ranks given to them hold for good.  With `keep_ids`, ids are the tokens of the
    piece, little-endian, 16 bits each where all ids of the tokenizer fit, else 32.
    """
    spark = docs.sparkSession
    pieces = stash(token_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    whole = pieces.where(F.col("length") == capacity).select("*", (-1 - F.col("rank") - (F.col("part").cast("long") * (1 << 40))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.where(F.col("length") < capacity)
    sizes = part.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    #: At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = [(n, [dict(zip(("lo", "hi", "bin", "at"), x, strict=True)) for x in v]) for n, v in places(plan(counts, capacity)).items()]
    where = F.broadcast(spark.createDataFrame(runs, "length long, runs array<struct<lo:long,hi:long,bin:long,at:long>>"))
    #: A row per partition and length; sent to executors only while that is small, then no piece is shuffled.
    before = F.broadcast(before) if sizes.count() <= SMALL else before
    ranked = part.join(before, ["part", "length"]).join(where, "length").withColumn("global", F.col("rank") + F.col("before"))
    own = F.filter("runs", lambda r: (r["lo"] <= F.col("global")) & (F.col("global") < r["hi"]))[0]
    placed = ranked.withColumn("run", own).select("*", (F.col("run.bin") + F.col("global") - F.col("run.lo")).alias("sequence_id"), F.col("run.at").alias("offset"))
    return whole.select(*out).unionByName(placed.select(*out))
