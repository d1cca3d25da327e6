"""Exact top-k inner products, pruned a block at a time.

Vectors are cut into blocks by ranges of their id.  A block carries, for each dimension, the largest
and the smallest component in it; for a query the sum over dimensions of the larger product is a
bound for all scores in the block.  A query visits blocks by falling bound, scores a block
through its forward index (the matrix of its vectors), and stops when the bound is below its k-th score.

Blocks are dealt to groups and queries to batches; each (batch, group) is one piece of work with bounded
memory, and the k best of a query over all groups are merged at the end.  Blocks travel to every batch of
queries, in the smallest integers that hold them: bounds save work, not the way.

Cases: vectors that are null or hold a null, NaN or infinite component take no part, as query or
candidate; shorter vectors count as padded with zeros; repeated ids are rows of their own, and only the
query's own row is left out; ties go to the smaller id; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stash

#: Vectors of a block, blocks of a group, queries of a batch.
BLOCK, GROUP, BATCH = 1024, 32, 4096


def usable(vectors: DataFrame, embedding: str) -> DataFrame:
    e = F.col(embedding)
    fine = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(e.isNotNull() & fine)


def _blocks(vectors: DataFrame, every: int) -> DataFrame:
    """(kind, part, no, ids, rows, matrix, width): blocks of all vectors and batches of the queries, cut within each partition."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds = {"block": BLOCK, "batch": BATCH}
        ready: dict[str, list] = {k: [] for k in kinds}
        count = dict.fromkeys(kinds, 0)

        def emit(kind, own):
            width = max(len(r) for _, _, r in own)
            m = np.zeros((len(own), width), dtype="<i8")
            for at, (_, _, r) in enumerate(own):
                m[at, : len(r)] = r
            no = count[kind]
            count[kind] += 1
            least, most = int(m.min(initial=0)), int(m.max(initial=0))
            m = m.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= least and most <= np.iinfo(t).max))
            cols = ([kind], [part], [no], [np.array([i for i, _, _ in own], dtype="<i8").tobytes()], [np.array([p for _, p, _ in own], dtype="<i8").tobytes()], [m.tobytes()], [width])
            types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "part", "no", "ids", "rows", "matrix", "width"])

        at = 0
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                row = (i, (part << 40) + at, v)
                at += 1
                ready["block"].append(row)
                if i % every == 0:
                    ready["batch"].append(row)
                for kind, most in kinds.items():
                    if len(ready[kind]) >= most:
                        yield emit(kind, ready[kind])
                        ready[kind] = []
        for kind in kinds:
            if ready[kind]:
                yield emit(kind, ready[kind])

    return map_arrow(vectors, run, "kind string, part int, no int, ids binary, rows binary, matrix binary, width int")


class _Block:
    def __init__(self, ids: bytes, rows: bytes, matrix: bytes, width: int) -> None:
        self.ids, self.rows = np.frombuffer(ids, dtype="<i8"), np.frombuffer(rows, dtype="<i8")
        #: In the smallest integers that hold the block.
        m = np.frombuffer(matrix, dtype=f"<i{len(matrix) // max(1, len(self.ids) * width)}") if matrix else np.zeros(0, dtype="<i8")
        self.matrix = m.reshape(len(self.ids), width).astype(np.int64)
        self.most, self.least = self.matrix.max(0), self.matrix.min(0)


def _widen(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[-1] == width else np.concatenate((a, np.zeros((*a.shape[:-1], width - a.shape[-1]), dtype=a.dtype)), axis=-1)


def _product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q @ m.T; in floating point where all sums are exact there, else in 64-bit integers."""
    width = max(q.shape[1], m.shape[1])
    q, m = _widen(q, width), _widen(m, width)
    size = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * width
    return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64) if size < 2**53 else q @ m.T


def _search(q: _Block, blocks: list[_Block], k: int):
    """(query index, id, row, score) arrays of the k best of each query over the blocks."""
    n = len(q.ids)
    width = max([q.matrix.shape[1], *(b.matrix.shape[1] for b in blocks)])
    qm = _widen(q.matrix, width)
    up, down = np.maximum(qm, 0), np.minimum(qm, 0)
    bound = np.stack([_product(up, _widen(b.most[None], width))[:, 0] + _product(down, _widen(b.least[None], width))[:, 0] for b in blocks], axis=1)
    order = np.argsort(-bound, axis=1, kind="stable")
    floor = np.iinfo(np.int64).min
    score = np.full((n, k), floor)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    rows = np.full((n, k), np.iinfo(np.int64).max)
    for turn in range(len(blocks)):
        choice = order[:, turn]
        alive = bound[np.arange(n), choice] >= score[:, -1]
        if not alive.any():
            break
        for b in np.unique(choice[alive]):
            own = np.flatnonzero(alive & (choice == b))
            block = blocks[b]
            got = _product(qm[own], block.matrix)
            got[q.rows[own][:, None] == block.rows[None, :]] = floor
            keep = min(k, got.shape[1])
            #: The k-th best score of the block; ties with it come along.
            least = np.partition(got, got.shape[1] - keep, axis=1)[:, got.shape[1] - keep]
            i, j = np.nonzero((got >= np.maximum(least, score[own, -1])[:, None]) & (got > floor))
            all_i = np.concatenate((np.repeat(np.arange(len(own)), k), i))
            all_s = np.concatenate((score[own].ravel(), got[i, j]))
            all_id = np.concatenate((ids[own].ravel(), block.ids[j]))
            all_row = np.concatenate((rows[own].ravel(), block.rows[j]))
            o = np.lexsort((all_row, all_id, -all_s.astype(np.float64) if np.abs(all_s[all_s > floor]).max(initial=0) < 2**53 else np.argsort(np.argsort(-all_s)), all_i))
            first = np.searchsorted(all_i[o], np.arange(len(own)))
            top = o[first[:, None] + np.arange(k)[None, :]]
            score[own], ids[own], rows[own] = all_s[top], all_id[top], all_row[top]
    i, j = np.nonzero(score > floor)
    return i, ids[i, j], rows[i, j], score[i, j]


def search(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query (ids divisible by `every`)."""
    components = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    ints = usable(vectors.where(F.col(vec_id).isNotNull()), embedding).select(F.col(vec_id).cast("long").alias("id"), components.alias("v"))
    cut = stash(_blocks(ints.repartitionByRange(F.col("id")).sortWithinPartitions("id"), every), "blocks")

    def numbered(kind: str, per: int, name: str) -> tuple[DataFrame, int]:
        """Rows of a kind, numbered by their place in the order of ids (one row per block), `per` under one number."""
        own = cut.where(F.col("kind") == kind)
        place = own.select("part", "no").withColumn(name, ((F.row_number().over(Window.orderBy("part", "no")) - 1) / per).cast("int"))
        out = own.join(place, ["part", "no"]).select(name, *(F.col(c).alias(c) for c in ("ids", "rows", "matrix", "width")))
        return out, max(1, -(-own.count() // per))

    queries, n_batches = numbered("batch", 1, "batch")
    blocks, n_groups = numbered("block", GROUP, "grp")
    work_q = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    work_b = blocks.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))

    def run(key, left, right):
        blocks = [_Block(r.ids, r.rows, r.matrix, r.width) for r in right.itertuples()]
        import pandas as pd

        out = []
        for r in left.itertuples():
            q = _Block(r.ids, r.rows, r.matrix, r.width)
            if blocks:
                i, ids, rows, score = _search(q, blocks, k)
                out.append(pd.DataFrame({"query_id": q.ids[i], "query_row": q.rows[i], "vec_id": ids, "row": rows, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "query_row", "vec_id", "row", "score")})

    found = work_q.groupBy("batch", "grp").cogroup(work_b.groupBy("batch", "grp")).applyInPandas(run, "query_id long, query_row long, vec_id long, row long, score long")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
