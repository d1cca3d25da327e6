"""Shared pieces: chunks of text, word hashes, calls of Arrow functions.

Text kernels work on the UTF-8 bytes of a few megabytes of documents at once,
so that the work for a word is a handful of NumPy operations, never a Python loop.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, partitions, shared_dir, ship, stash, table

__all__ = ["bound_batches", "partitions", "shared_dir", "ship", "stash", "table"]

#: Bytes of text that a kernel takes at once (a longer document is taken alone).
CHUNK_BYTES = 2 << 20
#: Characters between words in the contracts: \x20 and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, mod n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def release() -> None:
    """Give back what this process no longer uses; allocators would keep it for the worker's life."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def forget() -> None:
    """Drop the pieces that this worker has remembered for a tokenizer."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens is not None:
        tokens._open.clear()


def map_arrow(df: DataFrame, func, schema: str, remembers: bool = False) -> DataFrame:
    """`remembers`: the tasks use what a worker remembers of tokenizers; others drop it."""
    ship(df.sparkSession)

    def run(batches):
        if not remembers:
            forget()
        yield from func(batches)
        release()

    return df.mapInArrow(run, schema)


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about `limit` bytes of column text, with the texts as bytes (null: empty)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).cast(pa.large_binary())
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        ends, start = np.cumsum(size), 0
        while start < len(size):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start), [x or b"" for x in col.slice(start, stop - start).to_pylist()]
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordHasher:
    """64-bit hashes of the words of many texts by prefix sums of a polynomial modulo 2**64.

    `separators` end words; with `lower`, A-Z count as a-z.  The base is odd, so it
    has an inverse and the sum over a word can be moved to the same origin wherever it stands.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, separators: bytes = SPACES, lower: bool = False) -> None:
        self.is_space = np.zeros(256, dtype=bool)
        self.is_space[list(separators)] = True
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        self.value = mix(fold.astype(np.uint64) + np.uint64(0x1234567))
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, CHUNK_BYTES + (1 << 16))
            inv = pow(self.BASE, -1, 1 << 64)
            for name, x in (("powers", self.BASE), ("inverse", inv)):
                p = np.full(size, x, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first word of each text and the end, buffer, start and end byte of each word)."""
        buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        space = self.is_space[buf]
        space[-1] = True  # the joining blanks are separators whatever the set
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        doc_end = np.cumsum(size)
        space[doc_end - 1] = True
        edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self._grow(len(buf))
        sums = np.empty(len(buf) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(self.value[buf] * self.powers[: len(buf)], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        first = np.concatenate(([0], np.searchsorted(starts, doc_end)))
        return h, first, buf, starts, ends


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (over text borders too; the caller leaves those out)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[i : i + n]
    return mix(h)


def crc_ids(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
