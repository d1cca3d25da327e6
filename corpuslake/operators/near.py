"""Near duplicates by 64-bit SimHash: fingerprints, banded pairs, and the greedy first-wins rule.

A document goes if an earlier document that stayed is within the Hamming distance, in the order given.
That isn't connected components: of a chain A~B~C with A and C apart, A and C stay.  The result is the
lexicographically first maximal independent set of the pairs, found in rounds: a document whose smaller
neighbours have all gone stays, one with a smaller neighbour that stayed goes.

Equal fingerprints are collapsed to their first document first, so a hot group of copies is one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import text as T
from ..session import ship, stash

#: First bit and width of the bands.
BANDS = ((0, 22), (22, 21), (43, 21))
SHINGLE, MOST_SHINGLES = 5, 4096


def _bits(names: np.ndarray) -> int:
    """A bit is set where at least half of the names have it."""
    ones = ((names[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
    return int(np.bitwise_or.reduce(np.where(2 * ones >= len(names), np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))))


def fingerprint(words: list[str], kind: str = "blake2b") -> int:
    """SimHash of lower-case words; 0 with fewer than five."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return 0
    name = (lambda b: hashlib.blake2b(b, digest_size=8).digest()) if kind == "blake2b" else (lambda b: hashlib.md5(b, usedforsecurity=False).digest()[:8])
    at = range(0, n, max(1, n // MOST_SHINGLES))
    return _bits(np.frombuffer(b"".join(name(" ".join(words[i : i + SHINGLE]).encode()) for i in at), dtype=">u8").astype(np.uint64))


def simhash(words: Column, kind: str = "blake2b") -> Column:
    """Fingerprints of word arrays as signed 64-bit patterns."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([fingerprint([] if ws is None else list(ws), kind) for ws in batch], dtype="uint64").astype("int64")

    ship(__import__("pyspark").sql.SparkSession.active())
    return F.pandas_udf(run, LongType())(words)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pairs(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of orders a < b whose fingerprints fp share a band and differ in at most `distance` bits; fp must be distinct."""
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1).alias("key")) for i, (s, w) in enumerate(BANDS)])
    banded = prints.select("ord", "fp", F.explode(keys).alias("k")).select("ord", "fp", "k.band", "k.key")
    other = banded.select(F.col("ord").alias("b"), F.col("fp").alias("fpb"), "band", "key")
    near = banded.join(other, ["band", "key"]).where((F.col("ord") < F.col("b")) & (hamming(F.col("fp"), F.col("fpb")) <= distance))
    return near.select(F.col("ord").alias("a"), "b").distinct()


def greedy(edges: DataFrame) -> DataFrame:
    """(ord, stays) of all documents with a pair (a, b), a < b."""
    open_, done = stash(edges, "edges"), None
    while True:
        nodes = open_.select(F.col("a").alias("ord")).union(open_.select(F.col("b").alias("ord"))).distinct()
        free = nodes.join(open_.select(F.col("b").alias("ord")), "ord", "left_anti")
        gone = open_.join(free.withColumnRenamed("ord", "a"), "a", "left_semi").select(F.col("b").alias("ord")).distinct()
        now = stash(free.select("ord", F.lit(True).alias("stays")).unionByName(gone.select("ord", F.lit(False).alias("stays"))), "decided")
        done = now if done is None else done.unionByName(now)
        left = open_.join(now.select(F.col("ord").alias("a")), "a", "left_anti").join(now.where("NOT stays").select(F.col("ord").alias("b")), "b", "left_anti").select("a", "b")
        #: Nodes whose last smaller neighbour has gone stand without an edge and stay.
        alone = nodes.join(now, "ord", "left_anti")
        open_ = stash(left, "edges")
        alone = alone.join(open_.select(F.col("a").alias("ord")).union(open_.select(F.col("b").alias("ord"))), "ord", "left_anti")
        done = done.unionByName(stash(alone.select("ord", F.lit(True).alias("stays")), "alone"))
        if open_.isEmpty():
            return done


def dedup(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(ord, sha, fp) -> (ord, verdict): kept, exact (text of a kept row) or near, by the combined greedy rule."""
    held = stash(prints.select("ord", "sha", "fp"), "prints")
    first = stash(held.groupBy("fp").agg(F.min(F.struct("ord", "sha")).alias("f")).select("fp", F.col("f.ord").alias("ord"), F.col("f.sha").alias("first_sha")), "first")
    decided = greedy(pairs(first, distance))
    leaders = first.join(decided, "ord", "left").select("fp", F.col("ord").alias("leader"), "first_sha", F.coalesce("stays", F.lit(True)).alias("stays"))
    named = held.join(leaders, "fp")
    verdict = F.when(F.col("stays") & (F.col("ord") == F.col("leader")), "kept").when(F.col("stays") & (F.col("sha") == F.col("first_sha")), "exact").otherwise("near")
    return named.select("ord", verdict.alias("verdict"))


def near_duplicates(docs: DataFrame, distance: int = 2, kind: str = "blake2b") -> DataFrame:
    """doc_id and verdict of every document with a text, in the order of doc_id."""
    ws = F.transform(T.words(F.col("text")), F.lower)
    prints = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("sha"), simhash(ws, kind).alias("fp"))
    return dedup(prints, distance).select(F.col("ord").alias("doc_id"), "verdict")
