"""Token ids and blocks: encoding, packing of a run of documents into blocks of one length, reading them back.

Blocks cross document borders and don't overlap; a last block that isn't full is dropped.  Documents
run in ascending doc_id; the offset of each comes from a two-level prefix sum, so no task sees all of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructType

from ..functions import text as T
from ..session import bound_batches, ship
from .clean import hash_split, prefix_sum

#: Ids of the block format fit 16 bits.
MOST_IDS = 1 << 16
#: Bytes of text and ids that a tokenizer takes at once (a longer text is taken alone); what it holds for them is some hundred times as large.
RUN_BYTES, RUN_IDS = 1 << 18, 1 << 16
_open: dict = {}


def _tokenizer(path: str):
    if path not in _open:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _open[path] = Tokenizer.from_file(path)
    return _open[path]


def vocabulary_size(path: str) -> int:
    """Size of a tokenizer's vocabulary; an error where the block format can't hold it."""
    n = _tokenizer(path).get_vocab_size()
    if n > MOST_IDS:
        raise ValueError(f"blocks hold vocabularies up to {MOST_IDS} ids, not {n}")
    return n


def token_id(path: str, token: str) -> int:
    """The id of a token; KeyError if there is none."""
    found = _tokenizer(path).token_to_id(token)
    if found is None:
        raise KeyError(token)
    return found


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes add up to `most` at most; a larger row is a run of its own."""
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def _encoded(texts: pa.Array, path: str) -> Iterator[tuple[list[str], list[list[int]]]]:
    """Runs of texts (null: empty) with their ids."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for start, stop in _runs(sizes, RUN_BYTES):
        some = [x or "" for x in texts.slice(start, stop - start).to_pylist()]
        yield some, [e.ids for e in _tokenizer(path).encode_batch_fast(some, add_special_tokens=False)]


def _decoded(ids: list[list[int]], path: str) -> Iterator[str]:
    for start, stop in _runs(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)), RUN_IDS):
        yield from _tokenizer(path).decode_batch(ids[start:stop])


def _arrow(run, kind: DataType, column: Column) -> Column:
    from pyspark.sql import SparkSession

    ship(SparkSession.active())
    bound_batches(SparkSession.active())
    return F.arrow_udf(run, kind)(column)


def encode(text: Column, path: str, bos: int | None = None, eos: int | None = None) -> Column:
    """Token ids of whole texts (null: none), between the ids `bos` and `eos` where given."""

    def run(batch: pa.Array) -> pa.Array:
        first, last = [] if bos is None else [bos], [] if eos is None else [eos]
        found = [np.array(first + x + last, dtype=np.int32) for _, some in _encoded(batch, path) for x in some]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *found])))

    return _arrow(run, ArrayType(IntegerType()), text)


def decode(ids: Column, path: str) -> Column:
    def run(batch: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        return pa.array([t for a, b in _runs(sizes, RUN_IDS) for t in _decoded([x or [] for x in batch.slice(a, b - a).to_pylist()], path)], pa.string())

    return _arrow(run, StringType(), ids)


def round_trip(text: Column, path: str) -> Column:
    """How many ids a whole text (null: empty) has, and whether they give it back; the ids stay in the worker."""

    def run(batch: pa.Array) -> pa.Array:
        sizes, same = [], []
        for texts, ids in _encoded(batch, path):
            sizes += map(len, ids)
            same += [a == b for a, b in zip(texts, _decoded(ids, path), strict=True)]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(same, pa.bool_())], ["n_tokens", "same"])

    return _arrow(run, StructType().add("n_tokens", IntegerType()).add("same", BooleanType()), text)


def word_ids(text: Column) -> Column:
    """Stand-in ids of the words between blanks (their length and 10), then an end of 1; what SQL can state of an encoder."""
    ws = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^ \n]+"), F.lit(0))
    return F.concat(F.transform(ws, lambda w: F.length(w) + 10), F.array(F.lit(1)))


def blocks(docs: DataFrame, ids: Column, length: int, order: str = "doc_id") -> DataFrame:
    """(block, tokens) of all whole blocks of the documents' ids in ascending `order`."""
    if length < 1:
        raise ValueError("block length must be positive")
    tokens = docs.select(order, ids.alias("ids")).withColumn("n", F.size("ids").cast("long"))
    placed = prefix_sum(tokens.where("n > 0"), order, "n", "start")
    #: A document is cut where blocks begin; a block is put together from its parts, at most `length` of them.
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n") - 1) / length)
    parts = placed.select("start", "ids", "n", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.lit(0), F.col("block") * length - F.col("start"))
    hi = F.least(F.col("n"), (F.col("block") + 1) * length - F.col("start"))
    cut = parts.select("block", "start", F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    whole = cut.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("p")).select("block", F.flatten("p.part").alias("tokens"))
    return whole.where(F.size("tokens") == length)


def pairs(blocks: DataFrame) -> DataFrame:
    """Inputs and targets of each block: all ids but the last, all but the first."""
    n = F.size("tokens")
    return blocks.select("block", F.slice("tokens", F.lit(1), n - 1).alias("inputs"), F.slice("tokens", F.lit(2), n - 1).alias("targets"))


def packed(blocks: DataFrame) -> DataFrame:
    """Blocks as little-endian 16-bit binary, the form of the block files."""
    two = lambda x: F.concat(F.substr(F.hex(x.cast("long")), F.lit(-2), F.lit(2)))
    low = F.transform("tokens", lambda x: F.concat(F.lpad(two(x % 256), 2, "0"), F.lpad(two(F.floor(x / 256)), 2, "0")))
    return blocks.select("block", F.unhex(F.array_join(low, "")).alias("data"))


def unpacked(files: DataFrame, length: int) -> DataFrame:
    """Blocks from their binary form; a block of another size is an error."""
    size = F.octet_length("data")
    checked = F.when(size == 2 * length, F.hex("data")).otherwise(F.raise_error(F.concat(F.lit("a block has "), size.cast("string"), F.lit(" bytes"))))
    at = lambda i: F.conv(F.concat(F.substr("h", i * 4 + 3, F.lit(2)), F.substr("h", i * 4 + 1, F.lit(2))), 16, 10).cast("int")
    return files.select("block", checked.alias("h")).select("block", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at).alias("tokens"))


def prepare(docs: DataFrame, ids: Column, fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """The first document of each text with its split, language, ids and words: doc_id, language, split, ids, n_tokens, n_words."""
    if not 0 <= fraction < 1:
        raise ValueError("the validation fraction must be in [0, 1)")
    first = docs.where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("doc_id", "text", "lang")).alias("d")).select("d.*")
    split = hash_split(first, fraction, seed)
    return split.select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("language"), "split", ids.alias("ids"), F.regexp_count("text", F.lit(T.WORD)).alias("n_words")).withColumn("n_tokens", F.size("ids"))


def token_stats(prepared: DataFrame) -> DataFrame:
    """Documents, tokens and words by split and language, with totals (null), tokens a word and share of all tokens in percent."""
    from pyspark.sql import Window

    by = prepared.cube("split", "language").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").cast("long").alias("tokens"), F.sum("n_words").cast("long").alias("words"))
    every = F.max(F.when(F.col("g") == 3, F.col("tokens"))).over(Window.partitionBy(F.lit(0)))  # a row per split and language
    per_word = F.round(F.col("tokens") / F.greatest(F.lit(1), F.col("words")), 4)
    return by.select("split", "language", "docs", "tokens", "words", per_word.alias("tokens_per_word"), F.round(F.col("tokens") * 100.0 / F.greatest(F.lit(1), every), 4).alias("token_share"))
