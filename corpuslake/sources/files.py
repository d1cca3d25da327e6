"""Readers of text and JSON-lines files, lenient and strict, and digests of files.

Files are found by Spark (`pathGlobFilter`, recursive), so any store that Spark reads will do.
Text files are whole-file rows; JSON-lines files are read by line, so a large one is split among tasks.
Order is by path and place in the file, carried as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import git_blob_sha

OPTIONAL = ("source_url", "title", "language_hint")


def find(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("txt", "jsonl"), strict: bool = False) -> DataFrame:
    """(path, bytes) of the input files in order of path, manifests left out; an error where there are none.

    `strict`: files of other suffixes are an error too.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    fits = F.lower(F.col("path")).rlike(rf"\.({'|'.join(suffixes)})$") & ~F.col("path").endswith("/raw_manifest.json")
    if strict and not every.where(~fits).isEmpty():
        raise ValueError(f"files other than {suffixes} in {path}")
    found = every.where(fits)
    if found.isEmpty():
        raise FileNotFoundError(f"no files {suffixes} in {path}")
    return found.orderBy("path")


def _relative(root: str) -> Column:
    """Path below the folder that was read; the name alone of a file that was read itself."""
    where = F.regexp_replace(F.input_file_name(), "^[a-z]+:/+", "/")
    base = root.split("://")[-1].rstrip("/") + "/"
    return F.when(where.contains(base), F.substring_index(where, base, -1)).otherwise(F.substring_index(where, "/", -1))


def source_id(relative: Column) -> Column:
    """Identifier of a source by its path; fixed values for one folder and two books, else the file's stem."""
    name = F.substring_index(relative, "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return (
        F.when(F.array_contains(F.split(relative, "/"), "rsd"), "rsd_public_domain")
        .when(name.startswith("project_gutenberg_1228"), "gutenberg_origin_species_1228")
        .when(name.startswith("project_gutenberg_944"), "gutenberg_voyage_beagle_944")
        .otherwise(stem)
    )


def _whole_texts(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return raw.select(_relative(path).alias("source_path"), F.lit(0).cast("long").alias("line"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "").alias("value"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    at = F.monotonically_increasing_id()  # ascending within a file's part; parts of a file are read in order of their start
    return raw.select(_relative(path).alias("source_path"), at.alias("line"), F.is_valid_utf8("value").alias("valid"), F.regexp_replace(F.make_valid_utf8("value"), "^﻿", "").alias("value")).where(~F.col("value").rlike(r"(?U)\A[\s\x1c-\x1f]*\z"))


def _typed(lines: DataFrame, text_key: str = "text") -> DataFrame:
    """Adds `text` (of a JSON string, or of an object's text field), null for what is neither, and the optional fields."""
    v = F.when(F.col("valid"), F.try_parse_json("value"))
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    kind = lambda x: F.schema_of_variant(x) == "STRING"
    field = F.try_variant_get(v, f"$.{text_key}", "variant")
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(kind(field), get(text_key))
    extra = [F.when(kind(F.try_variant_get(v, f"$.{k}", "variant")), get(k)).alias(k) for k in (*OPTIONAL, "language")]
    return lines.select("source_path", "line", text.alias("text"), get("source_id").alias("sid"), get("source_path").alias("spath"), *extra)


def read_lenient(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of all text and JSON-lines files.

    Rows: text, source_id, source_path, source_url, title, language_hint, line.  Rejects: source_path, line; a text
    file that isn't UTF-8, a line that isn't JSON, or JSON without a text.  Blank lines are passed over.
    """
    whole, typed = _whole_texts(spark, path), _typed(_lines(spark, path))
    none = [F.lit(None).cast("string").alias(c) for c in OPTIONAL]
    rows = whole.where("valid").select(F.col("value").alias("text"), source_id(F.col("source_path")).alias("source_id"), "source_path", *none, "line")
    stem = F.regexp_replace(F.substring_index("source_path", "/", -1), r"\.[^.]*$", "")
    more = typed.where("text IS NOT NULL").select("text", F.coalesce("sid", stem).alias("source_id"), F.coalesce("spath", "source_path").alias("source_path"), *OPTIONAL, "line")
    bad = whole.where("NOT valid").select("source_path", "line").unionByName(typed.where("text IS NULL").select("source_path", "line"))
    return rows.unionByName(more), bad


def records(spark: SparkSession, path: str, text_key: str = "text") -> DataFrame:
    """(source_path, line, nth, text, language) of strict files, normalised, without empty texts.

    A text file is split at blank lines, or where there are none, into its lines that aren't blank.
    Anything but UTF-8 text and JSON with a text is an error when the rows are read.
    """
    from ..functions.unicode import nfc

    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what} in "), "source_path", F.lit(":"), F.col("line").cast("string")))
    whole = _whole_texts(spark, path).withColumn("value", F.when(F.col("valid"), F.col("value")).otherwise(fail("bad UTF-8")))
    parts = F.split("value", r"\n\s*\n")
    lines = F.filter(F.split("value", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.btrim(x) != "")
    chosen = F.when((F.size(parts) == 1) & (F.size(lines) > 1), lines).otherwise(parts)
    texts = whole.select("source_path", "line", F.posexplode(chosen).alias("nth", "text"), F.lit(None).cast("string").alias("language"))
    typed = _typed(_lines(spark, path), text_key).select("source_path", "line", F.lit(0).alias("nth"), F.when(F.col("text").isNotNull(), F.col("text")).otherwise(fail("no text")).alias("text"), "language")
    normal = F.btrim(nfc(F.regexp_replace("text", "\r\n?", "\n")), F.lit(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"))
    return texts.unionByName(typed).withColumn("text", normal).where("text != ''")


def distinct_records(rows: DataFrame) -> DataFrame:
    """The first record of each text, in order of path, line and place."""
    place = F.struct("source_path", "line", "nth", "language")
    return rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(place).alias("p"), F.min("text").alias("text"), F.count(F.lit(1)).alias("copies")).select("p.*", "text", "copies")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha1, sha256, git_sha) of files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"), git_blob_sha(F.col("content")).alias("git_sha"))


def select_entries(tree: DataFrame, folders: tuple[str, ...], most_bytes: int) -> DataFrame:
    """The text blobs (path, type, size) of a listing below some folders; an error if they are larger than allowed together."""
    below = F.exists(F.array(*map(F.lit, folders)), lambda f: F.col("path").startswith(f))
    chosen = tree.where((F.col("type") == "blob") & F.col("path").endswith(".txt") & below)
    total = chosen.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if total > most_bytes:
        raise ValueError(f"{total} bytes are more than the {most_bytes} allowed")
    return chosen
