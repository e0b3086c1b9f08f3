"""Import of text, Markdown and PDF files, once for each file name."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators.exact import new_entries, new_files
from loam.schema import STATUS
from loam.sources import jsonl

EXTENSIONS = ("txt", "md", "pdf")
MAX_PDF_BYTES = 50 * 1024 * 1024
Extractor = Callable[[bytes], "list[str] | None"]


def files(spark: SparkSession, folder: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Files directly in a folder with a supported extension, in any case; PDF files not beyond their limit. Empty files aren't listed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.*").load(folder)
    named = found.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("modificationTime").alias("last_modified"), "length", "content")
    kind = X.extension_of("file_name")
    return named.withColumn("kind", kind).where(F.col("kind").isin(*extensions) & ((F.col("kind") != "pdf") | (F.col("length") <= MAX_PDF_BYTES)))


def contents(found: DataFrame, pdf: Extractor | None = None) -> DataFrame:
    """``file_name, last_modified, text``; text is null where it can't be read.

    Text and Markdown have to be UTF-8. ``pdf`` gives a file's pages as texts, or
    None if it can't (damaged, locked, no pages); without it PDF files are skipped.
    """
    plain = found.where("kind <> 'pdf'").select("file_name", "last_modified", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"))
    if pdf is None:
        return plain

    @F.pandas_udf("string")
    def pages(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([None if not (got := pdf(b)) else "\n".join(got) for b in p])

    return plain.unionByName(found.where("kind = 'pdf'").select("file_name", "last_modified", pages("content").alias("text")))


def file_lines(read: DataFrame, min_length: int) -> DataFrame:
    """Trimmed lines that are long enough; the app is the file's name without its extension."""
    each = read.where(F.col("text").isNotNull()).select("file_name", F.posexplode(X.lines("text")).alias("pos", "line"))
    rows = each.select("file_name", "pos", X.app_of("file_name").alias("app_name"), X.trimmed("line").alias("text"))
    return rows.where((F.col("text") != "") & (X.clusters("text") >= min_length)).withColumn("seq", F.struct("file_name", "pos"))


def status(spark: SparkSession, path: str) -> DataFrame:
    """What has been imported; nothing if the table isn't there."""
    if not jsonl.exists(spark, path):
        return spark.createDataFrame([], STATUS)
    return spark.read.schema(STATUS).json(path)


def updated(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files that were imported and have changed since."""
    return found.join(known.select("file_name", F.col("last_modified").alias("seen")), "file_name").where("last_modified > seen").drop("seen")


def upsert_status(known: DataFrame, done: DataFrame) -> DataFrame:
    return known.join(done.select("file_name"), "file_name", "left_anti").unionByName(done)


def run(spark: SparkSession, folder: str, saved: DataFrame, import_path: str, status_path: str, min_length: int = 5, pdf: Extractor | None = None) -> int:
    """Import the files that weren't yet: lines that aren't among the saved entries are appended; returns the files read."""
    known = status(spark, status_path)
    read = contents(new_files(files(spark, folder), known), pdf).cache()
    fresh = new_entries(file_lines(read, min_length).select("seq", "app_name", "text"), saved)
    rows = fresh.select(F.monotonically_increasing_id().alias("seq"), "app_name", "text", F.current_timestamp().alias("ts"))
    jsonl.append(rows, import_path)
    now = F.current_timestamp()
    done = read.where(F.col("text").isNotNull()).select("file_name", now.alias("import_date"), X.import_name("file_name", now).alias("jsonl_file_name"), "last_modified")
    count = done.count()
    if count:
        jsonl.replace(upsert_status(known, done), status_path)
    read.unpersist()
    return count


def reset(spark: SparkSession, import_path: str, status_path: str) -> None:
    jsonl.delete(spark, import_path)
    jsonl.delete(spark, status_path)
