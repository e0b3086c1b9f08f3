"""JSON-lines sources and sinks, with quarantine of what can't be read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators.exact import without_apps
from loam.schema import WIRE

#: Within a new table, lines to set aside; readers pass over names that begin so.
ASIDE = "_unreadable"


def read(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries and quarantined lines of JSON-lines files.

    A line is quarantined if it isn't JSON of the schema or lacks a field. Blank
    lines are ignored. ``seq`` counts lines, by path and by place in the file,
    however Spark deals files to tasks: a first pass counts the lines of each block
    of a file that one task reads, and blocks in order give the lines before each.
    """
    value = F.col("value")
    # between the two renames of a replacement that was cut off the table is beside its place
    places = [p.rstrip("/") + ".old" if not glob(p) and not exists(spark, p) and exists(spark, p.rstrip("/") + ".old") else p for p in ([path] if isinstance(path, str) else path)]
    raw = spark.read.text(places).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    blocks = raw.groupBy("file", "start").agg(F.min("place").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy(F.lit(0)).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))  # one row for each block
    blocks = blocks.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    # told to be small, as its estimated size is that of the files: else every line is shuffled to meet its block
    rows = raw.where(X.trimmed(value) != "").join(F.broadcast(blocks), ["file", "start"]).withColumn("seq", F.col("place") + F.col("shift"))
    parsed = rows.withColumn("e", F.from_json("value", WIRE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("e._bad").isNull() & F.col("e.appName").isNotNull() & F.col("e.text").isNotNull() & F.col("e.timestamp").isNotNull()
    entries = parsed.where(good).select("seq", F.col("e.appName").alias("app_name"), F.col("e.text").alias("text"), X.from_reference_seconds("e.timestamp").alias("ts"))
    return entries, parsed.where(~good | F.col("e").isNull()).select("value")


def glob(path: str) -> bool:
    return any(c in path for c in "*?[{")


def read_good(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries alone; lines that can't be read are skipped."""
    return read(spark, path)[0]


def wire(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("app_name").alias("appName"), "text", X.to_reference_seconds("ts").alias("timestamp"))


def append(entries: DataFrame, path: str, avoid_apps: Sequence[str] = (), min_length: int = 0) -> None:
    """Add rows that pass the filters of writing, length at least and app, as new part files; no line is ever joined to another."""
    recover(entries.sparkSession, path)
    wire(without_apps(entries, avoid_apps).where(X.clusters("text") >= min_length)).write.mode("append").json(path)


def quarantine(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.write.mode(mode).text(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def delete_empty(spark: SparkSession, path: str) -> int:
    """Delete files without bytes in a folder; returns their number."""
    fs, p = filesystem(spark, path)
    empty = [s.getPath() for s in fs.listStatus(p) if s.isFile() and s.getLen() == 0]
    for e in empty:
        fs.delete(e, False)
    return len(empty)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename, or fail."""
    fs, here = filesystem(spark, source)
    if not fs.rename(here, filesystem(spark, target)[1]):
        raise OSError(f"{source} can't be moved to {target}")


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a replacement of the table at ``path`` that was cut off.

    The step that counts is the rename of the new table. Before it the old table is
    in its place, or beside it and comes back; after it the old one goes, and lines
    that were set aside with the new table are moved to their files, one rename each.
    """
    path = path.rstrip("/")
    if not exists(spark, path):
        if exists(spark, path + ".old"):
            moved(spark, path + ".old", path)
    else:
        delete(spark, path + ".old")
    delete(spark, path + ".new")
    fs, aside = filesystem(spark, f"{path}/{ASIDE}")
    if fs.exists(aside):
        fs.mkdirs(filesystem(spark, path + ".unreadable")[1])
        for f in fs.listStatus(aside):
            if f.getPath().getName().startswith("part-"):
                moved(spark, f.getPath().toString(), f"{path}.unreadable/{f.getPath().getName()}")
        delete(spark, aside.toString())


def replace(df: DataFrame, path: str, fmt: str = "json", aside: DataFrame | None = None) -> bool:
    """Put ``df`` in the place of the table at ``path``: written beside it, then renamed; the old one comes back on failure.

    Nothing is done, and False returned, if ``df`` has no rows. ``df`` may read from
    ``path``. Lines ``aside`` are added to the text files in ``path`` + ``.unreadable``:
    they are written within the new table and so come with it, once. A run that is
    cut off at any step is finished or undone by the next write (``recover``); one
    writer at a time.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    recover(spark, path)
    df.write.format(fmt).save(path + ".new")
    if spark.read.format(fmt).schema(df.schema).load(path + ".new").isEmpty():
        delete(spark, path + ".new")
        return False
    if aside is not None:
        aside.write.text(f"{path}.new/{ASIDE}")
    swap(spark, path)
    return True


def swap(spark: SparkSession, path: str) -> None:
    """Put what was written to ``path`` + ``.new`` in its place."""
    if exists(spark, path):
        moved(spark, path, path + ".old")
    try:
        moved(spark, path + ".new", path)
    finally:
        recover(spark, path)
