"""Exact deduplication and filters. First wins means least ``seq``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as X


def without_apps(entries: DataFrame, avoid_apps: Sequence[str]) -> DataFrame:
    """Rows of other apps; a null app is no excluded app."""
    return entries if not avoid_apps else entries.where(F.col("app_name").isNull() | ~F.col("app_name").isin(*avoid_apps))


def key_of(name: str) -> Column:
    """A key column as it is compared: texts and apps by their composed form, the rows keep their own."""
    return X.canonical(name) if name in ("app_name", "text") else F.col(name)


def first_of(entries: DataFrame, *keys: str) -> DataFrame:
    """The row of least ``seq`` of each key; only that row of a key leaves a task, so a hot key costs little. Canonically equivalent texts are one key."""
    least = F.min_by(F.struct(*(F.col(c) for c in entries.columns)), F.struct("seq", *(F.col(c) for c in ("app_name", "text")))).alias("row")
    return entries.groupBy(*(key_of(k).alias(f"__{k}") for k in keys)).agg(least).select("row.*")


def passing(entries: DataFrame, avoid_apps: Sequence[str] = (), min_length: int = 0) -> DataFrame:
    """Rows that the filters of exact dedup leave."""
    return without_apps(entries, avoid_apps).where(X.clusters("text") >= min_length)


def exact_dedup(entries: DataFrame, avoid_apps: Sequence[str] = (), min_length: int = 0) -> DataFrame:
    """First row of each text, over all apps, among rows that pass the filters."""
    return first_of(passing(entries, avoid_apps, min_length), "text")


def first_places(entries: DataFrame) -> DataFrame:
    """``seq`` of the first row of each text, and ``n``, its rows; texts meet by their SHA-256, so none is shuffled. ``seq`` names one row."""
    return entries.groupBy(F.unhex(F.sha2(key_of("text"), 256)).alias("digest")).agg(F.min("seq").alias("seq"), F.count("*").alias("n")).select("seq", "n")


def at_places(entries: DataFrame, places: DataFrame) -> DataFrame:
    """Rows whose ``seq`` is among ``places``, in order of ``seq``, by one shuffle; in either table ``seq`` names one row."""
    row = F.struct(*entries.columns)
    rows = entries.select("seq", row.alias("__row"))
    marks = places.select("seq", F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    met = rows.unionAll(marks).repartitionByRange("seq").withColumn("__met", F.count("*").over(Window.partitionBy("seq")))
    return met.where((F.col("__met") == 2) & F.col("__row").isNotNull()).select("__row.*")


def exact_dedup_stats(entries: DataFrame, avoid_apps: Sequence[str] = (), min_length: int = 0) -> DataFrame:
    """Rows processed, kept and removed, and the share removed in percent."""
    passed = passing(entries, avoid_apps, min_length)
    got = passed.groupBy(key_of("text").alias("text")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("processed"), F.count("*").alias("kept"))
    removed = F.col("processed") - F.col("kept")
    return got.select("processed", "kept", removed.alias("removed"), F.when(F.col("processed") > 0, removed / F.col("processed") * 100).otherwise(0.0).alias("reduction_rate"))


def pair_dedup(entries: DataFrame) -> DataFrame:
    """First row of each app and text."""
    return first_of(entries, "app_name", "text")


def accepted(entries: DataFrame, min_length: int = 3, max_length: int | None = 1000, avoid_apps: Sequence[str] = ()) -> DataFrame:
    """Rows that ingestion takes: length within bounds, not symbols alone, app not excluded."""
    return without_apps(entries.where(X.length_within("text", min_length, max_length) & ~X.is_symbol_or_number("text")), avoid_apps)


def consecutive_dedup(entries: DataFrame, within: Sequence[str] = (), span: int = 65_536) -> DataFrame:
    """Rows whose text differs from the row before, in order of ``seq``.

    Order is global unless ``within`` names columns. So that no task takes all
    rows, ``seq`` is cut in spans; each span's last text is handed to the next
    that has rows, and only those few rows meet in one place.
    """
    cut = entries.withColumn("__span", F.floor(F.col("seq") / span)).withColumn("__key", key_of("text"))
    inside = Window.partitionBy(*within, "__span").orderBy("seq")
    last = cut.groupBy(*within, "__span").agg(F.max_by("__key", "seq").alias("__last"))
    over = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy("__span")
    handed = last.withColumn("__before", F.lag("__last").over(over)).drop("__last")
    marked = cut.withColumn("__place", F.row_number().over(inside)).withColumn("__previous", F.lag("__key").over(inside))
    joined = marked.join(handed, [*within, "__span"])
    previous = F.when(F.col("__place") == 1, F.col("__before")).otherwise(F.col("__previous"))
    return joined.where(~F.col("__key").eqNullSafe(previous)).select(*entries.columns)


def last_rows(entries: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of greatest ``seq``, ascending; each task keeps at most ``n``."""
    return entries.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def union_entries(saved: DataFrame, imported: DataFrame) -> DataFrame:
    """All rows of both, saved ones first: ``(source_rank, seq)`` is their order."""
    return saved.withColumn("source_rank", F.lit(0)).unionByName(imported.withColumn("source_rank", F.lit(1)))


def new_entries(lines: DataFrame, existing: DataFrame) -> DataFrame:
    """First row of each app and text that isn't among the existing ones."""
    known = existing.select(key_of("app_name").alias("__app"), key_of("text").alias("__text")).distinct()
    fresh = pair_dedup(lines).withColumns({"__a": key_of("app_name"), "__t": key_of("text")})
    return fresh.join(known, (F.col("__a") == F.col("__app")) & (F.col("__t") == F.col("__text")), "left_anti").select(*lines.columns)


def new_files(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files whose name hasn't been imported."""
    return files.join(status.select("file_name"), "file_name", "left_anti")
