"""Per-app and per-script statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators.exact import without_apps


def scoped(saved: DataFrame, imported: DataFrame) -> DataFrame:
    """Each row twice: under its own source and under ``combined``."""
    both = saved.withColumn("source", F.lit("saved")).unionByName(imported.withColumn("source", F.lit("import")))
    return both.withColumn("scope", F.explode(F.array("source", F.lit("combined")))).drop("source")


def distinct_pairs(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row of each app and text, with the number of rows that it stands for."""
    return rows.groupBy(*by, "app_name", "text").agg(F.count("*").alias("copies"))


def app_counts(entries: DataFrame) -> DataFrame:
    """Rows of each app, neither filtered nor without repeats."""
    return entries.groupBy("app_name").agg(F.count("*").alias("n"))


def app_statistics(entries: DataFrame, avoid_apps: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Distinct texts and their total length, of each app that isn't excluded."""
    return without_apps(distinct_pairs(entries, by), avoid_apps).groupBy(*by, "app_name").agg(F.count("*").alias("entries"), F.sum(X.clusters("text")).cast("bigint").alias("chars"))


def totals(entries: DataFrame, avoid_apps: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Entries, characters, mean length, repeats removed, and characters of each class with truncated percentages.

    Repeats are counted before apps are excluded; the mean is an integer, 0 of nothing.
    """
    ok = F.lit(True) if not avoid_apps else F.col("app_name").isNull() | ~F.col("app_name").isin(*avoid_apps)
    t = F.col("text")
    sums = [F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).cast("bigint").alias(c) for c, n in (("entries", F.lit(1)), ("chars", X.clusters(t)), ("ja", X.count_japanese(t)), ("en", X.count_english(t)), ("num", X.count_numbers(t)))]
    got = distinct_pairs(entries, by).groupBy(*by).agg(*sums, F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("duplicates"))
    got = got.withColumn("other", F.col("chars") - F.col("ja") - F.col("en") - F.col("num"))
    share = lambda c: F.when(F.col("chars") > 0, F.floor(F.col(c) / F.col("chars") * 100)).otherwise(0).cast("bigint").alias(f"{c}_percent")
    mean = F.when(F.col("entries") > 0, F.expr("chars div entries")).otherwise(0).cast("bigint").alias("mean_chars")
    return got.select(*by, "entries", "chars", mean, "duplicates", "ja", "en", "num", "other", *map(share, ("ja", "en", "num", "other")))


def language_mix(entries: DataFrame, avoid_apps: Sequence[str] = ()) -> DataFrame:
    """Characters of each class in long form, with a rank: by number, ``Other`` last."""
    t = totals(entries, avoid_apps)
    long = t.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value"), F.lit(int(k == "Other")).alias("last")) for k, c in (("JA", "ja"), ("EN", "en"), ("Num", "num"), ("Other", "other"))))).alias("x")).select("x.*")
    return long.orderBy("last", F.desc("value"), "key").select("key", "value")


def top_and_others(counts: DataFrame, key: str, value: str, n: int = 5, always_others: bool = True) -> DataFrame:
    """The ``n`` greatest rows, ties by key, and the sum of the rest as ``Others``."""
    top = counts.orderBy(F.desc(value), key).limit(n).select(F.col(key).alias("key"), F.col(value).cast("bigint").alias("value"))
    sums = counts.agg(F.coalesce(F.sum(value), F.lit(0)).alias("all")).crossJoin(top.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("some")))  # one row each
    rest = sums.select(F.lit("Others").alias("key"), (F.col("all") - F.col("some")).cast("bigint").alias("value"))
    return top.unionByName(rest if always_others else rest.where("value > 0"))


def first_n(counts: DataFrame, value: str, key: str, n: int | None = None) -> DataFrame:
    ordered = counts.orderBy(F.desc(value), key)
    return ordered if n is None else ordered.limit(n)


def separated_statistics(saved: DataFrame, imported: DataFrame, avoid_apps: Sequence[str] = ()) -> DataFrame:
    """``totals`` of the saved rows, the imported ones and both together, in one pass; repeats are per scope."""
    return totals(scoped(saved, imported), avoid_apps, ["scope"])


def summary(total: DataFrame, source: str = "combined") -> DataFrame:
    """One text from one row of ``totals``."""
    lines = [F.format_string("Source: %s", F.lit(source)), *(F.format_string(f"{name}: %d", c) for name, c in (("Entries", "entries"), ("Characters", "chars"), ("Mean characters", "mean_chars")))]
    mix = [F.format_string(f"{name}: %d (%d%%)", c, f"{c}_percent") for name, c in (("Japanese", "ja"), ("English", "en"), ("Numbers", "num"), ("Other", "other"))]
    return total.select(F.concat_ws("\n", *lines, *(F.when(F.col("chars") > 0, m) for m in mix), F.format_string("Duplicates removed: %d", "duplicates")).alias("summary"))


def ranked(counts: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """Rank of each row within ``by``, by value and then by key."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), key)))
