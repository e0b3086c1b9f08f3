"""Whole plans: purge of a table, statistics of two, the flagship query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.config import Settings, Strategy, choose_strategy, rate_limited
from loam.functions import text as X
from loam.operators import exact, statistics
from loam.sources import jsonl


def purge(spark: SparkSession, path: str, settings: Settings = Settings(), memory_mb: float = 1e6, seconds_since: float | None = None) -> dict[str, int | str]:
    """Exact dedup of a JSON-lines table in place. Nothing is written without repeats, or if the policy says to skip.

    The texts themselves are shuffled once, to their place in the order. Lines that can't be read go to the text files in ``path`` + ``.unreadable``, in the same step as the table is replaced.
    """
    jsonl.recover(spark, path)
    entries, bad = jsonl.read(spark, path)
    strategy = choose_strategy(entries.count(), memory_mb, seconds_since)
    if strategy is Strategy.SKIP or rate_limited(seconds_since):
        return {"strategy": Strategy.SKIP.value, "removed": 0}
    passed = exact.passing(entries, settings.avoid_apps, settings.min_text_length)
    places = exact.first_places(passed).persist()
    try:
        removed = places.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
        if removed:
            jsonl.replace(jsonl.wire(exact.at_places(passed, places)), path, aside=None if bad.isEmpty() else bad)
    finally:
        places.unpersist()
    return {"strategy": strategy.value, "removed": removed}


def places(settings: Settings) -> int:
    """Fragments that a text may have in ``seq``: never as many as its characters."""
    return max(1000, settings.max_text_length)


def ingest(entries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Raw texts to accepted fragments: length, split, clean, filters, then no text twice in succession."""
    if not settings.data_saving:
        return entries.limit(0)
    whole = entries.where(X.length_within("text", settings.min_text_length, settings.max_text_length))
    parts = whole.select("seq", "app_name", F.posexplode(X.fragments("text")).alias("pos", "part"))
    rows = parts.select((F.col("seq") * places(settings) + F.col("pos")).alias("seq"), "app_name", X.one_line("part").alias("text"))
    return exact.consecutive_dedup(exact.accepted(rows, settings.min_text_length, settings.max_text_length, settings.avoid_apps))


def curated_counts(lines: DataFrame, avoid_apps: Sequence[str] = (), min_length: int = 3, max_length: int = 1000) -> DataFrame:
    """Lines cleaned, filtered and without repeats: their number and length for each source, longest list first."""
    # cleaned in a generator, else each mention in the filters and the result would clean anew
    once = lines.select("app_name", F.explode(F.array(X.one_line("text"))).alias("text")).where(F.length("text") >= min_length)
    clean = exact.accepted(once, min_length, max_length, avoid_apps)
    return statistics.app_statistics(clean).orderBy(F.desc("entries"), "app_name")
