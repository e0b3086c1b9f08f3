"""App lists: running apps, search, exclusion for display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running(apps: DataFrame) -> DataFrame:
    """Names, sorted and distinct, of apps ``(app_name, policy)`` of regular policy; null names go."""
    return apps.where((F.col("policy") == "regular") & F.col("app_name").isNotNull()).select("app_name").distinct().orderBy("app_name")


def search(apps: DataFrame, query: str) -> DataFrame:
    """Apps whose name has the query in it, in any case; all for an empty query."""
    return apps if not query else apps.where(F.contains(F.lower("app_name"), F.lit(query.lower())))


def listed(apps: DataFrame, avoid_apps: Sequence[str]) -> DataFrame:
    """Apps and excluded apps together, each once, with whether it is excluded."""
    spark = apps.sparkSession
    excluded = spark.createDataFrame([(a,) for a in avoid_apps], "app_name string")
    return apps.select("app_name").union(excluded).distinct().withColumn("excluded", F.col("app_name").isin(*avoid_apps) if avoid_apps else F.lit(False)).orderBy("app_name")


def excluded_present(apps: DataFrame, avoid_apps: Sequence[str]) -> DataFrame:
    """Excluded apps that are among ``apps``."""
    excluded = apps.sparkSession.createDataFrame([(a,) for a in avoid_apps], "app_name string")
    return excluded.join(apps.select("app_name"), "app_name", "left_semi")
