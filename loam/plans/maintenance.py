"""Upkeep of a log: paths, import counters, and the purges and training runs that are due, carried out."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from loam.config import Level, Settings, next_daily_run, purge_due
from loam.operators import exact, ngrams, statistics
from loam.plans import curation
from loam.sources import imports, jsonl


@dataclass(frozen=True)
class Locations:
    """Paths below one root folder."""

    root: str

    # fixed values
    MODELS, ENTRIES, IMPORTED, STATUS, RUNS = "p13n_v1", "p13n_v1/textEntry/savedTexts.jsonl", "p13n_v1/textEntry/import.jsonl", "p13n_v1/textEntry/import_status.jsonl", "p13n_v1/textEntry/import_runs.json"

    def __getattr__(self, name: str) -> str:
        fixed = {"models": self.MODELS, "entries": self.ENTRIES, "imported": self.IMPORTED, "status": self.STATUS, "runs": self.RUNS}
        if name not in fixed:
            raise AttributeError(name)
        return f"{self.root.rstrip('/')}/{fixed[name]}"


def import_folder(spark: SparkSession, folder: str | None) -> str | None:
    """The folder to import from; None if none is set, it isn't there, isn't a folder, or can't be listed."""
    if not folder:
        return None
    try:
        fs, path = jsonl.filesystem(spark, folder)
        if not fs.getFileStatus(path).isDirectory():
            return None
        fs.listStatus(path)
    except Exception:  # noqa: BLE001 - whatever the file system says, there is no import then
        return None
    return folder


def attempts(run: Callable, times: int = 3, wait_s: float = 0.1):
    """What ``run`` returns, tried so many times; for the driver's own file operations, as Spark tries tasks again itself."""
    for left in range(times - 1, -1, -1):
        try:
            return run()
        except Exception:
            if not left:
                raise
            time.sleep(wait_s)


def import_runs(spark: SparkSession, at: Locations) -> tuple[datetime | None, int]:
    """When files were last looked for and how many the last import that found some read; -1 before the first."""
    if not jsonl.exists(spark, at.runs):
        return None, -1
    row = json.loads(spark.read.text(at.runs).first()[0])
    return (datetime.fromisoformat(row["date"]) if row["date"] else None), row["files"]


def import_files(spark: SparkSession, at: Locations, folder: str | None, now: datetime, min_length: int = 5, pdf: imports.Extractor | None = None) -> int:
    """Import new files of a folder and note the run; nothing is noted if the folder can't be read."""
    found = import_folder(spark, folder)
    if found is None:
        return 0
    for path in (at.entries, at.imported, at.status, at.runs):
        jsonl.recover(spark, path)
    saved = jsonl.read_good(spark, at.entries) if jsonl.exists(spark, at.entries) else spark.createDataFrame([], "seq long, app_name string, text string, ts timestamp")
    count = imports.run(spark, found, saved, at.imported, at.status, min_length, pdf)
    files = count or import_runs(spark, at)[1]
    jsonl.replace(spark.createDataFrame([(json.dumps({"date": now.isoformat(), "files": files}),)], "value string"), at.runs, "text")
    return count


def reset_imports(spark: SparkSession, at: Locations) -> None:
    """Forget all imports: their lines, the files' status and the counters."""
    imports.reset(spark, at.imported, at.status)
    jsonl.delete(spark, at.runs)


def train_due(counter: int, written: int, settings: Settings = Settings()) -> bool:
    """Whether an incremental training run is due after a write of so many rows."""
    return written > 0 and counter % settings.train_every == 0


def after_save(spark: SparkSession, at: Locations, counter: int, new: DataFrame, level: Level, settings: Settings = Settings()) -> list[str]:
    """After ``new`` rows were saved: the training run and the purge that the counter makes due; returns their names."""
    ran = []
    if train_due(counter, 0 if new.isEmpty() else 1, settings) and ngrams.extend(new.select("text"), at.models, settings.ngram_size):
        ran.append("train")
    if purge_due(counter, level) and jsonl.exists(spark, at.entries):
        curation.purge(spark, at.entries, settings)
        ran.append("purge")
    return ran


def purge_interval(low_memory: bool) -> timedelta:
    """Time between periodic purges: an hour, twice that while memory is low."""
    return timedelta(hours=2 if low_memory else 1)


def daily(spark: SparkSession, at: Locations, now: datetime, due: datetime | None, settings: Settings = Settings()) -> datetime | None:
    """Rebuild the n-gram tables from all entries if ``due`` has come; returns the next time, None if learning is off."""
    if not settings.auto_learning:
        return None
    if due is not None and now < due:
        return due
    if due is not None:
        for path in (at.entries, at.imported):
            jsonl.recover(spark, path)
        tables = [jsonl.read_good(spark, p) if jsonl.exists(spark, p) else None for p in (at.entries, at.imported)]
        if any(t is not None for t in tables):
            saved, imported = (t if t is not None else next(x for x in tables if x is not None).limit(0) for t in tables)
            ngrams.rebuild(ngrams.corpus(saved, imported), at.models, settings.ngram_size)
    return next_daily_run(now, settings)


def flush(query: StreamingQuery) -> None:
    """Write all that a stream's source holds by now."""
    query.processAllAvailable()


def shut_down(spark: SparkSession, query: StreamingQuery, path: str, settings: Settings = Settings()) -> dict[str, int | str]:
    """Flush and stop a stream, then purge the table that it wrote a last time."""
    flush(query)
    query.stop()
    return curation.purge(spark, path, settings) if jsonl.exists(spark, path) else {"strategy": "skip", "removed": 0}


def purged_statistics(spark: SparkSession, path: str, settings: Settings = Settings()) -> DataFrame:
    """``totals`` of one table, purged first."""
    curation.purge(spark, path, settings)
    return statistics.totals(jsonl.read_good(spark, path), settings.avoid_apps)


def valid_file(spark: SparkSession, path: str) -> bool:
    """Whether a model file is there and has bytes."""
    fs, p = jsonl.filesystem(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile() and fs.getFileStatus(p).getLen() > 0


def reunited(unprocessed: DataFrame, purged: DataFrame) -> DataFrame:
    """Rows that a purge hasn't reached, then those that it kept."""
    return exact.union_entries(unprocessed, purged)
