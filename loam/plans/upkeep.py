"""Upkeep that a running stream makes due: counters carried by observed metrics, purges and training started by a query listener."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from loam.config import PURGE_EVERY, Level, Settings
from loam.operators import exact
from loam.plans.maintenance import purge_interval
from loam.sources.log import Log

METRIC = "saved"


def counted(saved: DataFrame) -> DataFrame:
    """The stream of saved rows, with their number as a metric of each batch."""
    return saved.observe(METRIC, F.count(F.lit(1)).alias("rows"))


def purge_log(spark: SparkSession, path: str, settings: Settings = Settings()) -> int:
    """Exact dedup of a table with a commit log; rows added meanwhile stay as they are. Returns the rows removed."""
    log = Log(spark, path)
    of = log.state()
    rows = log.read(of.version).select(F.monotonically_increasing_id().alias("seq"), F.col("appName").alias("app_name"), "text", "timestamp")
    stats = exact.exact_dedup_stats(rows, settings.avoid_apps, settings.min_text_length).first()
    if stats["removed"]:
        kept = exact.exact_dedup(rows, settings.avoid_apps, settings.min_text_length)
        log.replace(kept.orderBy("seq").select(F.col("app_name").alias("appName"), "text", "timestamp"), of)
    return stats["removed"]


class Upkeep(StreamingQueryListener):
    """Runs ``purge`` and ``train`` when the rows saved by a stream, or the time since, make them due.

    A multiple of the level's number of rows, or of ``train_every``, that is reached or
    passed makes one run due, however many batches it took. The runs are made one after
    the other on a thread of their own, so the stream's events don't wait for them;
    runs of a kind that became due while one was waiting are one. ``join`` waits for what is due.
    """

    def __init__(self, purge: Callable[[], object], train: Callable[[], object] | None = None, level: Level = Level.NORMAL, settings: Settings = Settings(), low_memory: bool = False, counter: int = 0, clock: Callable[[], float] = time.monotonic) -> None:
        self.runs = {"purge": purge, "train": train}
        self.every = {"purge": PURGE_EVERY.get(level), "train": settings.train_every if train else None}
        self.counter, self.clock, self.made = counter, clock, []
        self.interval, self.last = purge_interval(low_memory).total_seconds(), clock()
        self.due: queue.Queue = queue.Queue()
        self.waiting: set[str] = set()
        threading.Thread(target=self._work, daemon=True).start()

    def _work(self) -> None:
        while True:
            name = self.due.get()
            self.waiting.discard(name)
            try:
                self.runs[name]()
                self.made.append(name)
            except Exception as e:  # noqa: BLE001 - upkeep that fails is due again later, the stream goes on
                self.made.append(f"{name} failed: {type(e).__name__}")
            finally:
                self.due.task_done()

    def _ask(self, name: str) -> None:
        if name == "purge":
            self.last = self.clock()
        if name not in self.waiting:
            self.waiting.add(name)
            self.due.put(name)

    def add(self, rows: int) -> None:
        """So many more rows were saved."""
        before, self.counter = self.counter, self.counter + rows
        for name, every in self.every.items():
            if every and self.counter // every > before // every:
                self._ask(name)
        if self.every["purge"] and self.clock() - self.last >= self.interval:
            self._ask("purge")

    def join(self) -> None:
        self.due.join()

    def onQueryStarted(self, event) -> None:  # noqa: N802 - names of the interface
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(METRIC)
        self.add(row["rows"] if row is not None else 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.add(0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
