"""Buffered ingestion as state and timers: what was last accepted, how much waits to be saved, and when it was last saved.

A text's accepted fragments go to a buffer unless they repeat the last accepted one.
After each text the buffer is saved if it holds enough rows, if the last saving was
long enough ago, or if nothing was saved yet; a timer saves what waits when no text
comes. State is one digest and three numbers for each key. What is decided depends on the
text before, so one task decides, but from a row of digests and a number for each text; the texts
themselves are spread over all tasks and meet the decisions where a batch is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loam.config import Settings, flush_due
from loam.functions import text as X
from loam.operators.exact import without_apps
from loam.plans.upkeep import METRIC
from loam.sources import jsonl
from loam.sources.log import Log

#: A row that waits: whose key it is of, and its place.
WAITING = "key string, place long, pos int, app_name string, text string, ts timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What leaves the state: texts, those of which the first fragment is ``again`` the last accepted one, and the place ``upto`` which a key's rows are saved.
DECIDED = "kind string, key string, place long, id long, nth long, app_name string, texts string, ts timestamp, saves long"
#: The place of a text without ``seq``, after all others; and groups that texts pass the state in.
LAST, GROUPS = 2**63 - 1, 64


class Buffer(StatefulProcessor):
    """Decisions for one key; or texts of one group, which only get numbers among their like."""

    def __init__(self, settings: Settings = Settings()) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "digest string")
        self.waiting = handle.getValueState("waiting", "n long")
        self.saved = handle.getValueState("saved", "at long, number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        given = pd.concat(list(rows))
        like = ["key", "place", "id"]
        if key[0] == "text":
            yield given.assign(nth=given.groupby(like).cumcount(), saves=0)[names(DECIDED)]
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        last = self.last.get()[0] if self.last.exists() else None
        at, number = self.saved.get() if self.saved.exists() else (None, -1)
        waiting = self.waiting.get()[0] if self.waiting.exists() else 0
        given = given.sort_values(["place", "id"])
        places, again, saves, upto = given.place.tolist(), [], 0, None
        for i, (first, end, n) in enumerate(zip(given["first"].tolist(), given["end"].tolist(), given.n.tolist(), strict=True)):
            again.append(first == last)
            waiting, last = waiting + n - (first == last), end
            if waiting and (i + 1 == len(places) or places[i + 1] != places[i]) and flush_due(waiting, None if at is None else (now - at) / 1000, False, self.settings):
                at, number, saves, upto, waiting = now, number + 1, saves + waiting, places[i], 0
        self.last.update((last,))
        self.waiting.update((waiting,))
        if at is not None:
            self.saved.update((at, number))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.handle.registerTimer(int(now + self.settings.save_interval_s * 1000))
        repeats = given.assign(nth=given.groupby(like).cumcount())[again]
        if len(repeats):
            yield repeats.assign(kind="again", app_name=None, texts=None, ts=pd.NaT, saves=0)[names(DECIDED)]
        if upto is not None:
            yield self._upto(key[1], upto, saves)

    def _upto(self, key: str, place: int, saves: int) -> pd.DataFrame:
        return pd.DataFrame([("upto", key, place, 0, 0, None, None, pd.NaT, saves)], columns=names(DECIDED))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = self.waiting.get()[0] if self.waiting.exists() else 0
        if waiting:
            number = (self.saved.get()[1] if self.saved.exists() else -1) + 1
            self.saved.update((timerValues.getCurrentProcessingTimeInMs(), number))
            self.waiting.update((0,))
            yield self._upto(key[1], LAST, waiting)

    def close(self) -> None:
        pass


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def runs(stream: DataFrame, settings: Settings) -> DataFrame:
    """``seq, app_name, ts, runs``: each text's accepted fragments as in ``ingest.fragments``, without those that repeat the one before in it; texts that have one."""
    whole = without_apps(stream.where(X.length_within("text", settings.min_text_length, settings.max_text_length)), settings.avoid_apps)
    kept = F.filter(F.transform(X.fragments("text"), X.one_line), lambda t: X.length_within(t, settings.min_text_length, settings.max_text_length) & ~X.is_symbol_or_number(t))
    changed = X.let(kept, lambda k: F.filter(k, lambda t, i: (i == 0) | (t != F.get(k, i - 1))))
    # made in a generator, else the filter would make them anew
    return whole.select("seq", "app_name", "ts", F.explode(F.array(changed)).alias("runs")).where(F.size("runs") > 0)


def decided(stream: DataFrame, settings: Settings = Settings(), per_app: bool = False) -> DataFrame:
    """Rows ``DECIDED``: the texts, their fragments joined by line ends, which none has, and what is decided of them.

    One key for all rows, in order of ``seq``, as in a single log: what is accepted
    depends on the text before, whichever app showed it. ``per_app`` has a key for each app.
    Needs the state store on disk (``PROVIDER``).
    """
    texts = runs(stream, settings).select(
        F.coalesce("app_name", F.lit("")).alias("key") if per_app else F.lit("").alias("key"), F.coalesce("seq", F.lit(LAST)).alias("place"), "app_name", "ts", "runs", F.array_join("runs", "\n").alias("texts"))
    none, digest = F.lit(None).cast("string"), lambda t: F.sha2(t, 256)
    group = F.pmod(F.xxhash64("place"), F.lit(GROUPS)).cast("string")
    common = ["key", "place", F.xxhash64("texts").alias("id")]
    text = F.struct(F.lit("text").alias("kind"), group.alias("part"), *common, none.alias("first"), none.alias("end"), F.lit(0).alias("n"), "app_name", "texts", "ts")
    ends = F.struct(F.lit("ends").alias("kind"), F.col("key").alias("part"), *common, digest(F.get("runs", F.lit(0))).alias("first"), digest(F.element_at("runs", -1)).alias("end"), F.size("runs").alias("n"), none.alias("app_name"), none.alias("texts"), F.lit(None).cast("timestamp").alias("ts"))
    both = texts.select(F.explode(F.array(text, ends)).alias("x")).select("x.*")
    return both.groupBy("kind", "part").transformWithStateInPandas(Buffer(settings), DECIDED, "Append", "ProcessingTime")


def resolved(batch: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to save and rows that wait, of a batch's texts and decisions and of what waited before; ``WAITING`` and ``fresh``, whether of this batch."""
    upto = F.broadcast(batch.where("kind = 'upto'").groupBy("key").agg(F.max("place").alias("upto")))
    again = batch.where("kind = 'again'").select("key", "place", "id", "nth", F.lit(True).alias("again"))
    texts = batch.where("kind = 'text'").join(again, ["key", "place", "id", "nth"], "left")
    rows = texts.select("key", "place", "app_name", "ts", "again", F.posexplode(F.split("texts", "\n")).alias("pos", "text")).where("again is null or pos > 0")
    every = before.withColumn("fresh", F.lit(0)).unionByName(rows.drop("again").withColumn("fresh", F.lit(1))).join(upto, "key", "left")
    due = F.col("upto").isNotNull() & ((F.col("fresh") == 0) | (F.col("place") <= F.col("upto")))
    return every.where(due), every.where(~due)


def start(stream: DataFrame, path: str, checkpoint: str, settings: Settings = Settings(), per_app: bool = False, once: bool = False, every_s: float = 1.0) -> StreamingQuery:
    """Append saved rows to the table with a commit log at ``path``; a batch that is run again after a failure is written once.

    With ``once`` all that is there is taken; what then still waits is saved by the
    next run or by ``drain``.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def write(batch: DataFrame, number: int) -> None:
        here, numbers = batch.sparkSession, [n for n in _numbers(spark, f"{checkpoint}-waiting", "at=") if n < number]
        before = _waiting(here, checkpoint, numbers[-1] if numbers else None)
        batch = batch.persist()
        try:
            kinds = {x["kind"] for x in batch.groupBy("kind").count().collect()}  # of all rows, so each is made once and counted once
            if not kinds:
                return
            saved, left = resolved(batch, before)
            if "upto" in kinds:
                order = saved.repartitionByRange(here.sparkContext.defaultParallelism, "fresh", "place").sortWithinPartitions("fresh", "place", "pos")
                Log(here, path).append(jsonl.wire(order), writer=checkpoint, number=number)
            left.select(names(WAITING)).coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}-waiting/at={number}")
            for older in numbers[:-1]:  # the last one before may be asked for again
                jsonl.delete(here, f"{checkpoint}-waiting/at={older}")
        finally:
            batch.unpersist()

    rows = decided(stream, settings, per_app).observe(METRIC, F.coalesce(F.sum("saves"), F.lit(0)).alias("rows"))
    out = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    # each partition of the state starts a worker for each batch, whether it has rows or not, so there is one for each core
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, 1))
    given = {"spark.sql.shuffle.partitions": str(least)}
    if once:  # batches without data, in which timers are looked at, would never end such a run
        given["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {key: spark.conf.get(key) for key in given}
    for key, value in given.items():
        spark.conf.set(key, value)
    try:  # a query keeps the settings that it began with
        return (out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{every_s} seconds")).start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    """Numbers that name what a folder has, ascending."""
    fs, path = jsonl.filesystem(spark, folder)
    found = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(x[len(prefix) :]) for x in found if x.startswith(prefix) and x[len(prefix) :].isdigit())


def _waiting(spark: SparkSession, checkpoint: str, number: int | None) -> DataFrame:
    return spark.createDataFrame([], WAITING) if number is None else spark.read.schema(WAITING).parquet(f"{checkpoint}-waiting/at={number}")


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows that wait to be saved, as the last whole batch of a query that isn't running left them."""
    done = _numbers(spark, f"{checkpoint}/commits")
    numbers = [n for n in _numbers(spark, f"{checkpoint}-waiting", "at=") if done and n <= done[-1]]
    rows = _waiting(spark, checkpoint, numbers[-1] if numbers else None)
    return rows.select(F.when(F.col("place") != LAST, F.col("place")).alias("seq"), "app_name", "text", "ts")


def drain(spark: SparkSession, path: str, checkpoint: str) -> bool:
    """Save what a stopped query left in its buffer, at the end of its life; once, however often it is called."""
    return Log(spark, path).append(jsonl.wire(waiting(spark, checkpoint)), writer=f"{checkpoint}#drain", number=0)
