"""Structured Streaming: continuous ingestion and resumable exact dedup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from loam.config import Settings
from loam.functions import text as X
from loam.operators.exact import accepted, consecutive_dedup
from loam.plans.curation import places
from loam.sources import jsonl


def fragments(stream: DataFrame, settings: Settings = Settings(), with_place: bool = False) -> DataFrame:
    """The part of ingestion without state: length, split, clean, filters. ``seq`` counts fragments, or, ``with_place``, texts and ``pos`` fragments."""
    whole = stream.where(X.length_within("text", settings.min_text_length, settings.max_text_length))
    parts = whole.select("seq", "app_name", "ts", F.posexplode(X.fragments("text")).alias("pos", "part"))
    seq = [F.col("seq"), F.col("pos")] if with_place else [(F.col("seq") * places(settings) + F.col("pos")).alias("seq")]
    rows = parts.select(*seq, "app_name", X.one_line("part").alias("text"), "ts")
    return accepted(rows, settings.min_text_length, settings.max_text_length, settings.avoid_apps)


def consecutive(stream: DataFrame, per_app: bool = False) -> DataFrame:
    """Rows whose text differs from the last one taken; state is that one text.

    One state for all rows, in order of arrival, as in a single log; ``per_app``
    has one for each app, which lets apps run in parallel but keeps a text that
    another app has just shown.
    """
    keyed = stream.withColumn("key", F.col("app_name") if per_app else F.lit(""))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("seq")
        taken = []
        for text in rows.text:
            taken.append(text != last)
            last = text
        state.update((last,))
        yield rows.loc[taken, ["seq", "app_name", "text", "ts"]]

    return keyed.groupBy("key").applyInPandasWithState(run, "seq long, app_name string, text string, ts timestamp", "last string", "append", "NoTimeout")


def start(stream: DataFrame, path: str, checkpoint: str, settings: Settings = Settings(), once: bool = False) -> StreamingQuery:
    """Append accepted fragments to a JSON-lines table, every ``save_interval_s`` or, with ``once``, all that is there.

    Texts in succession are dropped as in batch, by spans of ``seq``, so a batch is
    spread over tasks and no worker in Python is needed; of the batches before only
    the last text is carried, in a file beside the checkpoint. A
    trigger by number of rows has no like; sources bound a batch by files or offsets.
    The batch number is part of the paths, so a batch that is run again takes the
    place of its first run.
    """
    carried = f"{checkpoint.rstrip('/')}-last"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, folder = jsonl.filesystem(spark, carried)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        held = sorted(n for x in names if x.startswith("at=") and (n := int(x[3:])) < number)
        before = spark.read.schema("batch long, last string").json(f"{carried}/at={held[-1]}").first()["last"] if held else None
        batch = batch.persist()
        try:
            ends = batch.agg(F.min("seq").alias("first"), F.max_by("text", "seq").alias("last")).first()
            again = (F.col("seq") == F.lit(ends["first"])) & F.col("text").eqNullSafe(F.lit(before)) if before is not None else F.lit(False)
            jsonl.wire(consecutive_dedup(batch).where(~F.coalesce(again, F.lit(False)))).write.mode("overwrite").json(f"{path}/batch={number}")
            if ends["last"] is not None:
                spark.createDataFrame([(number, ends["last"])], "batch long, last string").coalesce(1).write.mode("overwrite").json(f"{carried}/at={number}")
                for older in held[:-1]:  # the last one before may be asked for again
                    jsonl.delete(spark, f"{carried}/at={older}")
        finally:
            batch.unpersist()

    out = fragments(stream, settings).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{settings.save_interval_s} seconds")).start()


def resumable_dedup(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """First arrival of each text, as Parquet; what a stopped run had done isn't done again.

    The state holds every text that was seen, as first arrival has no horizon; use a state store on disk for many.
    """
    return stream.dropDuplicates(["text"]).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
