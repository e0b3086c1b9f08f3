"""Exact dedup section by section, with a seen-set that lasts: a run that is stopped goes on where it was.

Rows are taken in sections of ``seq``. A section's first rows of each text are held
against what earlier sections kept and then committed, rows and hashes together, as
one write of a table with a commit log; the commit's number is the section. The
seen-set is thus the hashes of the kept rows, 16 bytes a text, in buckets. Each section
leaves a Bloom filter for each bucket, so only rows that may have been seen are looked
up: the seen-set is scanned where such rows are, and never shuffled for the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.exact import first_of, key_of
from loam.sources import jsonl
from loam.sources.log import Log

BUCKETS, PROBES, BITS_A_KEY = 64, 5, 10
WRITER = "section"


@dataclass(frozen=True)
class Progress:
    """Sections done, sections in all, and rows kept so far."""

    done: int
    sections: int
    kept: int


def hashed(rows: DataFrame) -> DataFrame:
    """With two hashes of the text as it is compared, and its bucket."""
    key = key_of("text")
    both = rows.withColumn("h1", F.xxhash64(key)).withColumn("h2", F.xxhash64(F.lit(1), key))
    return both.withColumn("bucket", F.pmod("h1", F.lit(BUCKETS)).cast("int"))


def places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key: a row for each, ``PROBES`` wide."""
    a, b = h1.view(np.uint64)[:, None], h2.view(np.uint64)[:, None]
    with np.errstate(over="ignore"):
        return ((a >> np.uint64(7)) + np.arange(PROBES, dtype=np.uint64) * (b | np.uint64(1))) % np.uint64(bits)


def filters(kept: DataFrame) -> DataFrame:
    """``bucket, bits, bloom`` of a section's kept rows; a bucket of a section is bounded by the section."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        bits = max(64, BITS_A_KEY * len(rows) // 8 * 8)
        at = places(rows.h1.to_numpy(), rows.h2.to_numpy(), bits).ravel()
        field = np.zeros(bits, np.uint8)
        field[at] = 1
        return pd.DataFrame({"bucket": [int(rows.bucket.iloc[0])], "bits": [bits], "bloom": [np.packbits(field).tobytes()]})

    return kept.select("bucket", "h1", "h2").groupBy("bucket").applyInPandas(build, "bucket int, bits long, bloom binary")


def maybe_seen(rows: DataFrame, blooms: DataFrame) -> DataFrame:
    """``h1, h2`` of the rows that a filter of their bucket may know; each bucket's filters are read once."""

    def test(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = asked.h1.to_numpy(), asked.h2.to_numpy()
        keep = np.zeros(len(h1), bool)
        for bits, bloom in zip(held.bits, held.bloom, strict=True):
            field = np.unpackbits(np.frombuffer(bloom, np.uint8))
            keep |= field[places(h1, h2, bits)].all(1).astype(bool)
        return pd.DataFrame({"h1": h1[keep], "h2": h2[keep]})

    return rows.select("bucket", "h1", "h2").groupBy("bucket").cogroup(blooms.groupBy("bucket")).applyInPandas(test, "h1 long, h2 long")


class SectionedDedup:
    """Dedup of ``entries`` into the table at ``path``; ``sections`` is fixed by the first run."""

    def __init__(self, entries: DataFrame, path: str, sections: int = 10) -> None:
        self.entries, self.path, self.spark = entries, path.rstrip("/"), entries.sparkSession
        schema = ", ".join(f"`{c}` {k}" for c, k in entries.dtypes)
        self.log = Log(self.spark, f"{self.path}/kept", "parquet", f"{schema}, h1 long, h2 long, bucket int")
        plan = f"{self.path}/plan"
        jsonl.recover(self.spark, plan)
        if not jsonl.exists(self.spark, plan):
            cuts = entries.approxQuantile("seq", [k / sections for k in range(1, sections)], 0.01) if sections > 1 else []
            jsonl.replace(self.spark.createDataFrame([(sorted(set(cuts)),)], "cuts array<double>"), plan)
        self.cuts = self.spark.read.schema("cuts array<double>").json(plan).first()["cuts"] or []

    def progress(self) -> Progress:
        state = self.log.state()
        kept = self.log.read().count() if state.live else 0
        return Progress(state.writers.get(WRITER, -1) + 1, len(self.cuts) + 1, kept)

    def section(self, k: int) -> DataFrame:
        seq = F.col("seq").cast("double")
        above = seq > self.cuts[k - 1] if k else F.lit(True)
        return self.entries.where(above & (seq <= self.cuts[k]) if k < len(self.cuts) else above)

    def step(self) -> bool:
        """Do the next section; False if all are done."""
        k = self.log.state().writers.get(WRITER, -1) + 1
        if k > len(self.cuts):
            return False
        first = hashed(first_of(self.section(k), "text"))
        if k:
            blooms = self.spark.read.schema("bucket int, bits long, bloom binary").parquet(*[f"{self.path}/blooms/{i}" for i in range(k)])
            asked = maybe_seen(first, blooms)
            seen = self.log.read().select("h1", "h2").join(asked, ["h1", "h2"], "left_semi")
            first = first.join(seen, ["h1", "h2"], "left_anti").select(*first.columns)
        # the section's rows first, from which the filters are built; what a stopped run left is written over
        draft = f"{self.path}/draft/{k}"
        first.write.mode("overwrite").parquet(draft)
        rows = self.spark.read.schema(first.schema).parquet(draft)
        filters(rows).write.mode("overwrite").parquet(f"{self.path}/blooms/{k}")
        self.log.append(rows, WRITER, k)
        jsonl.delete(self.spark, draft)
        return True

    def run(self, most: int | None = None) -> Progress:
        """So many sections, or all that are left."""
        while (most is None or most > 0) and self.step():
            most = None if most is None else most - 1
        return self.progress()

    def result(self) -> DataFrame:
        return self.log.read().select(*self.entries.columns)


def progressive_dedup(spark: SparkSession, entries: DataFrame, path: str, sections: int = 10) -> DataFrame:
    """``exact_dedup`` by sections; called again after a stop, it does those that are left."""
    run = SectionedDedup(entries, path, sections)
    run.run()
    return run.result()
