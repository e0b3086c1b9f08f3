"""What the operators of this subpackage share: Arrow batches of bounded size, rows by id and text, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.storage import stored

#: Bytes and rows of one Arrow batch sent to a Python worker.
BATCH_BYTES, BATCH_ROWS = "8m", "2000"


def ship(spark: SparkSession) -> None:
    """Give executors this package, whatever their PYTHONPATH; once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_loam_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="loam-")) / "loam.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(path))
    context._loam_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Make Python workers ready: this package, and Arrow batches bounded so that very long texts fit.

    The two settings stay as they are then, as the operators' plans are run later on.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def by_text(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``documents`` with ``__row``, their id and a hash of the text; null ids are greater than all others."""
    return documents.withColumn("__row", F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print")))


def among(documents: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """``documents`` joined, ``left_semi`` or ``left_anti``, to the ``__row`` of ``rows`` by id and hash of the text."""
    rows = rows.select(F.col("__row.id").alias("__id"), F.col("__row.print").alias("__print")).distinct()
    return documents.join(rows, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__print")), how)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: What operators keep in a Python worker from task to task.
KEPT: list[dict] = []


def trim() -> None:
    """Give memory that is no longer used back to the machine; Arrow's pool and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def release() -> None:
    """Let go of what an operator kept in this worker; for the tasks of the others, as workers are used again."""
    if any(KEPT):
        for held in KEPT:
            held.clear()
        gc.collect()
        trim()


def slices(batch: pa.RecordBatch, text: str, most: int = 8 << 20, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` text bytes, or one row. Releases what was kept, without ``keep``."""
    if not keep:
        release()
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Connected components of an undirected edge table ``(a, b)`` as ``(node, root)``; root is the least node.

    Alternating large-star and small-star steps; every step is a partial
    aggregate and a join that adaptive execution can split, so a node with very
    many neighbours meets no single task. Nodes without an edge don't appear;
    null ends and loops are ignored; an empty table gives an empty table.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = stored(pairs, "edges"), None
    for _ in range(most_rounds):
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        pairs = stored(small.where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

