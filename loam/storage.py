"""Tables that end lineage: Parquet in the folder that ``spark.checkpoint.dir`` names, which the driver and every executor can reach.

A lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a local session gets a temporary one, and any other is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
            at = "file://" + tempfile.mkdtemp(prefix="loam-")
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/")


def written(spark: SparkSession) -> list[str]:
    """Paths of the tables that this application has stored, in order."""
    context = spark.sparkContext
    if not hasattr(context, "_loam_tables"):
        context._loam_tables = []
    return context._loam_tables


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df``, written once to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/loam/{name}-{uuid.uuid4().hex}"
    written(df.sparkSession).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, since: int = 0, but_last: int = 0) -> None:
    """Delete the tables stored since so many were, but for the last ones. For when nothing that reads them is to be evaluated any more."""
    paths = written(spark)
    stop = max(since, len(paths) - but_last)
    for at in paths[since:stop]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del paths[since:stop]
