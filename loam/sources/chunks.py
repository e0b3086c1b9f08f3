"""JSON lines as a data source of byte ranges: a batch scan in pieces of any size, and a stream that polls files as they grow.

Registered as ``line_chunks`` by ``register``. A range has the lines that begin in it,
so a cut within a line, or within a character, is no matter. Files are opened through
Arrow's file systems by the tasks themselves.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loam.config import Settings, poll_interval
from loam.functions import text as X
from loam.schema import WIRE

SCHEMA = "file string, start long, line string"
#: Bytes of a range of a batch scan, and that a task reads at a time.
RANGE, PIECE = 16 << 20, 64 << 10
ROWS = 500
#: Bytes of the small ranges that one task reads, one after the other.
TASK = 8 << 20


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    """Ranges of ``size`` bytes of files, from ``start`` to ``stop`` of each, that one task reads."""

    files: list[Range]
    size: int

    def each(self) -> Iterator[Range]:
        for f in self.files:
            for k in range(f.start, f.stop, self.size):
                yield Range(f.path, k, min(k + self.size, f.stop))


def together(files: Iterable[tuple[str, int, int]], size: int) -> list[Ranges]:
    """Files from a place to a place, cut in ranges, and these put together to tasks of ``TASK`` bytes, or of one larger range.

    A task for each small range would cost more to start than to read.
    """
    share = max(1, TASK // size) * size
    out: list[Ranges] = []
    left = 0
    for path, start, stop in files:
        while start < stop:
            if left <= 0:
                out.append(Ranges([], size))
                left = share
            end = min(start + -(-left // size) * size, stop)
            out[-1].files.append(Range(path, start, end))
            left -= end - start
            start = end
    return out


def listed(path: str) -> dict[str, int]:
    """Files of a folder, or the one file, with their sizes; hidden ones are passed over."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        found = [x for x in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    return {scheme + x.path: x.size for x in found if x.size}


def opened(path: str):
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def lines(path: str, start: int, stop: int, piece: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in a range of a file, with their places; without their ends. A last line needs none."""
    with opened(path) as f:
        at = start - 1 if start else 0
        f.seek(at)
        rest, begin = b"", at
        skip = bool(start)  # up to the end of the line that the byte before belongs to
        while True:
            more = f.read(piece)
            rest += more
            parts = rest.split(b"\n")
            rest = parts.pop() if more else b""
            for part in parts:
                if not skip:
                    if begin >= stop:
                        return
                    yield begin, part
                skip = False
                begin += len(part) + 1
            if not more:
                return
            if begin >= stop and not skip:
                return


def batches(ranges: Iterable[Range], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, int, str]] = []

    def batch() -> pa.RecordBatch:
        files, starts, found = zip(*held, strict=True)
        done = pa.RecordBatch.from_arrays([pa.array(files), pa.array(starts, pa.int64()), pa.array(found, pa.string())], names=["file", "start", "line"])
        held.clear()
        return done

    for r in ranges:
        for at, line in lines(r.path, r.start, r.stop):
            if line.strip():
                held.append((r.path, at, line.rstrip(b"\r").decode("utf-8", "replace")))
            if len(held) >= rows:
                yield batch()
    if held:
        yield batch()


class Scan(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Ranges]:
        return together(((f, 0, n) for f, n in sorted(listed(self.path).items())), self.size)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from batches(partition.each())


class Poll(DataSourceStreamReader):
    """Whole lines added to files; an offset has the bytes taken of each. After a minute without any the folder is looked at less often."""

    def __init__(self, path: str, size: int, settings: Settings, clock: Callable[[], float] = time.monotonic) -> None:
        self.path, self.size, self.settings, self.clock = path, size, settings, clock
        self.seen: dict[str, int] | None = None
        self.looked = self.grew = clock()

    def initialOffset(self) -> dict:  # noqa: N802 - name of the interface
        return {}

    def whole(self, path: str, start: int, size: int) -> int:
        """The end of the last whole line of a file."""
        with opened(path) as f:
            stop = size
            while stop > start:
                begin = max(start, stop - PIECE)
                f.seek(begin)
                at = f.read(stop - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                stop = begin
        return start

    def latestOffset(self) -> dict:  # noqa: N802
        now = self.clock()
        if self.seen is not None and now - self.looked < poll_interval(now - self.grew, self.settings) and now - self.grew >= 60:
            return self.seen
        self.looked, before = now, self.seen or {}
        after = {f: self.whole(f, min(before.get(f, 0), n), n) for f, n in sorted(listed(self.path).items())}
        if after != before:
            self.grew = now
        self.seen = before | after
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return together(((f, start.get(f, 0), n) for f, n in sorted(end.items())), self.size)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from batches(partition.each())

    def commit(self, end: dict) -> None:
        pass


class LineChunks(DataSource):
    """Options: ``path``, ``bytes`` of a range, ``settings`` as JSON."""

    @classmethod
    def name(cls) -> str:
        return "line_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Scan:
        return Scan(self.options["path"], int(self.options.get("bytes", RANGE)))

    def streamReader(self, schema) -> Poll:  # noqa: N802
        return Poll(self.options["path"], int(self.options.get("bytes", RANGE)), Settings.from_json(self.options.get("settings", "{}")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineChunks)


def scan(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``file, start, line`` of the lines of JSON-lines files that aren't blank."""
    register(spark)
    return spark.read.format("line_chunks").option("bytes", str(size)).load(path)


def poll(spark: SparkSession, path: str, settings: Settings = Settings(), size: int = RANGE) -> DataFrame:
    """The same as a stream of the lines that are there and of those added to the files, once their ends are written."""
    register(spark)
    return spark.readStream.format("line_chunks").option("bytes", str(size)).option("settings", settings.to_json()).load(path)


def entries(found: DataFrame) -> DataFrame:
    """``file, start, app_name, text, ts`` of the lines that are entries; the others are left out."""
    e = F.from_json("line", WIRE).alias("e")
    rows = found.select("file", "start", e).where("e.appName is not null and e.text is not null and e.timestamp is not null")
    return rows.select("file", "start", F.col("e.appName").alias("app_name"), F.col("e.text").alias("text"), X.from_reference_seconds("e.timestamp").alias("ts"))


def each_batch(found: DataFrame, process: Callable[[list[dict]], None], rows: int = ROWS) -> None:
    """Call ``process`` on the workers with the rows, so many at a time, in the order of their range."""

    def run(part) -> None:
        held = []
        for x in part:
            held.append(x.asDict())
            if len(held) == rows:
                process(held)
                held = []
        if held:
            process(held)

    found.foreachPartition(run)
