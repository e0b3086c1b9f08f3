"""One ordered sweep over texts and the marks that they may begin with.

Marks and texts are sorted together, by group and text. A text's marks are then those
still open where it stands: a mark opens at its place and closes with the first row
that doesn't begin with it. So a task holds one stack of lengths, whatever the number
of rows or the length of a text, and no prefix of a text is ever made a row.

Tasks have ranges of the order, between splitters from a bounded sample; a mark goes
to each range that has texts which begin with it, as the splitters themselves tell.
A hot prefix is spread over as many ranges as its texts fill.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts sampled for each range, and characters of a splitter.
SAMPLE, CUT = 16, 4096
#: Rows that a worker has as Python objects at a time.
ROWS = 1000
MARK, TEXT = 0, 1


def common(a: str, b: str) -> int:
    """Characters that two texts share from the start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, ``ROWS`` at a time."""
    for b in batches:
        for start in range(0, b.num_rows, ROWS):
            yield b.slice(start, ROWS)


def splitters(texts: DataFrame, parts: int) -> list[tuple[bool, str, str]]:
    """Keys that part the texts ``(group, text)`` in so many ranges of about equal size."""
    rows = texts.count()
    share = min(1.0, SAMPLE * parts / max(rows, 1))
    some = texts.where(F.pmod(F.xxhash64("group", "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("group", F.left("text", F.lit(CUT)).alias("text"))
    sample = sorted({(x.group is not None, x.group or "", x.text) for x in some.collect()})
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def placed(marks: DataFrame, texts: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows ``(kind, group, text, ...)`` of both, each range of the order in one task, sorted, marks before texts.

    Both have ``group`` and ``text``, neither null but the group, and like further columns.
    """
    spark = texts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(texts, parts)
    rows = marks.withColumn("kind", F.lit(MARK)).unionByName(texts.withColumn("kind", F.lit(TEXT)))
    columns = ["kind", "group", "text", *(c for c in texts.columns if c not in ("group", "text"))]
    rows = rows.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            at, ranges = [], []
            for i, (kind, group, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("kind", "group", "text")), strict=True)):
                part = bisect_right(cuts, (group is not None, group or "", text))
                at.append(i)
                ranges.append(part)
                while kind == MARK and part < len(cuts) and cuts[part][:2] == (group is not None, group or "") and cuts[part][2].startswith(text):
                    part += 1
                    at.append(i)
                    ranges.append(part)
            taken = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *taken.columns], names=["part", *columns])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    dealt = rows.mapInArrow(run, f"part int, {kinds}").repartition(max(1, len(cuts) + 1), "part")
    return dealt.sortWithinPartitions("part", "group", "text", "kind", *columns[3:])


def opened(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Texts of a placed table with the marks that each begins with, shortest first: their columns, and the marks' lengths and columns.

    Marks with the same columns are one. The list of marks is the sweep's own; it changes with the next text.
    """
    here, before, stack = None, "", []
    for b in few(batches):
        for part, kind, group, text, *rest in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "group", "text", *columns)), strict=True):
            if here != (part, group):
                here, stack = (part, group), []
            else:
                shared = common(before, text)
                while stack and stack[-1][0] > shared:
                    stack.pop()
            before = text
            if kind == TEXT:
                yield (text, *rest), stack
            elif not stack or stack[-1] != (len(text), *rest):
                stack.append((len(text), *rest))
