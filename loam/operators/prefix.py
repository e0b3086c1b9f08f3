"""Prefix deduplication: greedy within an app, adjacent rows, longest stored prefix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from unicodedata import normalize

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators.exact import first_of, pair_dedup, without_apps
from loam.operators.greedy import lost
from loam.operators.sweep import common, opened, placed
from loam.storage import stored

#: Rows of a result that a task holds before it gives them out.
HELD = 50_000


def prefix_conflicts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each of distinct rows ``(node, app_name, text)`` asks for, ``(node, a1, a2)``, and who answers, ``(a1, a2, before)``.

    A text is covered by a longer one of its app that shares 60 % of its length from
    the start, two characters at least, if it has 70 % of the longer's length; a
    prefix of a longer text shares all of it. So it asks for texts that begin with its
    first ``ceil(0.6 n)`` characters and have the right length, and all texts with
    that beginning and length ask the same. An ordered sweep finds the open beginnings
    of each text; a text answers those of lengths in its reach, so at most 0.3 of its
    own length, and not each text that it covers.
    """
    n = F.length("text")
    share = F.greatest(F.lit(2), F.ceil(n * 3 / 5).cast("int"))
    asking = rows.where(n >= 2).select("node", F.col("app_name").alias("group"), F.left("text", share).alias("text"), n.alias("n"))
    named = asking.select("node", "group", "text", F.xxhash64("group", "text", "n").alias("a1"), F.xxhash64("n", "text", "group", F.lit(1)).alias("a2"), "n")
    marks = named.select("group", "text", "a1", "a2", "n").distinct()
    none = F.lit(0).cast("bigint")
    texts = rows.where(n >= 3).select(F.col("app_name").alias("group"), "text", F.col("node").alias("a1"), none.alias("a2"), n.alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a1", "a2", "before"])
            for c in out:
                c.clear()
            return done

        for (_, node, _, n), stack in opened(batches, "a1", "a2", "n"):
            least = -(-7 * n // 10)
            shortest = max(2, -(-3 * least // 5))
            for size, a1, a2, m in reversed(stack):
                if size < shortest:
                    break
                if least <= m < n:
                    for c, v in zip(out, (a1, a2, node), strict=True):
                        c.append(v)
            if len(out[0]) > HELD:
                yield batch()
        yield batch()

    return named.select("node", "a1", "a2"), placed(marks, texts).mapInArrow(run, "a1 long, a2 long, before long")


def prefix_dedup(entries: DataFrame) -> DataFrame:
    """Rows that greedy prefix dedup keeps: longest first, equal texts of an app once, empty ones never.

    A row is compared to kept rows only, so a row may stay because the one that
    covered it went. Two rows of equal length never cover each other. Whatever covers
    a row that covers this one shares enough with it, so rounds follow the lengths
    (two for each 70 %), not the number of rows.
    """
    # composed forms are stored, else each filter and hash of them would take a worker in Python of its own beside the sweep's
    keys = {"__app": X.recomposed("app_name"), "__text": X.recomposed("text")}
    rows = stored(pair_dedup(entries.where(F.length("text") > 0)).withColumn("__node", F.monotonically_increasing_id()).withColumns(keys), "pairs")
    asks, offers = prefix_conflicts(rows.select(F.col("__node").alias("node"), F.coalesce("__app", "app_name").alias("app_name"), F.coalesce("__text", "text").alias("text")))
    gone = lost(asks, offers, ["a1", "a2"]).select(F.col("node").alias("__node"))
    return rows.join(gone, "__node", "left_anti").select(*entries.columns)


def related(a: str, b: str) -> bool:
    return a.startswith(b) or b.startswith(a)


def adjacent_prefix(entries: DataFrame, span: int | None = None) -> DataFrame:
    """Of neighbouring rows of one app, drops the later one if either text is a prefix of the other.

    The kept row is compared to the next; a row of another app begins anew. ``seq`` is
    cut in ranges, one for each shuffle partition or of ``span`` rows, each a stream through one task that holds the kept row alone. What
    a range does depends on the row carried into it only until the first row that this
    doesn't cover, and not at all if its first row isn't covered: so each range tells
    its first row, its last kept one if nothing is carried in, and what all its texts
    begin with. The driver goes along these, a row for each range. A carried row that
    all texts of a range begin with goes through it; where that isn't told, the range
    is run with it, all such ranges at a time.
    """
    held, columns = stored(entries, "entries"), list(entries.columns)
    place = F.coalesce(F.col("seq").cast("double"), F.lit(-float("inf")))
    parts = -(-held.count() // span) if span else int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = held.select(place.alias("seq")).approxQuantile("seq", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    splits = [-float("inf"), *sorted({x for x in cuts if x > -float("inf")}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="__seq", outputCol="__range") if len(splits) > 2 else None
    ranged = cut.transform(held.withColumn("__seq", place)) if cut else held.withColumn("__range", F.lit(0))
    rows = ranged.withColumn("__range", F.col("__range").cast("int")).select("__range", *columns)

    def streams(of: DataFrame) -> DataFrame:
        return of.repartition(len(splits) - 1, "__range").sortWithinPartitions("__range", "seq", "app_name", "text")

    def fold(batches: Iterator[pa.RecordBatch], carried: dict[int, tuple]) -> Iterator[tuple]:
        """``batch, place, range, app, text, kept, row``: each row, whether it is kept, and the row then carried on."""
        here, held = None, None
        for b in batches:
            for i, (r, app, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("__range", "app_name", "text")), strict=True)):
                app, text = (x if x is None or x.isascii() else normalize("NFC", x) for x in (app, text))
                if r != here:
                    here, held = r, carried.get(r)
                kept = held is None or held[0] != app or text is None or held[1] is None or not related(held[1], text)
                if kept:
                    held = (app, text)
                yield b, i, r, app, text, kept, held

    def told(batches: Iterator[pa.RecordBatch], carried: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for _, _, r, app, text, _, held in fold(batches, carried):
            x = found.setdefault(r, [app, text, None, None, True, text])
            x[2:4] = held
            x[4] = x[4] and app == x[0]
            if x[5]:
                x[5] = x[5][: common(x[5], text or "")]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*([r, *x] for r, x in sorted(found.items())), strict=True) if found else [[]] * 7, kinds, strict=True)], names=["r", "app", "text", "last_app", "last_text", "alone", "start"])

    def ends(of: DataFrame, carried: dict[int, tuple]) -> dict[int, tuple]:
        got = streams(of.select("__range", "seq", "app_name", "text")).mapInArrow(lambda b: told(b, carried), "r int, app string, text string, last_app string, last_text string, alone boolean, start string")
        return {x.r: x for x in got.collect()}  # a row for each range

    fresh = ends(rows, {})
    known: dict[tuple, tuple] = {}
    while True:
        carried, unknown, held = {}, {}, None
        for r, x in sorted(fresh.items()):
            touched = held is not None and held[0] == x.app and None not in (held[1], x.text) and related(held[1], x.text)
            if touched:
                carried[r] = held
            if not touched:
                held = (x.last_app, x.last_text)
            elif x.alone and (x.start or "").startswith(held[1]):
                pass
            elif (r, held) in known:
                held = known[r, held]
            else:
                unknown[r] = held
                held = (x.last_app, x.last_text)  # mostly so; else it is found out in the next round
        if not unknown:
            break
        for r, x in ends(rows.where(F.col("__range").isin(*unknown)), unknown).items():
            known[r, unknown[r]] = (x.last_app, x.last_text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(of: pa.RecordBatch, mask: list[bool]) -> pa.RecordBatch:
            return of.filter(pa.array(mask, pa.bool_())).select(columns)

        of, mask = None, []
        for b, i, _, _, _, kept, _ in fold(batches, carried):
            if not i and of is not None:
                yield result(of, mask)
                mask = []
            of = b
            mask.append(kept)
        if of is not None:
            yield result(of, mask)

    return streams(rows).mapInArrow(keep, ", ".join(f"`{c}` {k}" for c, k in entries.dtypes))


def simple_purge(entries: DataFrame, avoid_apps: Sequence[str] = (), min_bytes: int = 0) -> DataFrame:
    """Not symbols alone, not of excluded apps, long enough in bytes; first of each app and text; then adjacent prefixes."""
    passed = without_apps(entries.where(~X.is_symbol_or_number("text") & (X.n_bytes("text") >= min_bytes)), avoid_apps)
    return adjacent_prefix(first_of(passed, "app_name", "text"))


def longest_prefix(words: DataFrame, stored_words: DataFrame) -> DataFrame:
    """``word, prefix``: the longest stored word that each distinct word begins with, or null.

    By an ordered sweep: a task holds the lengths of the stored words that are open, and no prefix is made a row.
    """
    group = F.lit(None).cast("string").alias("group")
    texts = stored(words.select(group, F.col("word").alias("text")).where("text is not null").distinct(), "words")
    marks = stored_words.select(group, F.col("word").alias("text")).where("text <> ''").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        size = 0
        for (text,), stack in opened(batches):
            out[0].append(text)
            out[1].append(text[: stack[-1][0]] if stack else None)
            size += len(text)
            if len(out[0]) > HELD or size > HELD * 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["word", "prefix"])
                out, size = ([], []), 0
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["word", "prefix"])

    found = placed(marks, texts).mapInArrow(run, "word string, prefix string")
    null = words.where("word is null").limit(1).select("word", F.lit(None).cast("string").alias("prefix"))
    return found.unionAll(null)
