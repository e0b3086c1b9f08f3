"""The prefix trie of conversations by an external mergesort that knows common prefixes.

A conversation is a row of units, one for each turn: a digest of role and text, and
the text's length. Equal conversations become one sequence first. Tasks sort their
sequences in runs and keep, for each, the number of turns that it shares with the
one before it; a run is cut at splitters of the key space and sent front-coded, so
shared turns travel once. For each range a task merges the runs with a loser tree in
which the shared turns decide most matches without looking at a turn again, and runs
over the merged stream with a stack of the open path: a node is finished, and given
out, when the stream leaves it. Spark's shuffle is the external storage.

A node that several ranges share is given out by each with what it saw there. All
columns of a node are sums or minima of such parts, as each range knows the keys
next to it: a node is counted as a child, and its text as once said, by the range in
which it first appears. So one aggregation by node ends the work.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm._shared import release, small_batches
from loam.storage import stored

#: Bytes of a turn in a key: its digest, then the length of its text.
DIGEST, UNIT = 16, 20
#: Rows and bytes of keys that a task sorts at a time.
RUN_ROWS, RUN_BYTES = 50_000, 16 << 20
#: Bytes of keys that one range has about; keys sampled for each range, and the turns that a splitter may have.
RANGE_BYTES, OVERSAMPLE, SPLIT_TURNS = 8 << 20, 16, 64
ROOT = bytes(DIGEST)
NOTHING = hashlib.sha256(b"").hexdigest()
#: Columns of a run and of a node.
RUN = ("common", "sizes", "tails", "n", "ids", "ends")
NODE = pa.schema([
    ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("turn", pa.binary()), ("conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.binary()),
])
#: One sequence: its key, the number of conversations with it, their least id and the digest of their ids.
Sequence = tuple[bytes, int, int, bytes]


def units(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, units``: the turns of each conversation in order, each as hexadecimal digits of its unit.

    Null turns come first; rows of one turn go by role and then by digest. Null roles
    and texts count as empty. Rows without an id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * DIGEST))
    unit = F.concat(digest, F.lpad(F.lower(F.hex(F.length(text))), 2 * (UNIT - DIGEST), "0"))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), unit.alias("unit")).alias("x"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("conv_id", F.col("x.unit").alias("units"))


def keyed(sequences: DataFrame) -> DataFrame:
    """``conv_id, key``: the units joined, as bytes."""
    return sequences.select("conv_id", F.unhex(F.array_join("units", "")).alias("key"))


def rebuilt(sequences: DataFrame, group: int = 100, kinds: int = 6) -> DataFrame:
    """Sequences that begin as the first of their group of ids does.

    With ``h``, the CRC-32 of the id in decimal modulo ``kinds``: the first h units of
    the conversation whose id is the group's multiple (all if it has fewer, none if it
    isn't there), then the own units after the first h.
    """
    heads = sequences.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("leader"), F.slice("units", 1, kinds - 1).alias("head"))
    joined = sequences.join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("leader"), "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % kinds).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    return joined.select("conv_id", F.concat(head, F.slice("units", h + 1, F.size("units"))).alias("units"))


def distinct(rows: DataFrame) -> DataFrame:
    """``key, n, conv_id, ends`` of each different key: its conversations, their least id, and the SHA-256 of their ids.

    The digest is of the decimal ids in order, joined by commas. It can only be made
    one id after the other, so rows of a key meet in one task; they stream through it
    in order and none is held.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        key, out = None, ([], [], [], [])

        def close() -> None:
            for c, v in zip(out, (key, n, first, digest.digest()), strict=True):
                c.append(v)

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "n", "conv_id", "ends"])
            for c in out:
                c.clear()
            return done

        for b in batches:
            for k, i in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        close()
                    key, n, first, digest = k, 1, i, hashlib.sha256(str(i).encode())
                else:
                    n += 1
                    digest.update(b",%d" % i)
            yield batch()
        if key is not None:
            close()
            yield batch()

    return rows.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, n long, conv_id long, ends binary")


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two keys share from the start; the first ``known`` are known to be equal."""
    most = min(len(a), len(b))
    at = known * UNIT
    while at < most and a[at : at + UNIT] == b[at : at + UNIT]:
        at += UNIT
    return at // UNIT


def encoded(rows: list[Sequence]) -> tuple[bytes, bytes, bytes, bytes, bytes, bytes]:
    """A sorted run, front-coded: turns shared with the row before, turns in all, the other turns, and the three further columns."""
    common = [0, *(shared(x[0], y[0]) for x, y in zip(rows, rows[1:], strict=False))]
    sizes = [len(x[0]) // UNIT for x in rows]
    tails = b"".join(x[0][c * UNIT :] for x, c in zip(rows, common, strict=True))
    ints = [np.array(c, np.int64).tobytes() for c in (common, sizes, [x[1] for x in rows], [x[2] for x in rows])]
    return ints[0], ints[1], tails, ints[2], ints[3], b"".join(x[3] for x in rows)


def decoded(common: bytes, sizes: bytes, tails: bytes, n: bytes, ids: bytes, ends: bytes) -> Iterator[tuple[int, Sequence]]:
    """The rows of a run with the turns that each shares with the one before."""
    key, at = b"", 0
    for k, (c, size, count, conv) in enumerate(zip(*(np.frombuffer(x, np.int64).tolist() for x in (common, sizes, n, ids)), strict=True)):
        more = (size - c) * UNIT
        key, at = key[: c * UNIT] + tails[at : at + more], at + more
        yield c, (key, count, conv, ends[32 * k : 32 * k + 32])


def merged(runs: list[Iterable[tuple[int, Sequence]]], compare: Callable[[bytes, bytes, int], int] = shared) -> Iterator[tuple[int, Sequence]]:
    """The rows of sorted runs in order, each with the turns that it shares with the one before, by a loser tree.

    Every contender carries the turns that it shares with the last row given out.
    The one that shares more comes first, and what the other shares with it is what
    that one shared already; only equals are compared, and from there on.
    """
    width = 1 << max(0, (len(runs) - 1).bit_length())
    rest = [iter(r) for r in runs] + [iter(()) for _ in range(width - len(runs))]
    row: list[Sequence | None] = [None] * width
    lcp = [0] * width

    def advance(i: int) -> None:
        lcp[i], row[i] = next(rest[i], (0, None))

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared turns are then those with the winner."""
        if row[a] is None or row[b] is None:
            return (b, a) if row[a] is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = row[a][0], row[b][0]
        n = compare(x, y, lcp[a])
        won, lost = (a, b) if x[n * UNIT : (n + 1) * UNIT] <= y[n * UNIT : (n + 1) * UNIT] else (b, a)
        lcp[lost] = n
        return won, lost

    loser = [0] * width
    for i in range(width):
        advance(i)
        lcp[i] = 0
    level = list(range(width))
    while len(level) > 1:
        over = []
        for k in range(0, len(level), 2):
            won, lost = play(level[k], level[k + 1])
            loser[(len(level) + k) // 2] = lost
            over.append(won)
        level = over
    won = level[0]
    while row[won] is not None:
        yield lcp[won], row[won]
        advance(won)
        at = (width + won) // 2
        while at:
            won, loser[at] = play(won, loser[at])
            at //= 2


class Node:
    """A node of the open path, with what its subtree has shown so far in this range."""

    __slots__ = ("children", "conv", "convs", "ends", "leaves", "name", "new", "saved", "unit")

    def __init__(self, name: bytes, unit: bytes, new: bool) -> None:
        self.name, self.unit, self.new = name, unit, new
        self.conv, self.ends, self.convs, self.children, self.leaves, self.saved = None, None, 0, 0, 0, 0


def nodes(stream: Iterable[tuple[int, Sequence]], before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """Nodes of a sorted stream, each when the stream leaves it: name, parent, depth, unit, least id, conversations, children, leaves, saved, ends.

    ``before`` and ``after`` are the keys next to the range. A node on the path of
    ``before`` isn't new here, and the last one is no leaf if ``after`` goes on from it.
    """
    path: list[Node] = []
    seen, last = -1 if before is None else 0, b""

    def leave(depth: int, continued: bool = False) -> Iterator[tuple]:
        while len(path) > depth:
            x, level = path.pop(), len(path)
            if x.ends is not None and not x.children and not continued:
                x.leaves += 1
            length = struct.unpack(">I", x.unit[DIGEST:])[0] if x.unit else 0
            x.saved += (x.convs - x.new) * length
            up = path[-1] if path else None
            if up is not None:
                up.children, up.leaves, up.saved, up.convs = up.children + x.new, up.leaves + x.leaves, up.saved + x.saved, up.convs + x.convs
                up.conv = x.conv if up.conv is None else min(up.conv, x.conv)
            yield x.name, up.name if up else None, level, x.unit[:DIGEST], x.conv, x.convs, x.children, x.leaves, x.saved, x.ends
            continued = False

    for common, (key, n, conv, ends) in stream:
        if not path:  # the first row
            seen = -1 if before is None else shared(before, key)
            path.append(Node(ROOT, b"", seen < 0))
        else:
            yield from leave(common + 1)
        for depth in range(len(path), len(key) // UNIT + 1):
            unit = key[(depth - 1) * UNIT : depth * UNIT]
            path.append(Node(hashlib.blake2b(path[-1].name + unit, digest_size=DIGEST).digest(), unit, depth > seen))
        seen = -1  # what follows leaves the path of ``before`` or was met already
        end = path[-1]
        end.convs, end.ends, end.conv = end.convs + n, ends, conv if end.conv is None else min(end.conv, conv)
        last = key
    if path:
        yield from leave(0, after is not None and shared(last, after) * UNIT == len(last))


def trie(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """``node, parent, turn, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node, for rows ``(conv_id, key)``.

    ``node`` and ``parent`` name nodes, ``turn`` is the digest of the node's last turn
    (empty at the root), ``conv_id`` the least conversation that begins with the node.
    ``saved_tokens`` sums, over the subtree, the code points of each node's last text
    times the conversations beyond the first; ``ends_sha256`` is of the ids of the
    conversations that end at the node. No row gives no node, not even a root.
    Several rows of one id are as many conversations.

    A conversation is one row of 20 bytes a turn, so some 10^8 turns at most. The
    splitters come from a sample of ``OVERSAMPLE`` keys a range; they only set how
    even the ranges are.
    """
    spark = rows.sparkSession
    small_batches(spark)
    sequences = stored(distinct(rows), "sequences")
    total, count = sequences.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0)), F.count("*")).first()
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    share = min(1.0, OVERSAMPLE * ranges / max(count, 1))
    some = sequences.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(F.substring("key", 1, UNIT * SPLIT_TURNS).alias("key"))
    sample = sorted({bytes(x.key) for x in some.collect()})
    splitters = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[Sequence] = []

        def flush() -> pa.RecordBatch:
            held.sort()
            keys, out, start = [x[0] for x in held], [], 0
            while start < len(held):
                part = bisect_right(splitters, keys[start])
                stop = bisect_left(keys, splitters[part], start) if part < len(splitters) else len(held)  # a splitter begins the range after it
                out.append((part, keys[start], keys[stop - 1], *encoded(held[start:stop])))
                start = stop
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if not k else pa.binary()) for k, c in enumerate(zip(*out, strict=True))], names=["part", "first", "last", *RUN])

        size = 0
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("key", "n", "conv_id", "ends")), strict=True):
                held.append(x)
                size += len(x[0])
                if len(held) >= RUN_ROWS or size >= RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    runs = stored(sequences.mapInArrow(sort, "part int, first binary, last binary, " + ", ".join(f"{c} binary" for c in RUN)), "runs")
    order = Window.partitionBy(F.lit(0)).orderBy("part")  # one row for each range
    ends = runs.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    beside = ends.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))

    def merge(table: pa.Table) -> pa.Table:
        release()
        before, after = (table.column(c)[0].as_py() for c in ("before", "after"))
        parts = [decoded(*x) for x in zip(*(table.column(c).to_pylist() for c in RUN), strict=True)]
        columns: list[list] = [[] for _ in NODE.names]
        for node in nodes(merged(parts), before, after):
            for c, v in zip(columns, node, strict=True):
                c.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(columns, NODE.types, strict=True)], schema=NODE)

    kinds = "node binary, parent binary, depth long, turn binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
    found = runs.join(beside, "part").select("part", "before", "after", *RUN).groupBy("part").applyInArrow(merge, kinds)
    least = [F.min(c).alias(c) for c in ("parent", "depth", "turn", "conv_id")]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = stored(found.groupBy("node").agg(*least, *sums, F.max("ends").alias("ends")), "nodes")
    above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shown = [F.lower(F.hex(c)).alias(c) for c in ("node", "parent", "turn")]
    ends_sha256 = F.coalesce(F.lower(F.hex("ends")), F.lit(NOTHING)).alias("ends_sha256")
    return whole.join(above, "parent", "left").select(*shown, "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends_sha256)

