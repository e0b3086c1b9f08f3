"""Greedy first-wins resolution of conflicts, by rounds and then in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.storage import stored

#: Rows that one task may resolve in the end.
SMALL = 200_000


def dropped(conflicts: DataFrame) -> DataFrame:
    """``node`` of each row that loses, for conflicts ``(node, before)``: ``before`` precedes ``node``.

    A row is kept if no kept row before it conflicts with it.
    """
    pairs = conflicts.select("node", "before")
    return lost(pairs.select("node", F.col("node").alias("ask")), pairs.select(F.col("node").alias("ask"), "before"), ["ask"])


def lost(asks: DataFrame, offers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``node`` of each row that loses: a row is kept if no kept row answers what it asks.

    ``asks`` has ``node`` and the keys of the one thing that it asks, ``offers`` the keys
    and a row ``before`` that answers them; what precedes what has no circle. So rows
    that are answered by the same rows share one list of them.

    Each round keeps the rows that no undecided row answers and drops what these
    answer; rows that nothing answers never appear. What is left of a bounded number
    of rows is resolved in one task.
    """
    keys = list(keys)
    offers = stored(offers.select(*keys, "before").distinct(), "offers")
    asks = stored(asks.select("node", *keys).distinct().join(offers.select(*keys).distinct(), keys, "left_semi"), "asks")
    out = asks.select("node").limit(0)
    while True:
        size = asks.count()
        if not size:
            return out
        if size + offers.count() <= SMALL:
            return out.unionAll(stored(resolved(asks, offers, keys), "lost"))
        undecided = asks.select(F.col("node").alias("__node")).distinct()
        settled = offers.join(undecided, F.col("before") == F.col("__node"), "left_anti").select(*keys).distinct()
        gone = stored(asks.join(settled, keys, "left_semi").select("node").distinct(), "lost")
        out = out.unionAll(gone)
        off = gone.select(F.col("node").alias("__node"))
        left = asks.join(off, F.col("node") == F.col("__node"), "left_anti")
        # of undecided rows only: kept ones have had their say
        live = offers.join(left.select(F.col("node").alias("__node")).distinct(), F.col("before") == F.col("__node"), "left_semi")
        offers = stored(live.join(left.select(*keys).distinct(), keys, "left_semi"), "offers")
        asks = stored(left.join(offers.select(*keys).distinct(), keys, "left_semi"), "asks")


def resolved(asks: DataFrame, offers: DataFrame, keys: list[str]) -> DataFrame:
    """``lost`` of so few rows that one task can hold them."""
    kind = dict(asks.dtypes)["node"]
    key = F.struct(*keys)
    rows = asks.select(F.lit(0).alias("side"), "node", key.alias("key")).unionAll(offers.select(F.lit(1), F.col("before"), key))
    plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, answers, shown = {}, {}, {}
        for b in batches:
            for side, node, k in zip(*(b.column(c).to_pylist() for c in ("side", "node", "key")), strict=True):
                if side:
                    answers.setdefault(plain(k), []).append(plain(node))
                else:
                    asked[plain(node)] = plain(k)
                    shown[plain(node)] = node
        blocked: dict = {}  # whether a kept row answers; an ask is decided once, whoever asks it
        for first in set(asked.values()):
            path = [[first, 0]]
            while path:
                ask, i = path[-1]
                before = answers.get(ask, ())
                if ask in blocked or i == len(before):
                    blocked.setdefault(ask, False)
                    path.pop()
                elif before[i] not in asked or blocked.get(asked[before[i]]) is False:
                    blocked[ask] = True
                elif asked[before[i]] in blocked:
                    path[-1][1] += 1
                else:
                    path.append([asked[before[i]], 0])
        out = [shown[x] for x in asked if blocked[asked[x]]]
        yield pa.RecordBatch.from_arrays([pa.array(out, b.column("node").type)], names=["node"])

    return rows.repartition(1).mapInArrow(run, f"node {kind}")
