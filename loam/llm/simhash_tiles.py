"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64 majority bits over the XXH64 of 3-word shingles. Equal
fingerprints meet in one row first; distinct ones are laid in tiles by the
population counts of their parts: two of 32 bits, or more and shorter ones for
more fingerprints. Two fingerprints within the radius
differ by at most the radius in the sum of the parts' count differences, so only
tiles that near are compared, each pair of tiles by numpy exclusive-or and bit
counts. That is exact: no pair within the radius is missed. A tile too large for
one task is split in blocks, whose pairs are separate tasks. A pair of blocks
returns a spanning forest of its links, at most a link for each fingerprint,
never all pairs; components over these equal components over all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm._shared import among, as_bytes, by_text, components, slices, small_batches
from loam.storage import stored

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Fingerprints of one block; a task holds two blocks.
BLOCK = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's shingles; zero without words. Only A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    total, step = np.zeros(64, np.int64), 1 << 16
    joined = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashes = np.fromiter((h(b" ".join(x), SEED) for x in joined), np.uint64, n)
    for k in range(0, n, step):
        total += np.unpackbits(hashes[k : k + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, fp`` (a signed long with the 64 bits) of each row; a null text has fingerprint zero, as an empty one."""
    small_batches(documents.sparkSession)
    df = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                fps = np.array([fingerprint(t or b"", shingle) for t in as_bytes(b.column("text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps)], names=["id", "fp"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius between two sets of fingerprints, thinned to a spanning forest."""
    whole, n = np.concatenate([a, b]), len(a)
    parent = np.arange(len(whole))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links, same = [], a is b
    step = max(1, (1 << 21) // max(len(b), 1))
    for start in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count(a[start : start + step, None] ^ b[None, :]) <= radius)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        for x, y in zip(i.tolist(), (j if same else j + n).tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((int(whole[x]), int(whole[y])))
    return links


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: for distinct fingerprints ``fp``, links that span the graph of all pairs within the radius."""
    small_batches(distinct.sparkSession)
    rows = distinct.count()
    parts = next(p for p, most in ((2, 10**6), (4, 10**8), (8, float("inf"))) if rows <= most)
    width = 64 // parts
    key = [f"c{k}" for k in range(parts)]
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1))).cast("int").alias(c) for k, c in enumerate(key)]
    tiled = stored(distinct.select("fp", *counts), "tiles")
    # at most (width + 1) ** parts tiles, whatever the number of rows
    sizes = tiled.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    tiled = tiled.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    moves = [m for m in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, m)) <= radius and m >= (0,) * parts]
    moved = sizes.withColumn("m", F.explode(F.array(*(F.array(*map(F.lit, m)) for m in moves))))
    near = moved.select(*((F.col(k) + F.col("m")[i]).alias(k) for i, k in enumerate(key)), *(F.col(k).alias(f"a{i}") for i, k in enumerate(key)), F.col("blocks").alias("n"), (F.col("m") == F.array(*[F.lit(0)] * parts)).alias("same")).join(sizes, key)
    pairs = (
        near.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("not same or x <= y")
        .withColumn("pair", F.xxhash64(*(f"a{i}" for i in range(parts)), *key, "x", "y"))
    )
    first = F.struct(F.lit(0).alias("side"), *(F.col(f"a{i}").alias(k) for i, k in enumerate(key)), F.col("x").alias("block"))
    second = F.struct(F.lit(1).alias("side"), *key, F.col("y").alias("block"))
    ends = pairs.select("pair", F.explode(F.array(first, second)).alias("e")).select("pair", "e.*")
    sides = tiled.join(ends, [*key, "block"]).select("pair", "side", "fp")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows.fp[rows.side == k].to_numpy().view(np.uint64) for k in (0, 1))
        found = forest(a, b, radius) if len(a) != len(b) or not np.array_equal(np.sort(a), np.sort(b)) else forest(a, a, radius)
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return sides.groupBy("pair").applyInPandas(compare, "a long, b long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``documents``.

    ``component_id`` is the least id among the rows that links reach, the row
    itself included; null ids count as greater than all others. Texts without a
    word, null ones too, have fingerprint zero and link like any other. Repeated
    rows are returned each. An empty table gives an empty result.
    """
    fps = stored(fingerprints(documents, id_col, text_col, shingle), "simhash")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(links(classes, radius, block))
    of = classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``documents`` without the rows whose component has a row of a lesser id.

    Of equal ids the text with the lesser hash counts as less; of rows equal in id and text one stays.
    """
    found = near_duplicates(by_text(documents, id_col, text_col), "__row", text_col, **settings).where(F.col("__row") == F.col("component_id"))
    kept = by_text(among(documents, found, id_col, text_col, "left_semi"), id_col, text_col)
    return kept.dropDuplicates(["__row"]).drop("__row")
