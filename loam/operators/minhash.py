"""MinHash signatures, similar pairs and greedy similarity dedup."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators.exact import exact_dedup, first_of, without_apps
from loam.operators.greedy import dropped
from loam.operators.prefix import prefix_dedup
from loam.storage import stored

SIZE, SHINGLE, SIMILAR = 20, 3, 0.7
#: The hash family is ``(a * h + b) mod PRIME`` over one base hash of a shingle.
PRIME = 2_147_483_647
#: Shingles whose base hash a task keeps.
KEPT = 200_000
#: Characters whose shingles are numbered at a time, and a code that no character has.
PIECE, GAP = 1 << 17, 0x1FFFFF
#: Least and most classes of a block of a hot part, blocks of a part that had all classes, and pairs that a task counts at a time.
BLOCK, LARGEST, BLOCKS, CELLS = 4096, 1 << 18, 64, 1 << 17
#: Rows of a class that go together, about, and pairs of rows that leave a task at a time.
LOT, PAIRS = 1024, 1 << 17


def factors(k: int) -> tuple[int, int]:
    """Factor and offset of the k-th hash, from a rule."""
    return (1_103_515_245 * (k + 1) + 12_345) % PRIME, (69_069 * (k + 7) ** 3 + 1) % PRIME


def base_hash(gram: str, portable: bool) -> int:
    """A shingle's hash below ``PRIME``; the portable one, of MD5, is the same in other engines."""
    raw = gram.encode()
    if portable:
        return int(hashlib.md5(raw, usedforsecurity=False).hexdigest()[:7], 16)
    h = xxhash.xxh64_intdigest(raw, 42)
    return (h - 2**64 if h >> 63 else h) % PRIME


def signed(rows: DataFrame, size: int = SIZE, n: int = SHINGLE, portable: bool = False, carried: Sequence[str] | None = None) -> DataFrame:
    """``rows``, or the ``carried`` columns of them, and each one's ``signature``: minima over the shingles of the cleaned text, null without a shingle.

    A text shorter than ``n`` is its own shingle. No row is made of a shingle: as
    expressions the minima would be rows or twenty interpreted functions for each,
    so texts' shingles are hashed and reduced in one Arrow pass, ``PIECE`` characters at a time.
    """
    size, n = min(size, SIZE), max(2, n)
    columns = rows.columns if carried is None else list(carried)
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.select(*columns).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column("__clean")), 0).to_numpy(zero_copy_only=False)
            piece = np.cumsum(lengths, dtype=np.int64) // PIECE
            for low, high in pairwise([0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)]):
                part = batch.slice(low, high - low)
                made = minima(part.column("__clean").to_pylist(), size, n, known, portable)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), made], names=[*columns, "signature"])

    return rows.select(*columns, X.collapsed("text").alias("__clean")).mapInArrow(run, f"{kinds}, signature array<bigint>")


def minima(texts: Sequence[str | None], size: int, n: int, known: dict[str, int], portable: bool) -> pa.Array:
    """Signatures of some texts; ``known`` keeps base hashes. Shingles are numbered over all texts, so each is hashed once."""
    some = [t for t in texts if t]
    has = np.array([bool(t) for t in texts], bool)
    counts = np.array([max(len(t) - n + 1, 1) for t in some], np.int64)
    offsets = np.concatenate([[0], np.cumsum(has * size)]).astype(np.int32)
    if not some:
        return pa.nulls(len(texts), pa.list_(pa.int64()))
    padded = "".join(t.ljust(n) for t in some)
    code = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum(counts + n - 1)
    short = {}
    for i in np.flatnonzero(np.array([len(t) < n for t in some])).tolist():
        code[ends[i] - n + len(some[i]) : ends[i]] = GAP
        short[int(ends[i]) - n] = some[i]
    whole = np.ones(len(code), bool)
    for k in range(1, n):
        whole[ends - k] = False
    key, at = code[: len(code) - n + 1].copy(), np.flatnonzero(whole)
    for k in range(1, n):
        if k > 2:  # as numbers of what is equal so far, to leave room
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key << 21 | code[k : len(key) + k]
    numbers, number = np.unique(key[at], return_inverse=True)
    place = np.empty(len(numbers), np.int64)
    place[number] = at
    if len(known) > KEPT:
        known.clear()
    base = np.empty(len(numbers), np.int64)
    for i, p in enumerate(place.tolist()):
        gram = short.get(p) or padded[p : p + n]
        h = known.get(gram)
        if h is None:
            known[gram] = h = base_hash(gram, portable)
        base[i] = h
    starts, out = np.cumsum(counts) - counts, np.empty((len(some), size), np.int64)
    for k, (a, b) in enumerate(map(factors, range(size))):
        out[:, k] = np.minimum.reduceat(((a * base + b) % PRIME).astype(np.int32)[number], starts)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()), mask=pa.array(~has))


def filled(signature: str = "signature", size: int = SIZE) -> F.Column:
    """The signature, 0s in place of null."""
    return F.coalesce(F.col(signature), F.array(*[F.lit(0).cast("bigint")] * min(size, SIZE)))


def signatures(rows: DataFrame, key: str = "seq", size: int = SIZE, n: int = SHINGLE, portable: bool = False) -> DataFrame:
    """``key, signature`` of each key; 0s without a shingle. Rows of one key share their shingles."""
    size = min(size, SIZE)
    each = signed(rows.select(key, "text"), size, n, portable, [key])
    mins = [F.min(F.col("signature")[k]).alias(f"m{k}") for k in range(size)]
    return each.groupBy(key).agg(*mins).select(key, F.array(*(F.coalesce(f"m{k}", F.lit(0).cast("bigint")) for k in range(size))).alias("signature"))


def bands(threshold: float, size: int = SIZE) -> int:
    """Bands so many that two signatures at the threshold agree on one of them: mismatches allowed, plus one."""
    return size - math.ceil(threshold * size - 1e-9) + 1


def classes(rows: DataFrame, key: str = "seq", size: int = SIZE, portable: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of one signature and length are a class: ``id, n, signature`` of the classes, ``id`` the least key, and ``id, key`` of their rows."""
    plain = rows.select(F.col(key).alias("key"), F.length("text").alias("n"), "text")
    each = stored(signed(plain, size, portable=portable, carried=["key", "n"]).select("key", "n", filled("signature", size).alias("signature")), "signatures")
    first = stored(each.groupBy("signature", "n").agg(F.min("key").alias("id")), "classes")
    return first, each.join(first, ["signature", "n"]).select("id", "key")


def lots(rows: DataFrame, key: str = "seq", size: int = SIZE, portable: bool = False) -> DataFrame:
    """``id, n, signature, keys``: the rows of a class together, in lots of about ``LOT`` where it has more; ``id`` is a lot's least key. Rows without a length or key are in none."""
    plain = rows.select(F.col(key).alias("key"), F.length("text").alias("n"), "text").where("key is not null and n is not null")
    each = stored(signed(plain, size, portable=portable, carried=["key", "n"]).select("key", "n", filled("signature", size).alias("signature")), "signatures")
    large = each.groupBy("signature", "n").agg(F.ceil(F.count("*") / LOT).cast("int").alias("parts")).where("parts > 1")
    dealt = each.join(F.broadcast(stored(large, "large")), ["signature", "n"], "left").withColumn("lot", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))))
    return stored(dealt.groupBy("signature", "n", "lot").agg(F.min("key").alias("id"), F.collect_list("key").alias("keys")).drop("lot"), "lots")


def banded(first: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """Each class once for each band of its signature: ``id, n, signature, band, part``, and ``keys`` if it has; a value of a signature is below ``PRIME``, so an int."""
    parts = F.array(*(F.xxhash64(*(F.col("signature")[k] for k in range(low, high))) for low, high in pairwise(cuts)))
    keys = [c for c in first.columns if c == "keys"]
    return first.select("id", F.coalesce("n", F.lit(-1)).alias("n"), F.col("signature").cast("array<int>").alias("signature"), *keys, F.posexplode(parts).alias("band", "part"))


def tiled(first: DataFrame, cuts: Sequence[int], earlier: DataFrame | None = None) -> DataFrame:
    """``id`` or ``keys``, ``n, signature, band, part, low, high, second``: each class once for each tile that it is compared in.

    Blocks grow with the classes up to ``LARGEST``, so until then a class is in no more than
    ``BLOCKS`` tiles of a part, and these rows grow with the classes, not with their square.
    """
    sides = [banded(x, cuts).withColumn("side", F.lit(k)) for k, x in enumerate([first] if earlier is None else [first, earlier])]
    rows = reduce(DataFrame.unionAll, sides)
    among, held = earlier is None, "keys" if "keys" in first.columns else "id"
    block = min(max(BLOCK, (first.count() + (0 if among else earlier.count())) // BLOCKS), max(LARGEST, BLOCK))
    sizes = rows.groupBy("band", "part").agg(*(F.ceil(F.count(F.when(F.col("side") == k, 1)) / block).cast("int").alias(f"b{k}") for k in range(2)))
    hot = stored(sizes.where((F.col("b0") > 1) | (F.col("b1") > 1)), "hot")
    blocks = [F.greatest(F.coalesce(f"b{k}", F.lit(1)), F.lit(1)) for k in range(2)]
    own = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), blocks[k]).cast("int")
    others = lambda k: F.sequence(F.lit(0), blocks[k] - 1)
    tile = lambda low, high, second: F.struct(low.alias("low"), high.alias("high"), second.cast("int").alias("second"))
    if among:
        tiles = F.transform(others(0), lambda x: tile(F.least(own(0), x), F.greatest(own(0), x), own(0) > x))
    else:
        tiles = F.when(F.col("side") == 0, F.transform(others(1), lambda x: tile(own(0), x, F.lit(0)))).otherwise(F.transform(others(0), lambda x: tile(x, own(1), F.lit(1))))
    return rows.join(hot, ["band", "part"], "left").select(held, "n", "signature", "band", "part", F.explode(tiles).alias("tile")).select(held, "n", "signature", "band", "part", "tile.*")


def class_pairs(first: DataFrame, threshold: float = SIMILAR, size: int = SIZE, length_prune: bool = True, earlier: DataFrame | None = None) -> DataFrame:
    """``before, node, similarity`` of all pairs of classes at the threshold, ``before`` the lesser id; with ``earlier``, of one of each.

    Lossless for the signatures: there is one band more than places that may
    differ. Two classes are given out once, on the first band that they share.
    Classes that share a part of a band are compared in tiles: those of a part of more
    than a block's classes are dealt to blocks, and each two blocks meet in one tile. So a
    task holds two blocks, however hot a part, and no row is made of a pair that isn't similar.
    With ``keys`` pairs are of these, as two classes' rows meet; none is shuffled to be expanded.
    """
    count, among = bands(threshold, size), earlier is None
    cuts = [round(i * size / count) for i in range(count + 1)]
    parts = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["band", "part", "low", "high"]
    dealt = tiled(first, cuts, earlier).repartition(parts, *keys).sortWithinPartitions(*keys, "second")
    need = math.ceil(threshold * size - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, keys):
            yield from tile_pairs(group, cuts, need, length_prune, among)

    kind = dict(first.dtypes)["id"]
    found = dealt.mapInArrow(run, f"one {kind}, other {kind}, same int")
    if among:
        pairs = found.select(F.least("one", "other").alias("before"), F.greatest("one", "other").alias("node"), (F.col("same") / size).alias("similarity"))
        return pairs.where("before < node") if "keys" in first.columns else pairs
    return found.where("other < one").select(F.col("other").alias("before"), F.col("one").alias("node"), (F.col("same") / size).alias("similarity"))


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key of a sorted input; a key's rows are held, and those of a batch."""
    rest: pa.Table | None = None
    for b in batches:
        here = pa.Table.from_batches([b])
        here = pa.concat_tables([rest, here]).combine_chunks() if rest is not None and rest.num_rows else here
        changed = np.zeros(max(here.num_rows - 1, 0), bool)
        for k in keys:
            x = here.column(k).to_numpy()
            changed |= x[1:] != x[:-1]
        ends = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for low, high in pairwise(ends):
            if high - low > 1:
                yield here.slice(low, high - low)
        rest = here.slice(ends[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest


def tile_pairs(group: pa.Table, cuts: Sequence[int], need: int, length_prune: bool, among: bool) -> Iterator[pa.RecordBatch]:
    """``one, other, same`` of a tile: its first block against its second, or a block among itself. Places are counted by their low bytes, and hits confirmed."""
    group = group.combine_chunks()
    band, ids, second = group.column("band")[0].as_py(), group.column("keys" if "keys" in group.column_names else "id").combine_chunks(), group.column("second").to_numpy()
    n, mine = group.column("n").to_numpy(), int(np.searchsorted(second, 1))
    signature = group.column("signature").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
    alone = among and group.column("low")[0].as_py() == group.column("high")[0].as_py()
    start = 0 if alone else mine
    rows = len(n) - start
    if not mine or not rows:
        return
    low = np.ascontiguousarray(signature.astype(np.uint8).T)
    step = max(1, CELLS // rows)
    for i in range(0, mine, step):
        j = i if alone else start
        a, b = low[:, i : min(i + step, mine)], low[:, j:]
        same = np.zeros((a.shape[1], b.shape[1]), np.uint8)
        for x, y in zip(a, b, strict=True):
            same += (x[:, None] == y).view(np.uint8)
        one, other = np.divmod(np.flatnonzero(same >= need), b.shape[1])
        one, other = one + i, other + j
        if alone:
            one, other = one[one < other], other[one < other]
        if length_prune:
            near = np.abs(n[one].astype(np.int64) - n[other]) * 2 <= np.maximum(n[one], n[other])
            one, other = one[near], other[near]
        equal = signature[one] == signature[other]
        total = equal.sum(1)
        ok = (total >= need) & equal[:, cuts[band] : cuts[band + 1]].all(1)
        for k in range(band):
            ok &= ~equal[:, cuts[k] : cuts[k + 1]].all(1)
        if ok.any():
            yield from expanded(ids, one[ok], other[ok], total[ok])


def expanded(ids: pa.Array, one: np.ndarray, other: np.ndarray, same: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``one, other, same`` of pairs of places in ``ids``; where these are lists, of each two of their keys, some ``PAIRS`` at a time."""
    out = lambda x, y, z, of: pa.RecordBatch.from_arrays([of.take(pa.array(x)), of.take(pa.array(y)), pa.array(z, pa.int32())], names=["one", "other", "same"])
    if not isinstance(ids, pa.ListArray):
        yield out(one, other, same, ids)
        return
    keys, starts, lengths = ids.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())[:-1]]).astype(np.int64), pc.list_value_length(ids).to_numpy().astype(np.int64)
    counts = lengths[one] * lengths[other]
    piece = np.cumsum(counts) // PAIRS
    for low, high in pairwise([0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)]):
        x, y, c = one[low:high], other[low:high], counts[low:high]
        pair = np.repeat(np.arange(len(c)), c)
        a, b = np.divmod(np.arange(len(pair)) - (np.cumsum(c) - c)[pair], lengths[y][pair])
        yield out(starts[x][pair] + a, starts[y][pair] + b, same[low:high][pair], keys)


def growing(first: DataFrame, least: int = 4096, factor: int = 8) -> Iterator[DataFrame]:
    """Classes in batches by id, the first of about ``least``, each ``factor`` times as large as all before it."""
    rows, sizes = first.count(), []
    while least < rows:
        sizes.append(least / rows)
        least *= 1 + factor
    cuts = sorted(set(first.approxQuantile("id", sizes, 0.1 * sizes[0]))) if sizes else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        above = F.lit(True) if low is None else F.col("id") > low
        yield first.where(above & (F.lit(True) if high is None else F.col("id") <= high))


def similar_pairs(rows: DataFrame, threshold: float = SIMILAR, key: str = "seq", size: int = SIZE, length_prune: bool = True, portable: bool = False) -> DataFrame:
    """``before, node, similarity`` of all pairs of rows at the threshold, ``before`` the lesser key.

    Pairs are found between lots of rows of one class, and expanded where two lots meet,
    so no pair is shuffled; the result grows with the square of a class, so dedup works on ``class_pairs``.
    """
    first = lots(rows, key, size, portable)
    within = first.where(F.size("keys") > 1).select("keys", F.explode("keys").alias("x")).select("x", F.explode(F.filter("keys", lambda y: y > F.col("x"))).alias("y"))
    return class_pairs(first, threshold, size, length_prune).unionByName(within.select(F.col("x").alias("before"), F.col("y").alias("node"), F.lit(1.0).alias("similarity")))


def similar_dedup(entries: DataFrame, avoid_apps: Sequence[str] = (), min_bytes: int = 0, threshold: float = SIMILAR, portable: bool = False, least: int = 4096, factor: int = 8) -> DataFrame:
    """Greedy first-wins: rows with no kept row before them that is similar; over all apps.

    Of a class only the first row can stay: if that loses to a row, the others are as similar to it.
    Classes are taken in growing batches. One of a batch that a kept class of an earlier batch is
    similar to goes at once, so of many rows of one template few are ever compared to each other.
    """
    passed = without_apps(entries, avoid_apps).where(X.n_bytes("text") >= min_bytes)
    # rows of one text lose to the first of them, whatever else is kept
    rows = stored(first_of(passed, "text"), "rows")
    first, _ = classes(rows, portable=portable)
    kept = None
    for batch in growing(first, least, factor):
        if kept is not None:
            gone = class_pairs(batch, threshold, earlier=kept).select(F.col("node").alias("gone")).distinct()
            batch = stored(batch.join(gone, F.col("id") == F.col("gone"), "left_anti"), "batch")
        lost = dropped(class_pairs(batch, threshold))
        now = stored(batch.join(lost, F.col("id") == F.col("node"), "left_anti"), "kept")
        kept = now if kept is None else kept.unionAll(now)
    return rows.join(kept.select("id"), F.col("seq") == F.col("id"), "left_semi")


def same_signature_dedup(entries: DataFrame, threshold: float = 0.98, portable: bool = False) -> DataFrame:
    """First row of each signature. From 0.98 on, all 20 places have to agree, so similarity is an equivalence."""
    if math.ceil(threshold * SIZE - 1e-9) != SIZE:
        raise ValueError("below 0.96 similarity isn't an equivalence; use similar_dedup")
    keyed = signed(entries, portable=portable).withColumn("signature", filled())
    return first_of(keyed, "signature").select(*entries.columns)


def potential_duplicates(entries: DataFrame, report: float = 0.95, drop: float = 0.98, portable: bool = False) -> DataFrame:
    """Pairs of kept rows at ``report`` or more but below ``drop``."""
    kept = same_signature_dedup(entries, drop, portable)
    return similar_pairs(kept, report, length_prune=False, portable=portable)


def find_duplicates(entries: DataFrame, avoid_apps: Sequence[str] = (), min_length: int = 0, portable: bool = False) -> DataFrame:
    """Exact, then greedy prefix, then equal signatures."""
    rows = stored(prefix_dedup(exact_dedup(entries, avoid_apps, min_length)), "prefix")
    return same_signature_dedup(rows, portable=portable)
