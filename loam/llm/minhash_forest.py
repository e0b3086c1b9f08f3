"""MinHash near-duplicates by an LSH forest.

A document is the set of its 2-word shingles. Documents of one set are one class.
Each of the forest's trees has an order of its own of five MinHash labels; classes
sorted by a tree's labels stand beside those with which they share the longest
prefix. Two texts of similarity s share d labels of a tree with probability s^d.

* Neighbours: classes that stand side by side in some order and share nearly all
  labels are estimated by their whole signatures, and each class's best are compared
  by their full sets. This joins groups of near copies, of any size, at a cost in
  proportion to them.
* Regions: classes that share a prefix of 3 labels, or of 4 where more than ``REGION``
  do, are a region. Only pairs of different components are still of interest in it;
  a region within one component is left out. Classes are compared by bytes of their
  signatures, in blocks where a region is large, outside the largest component
  against all; parity bits of their sets rule out most others for certain, and the full
  sets of the rest decide. First only the likeliest pairs, a spanning forest of each
  region, so that groups become one component; then all pairs that are still in two,
  which needs the components alone of which such a pair has failed.

No pair of a region is skipped, however many there are, so a link at the threshold is
missed only if its ends share no such prefix in any tree: with 20 trees one in 10^6
at 3 labels and 3 in 10^5 at 4, or if the estimate of 100 labels is off by over 4.5
standard deviations. Every link is confirmed on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.llm._shared import as_bytes, components, slices, small_batches
from loam.storage import stored

SHINGLE, PERCENT = 2, 80
TREES, LABELS = 20, 5
SIZE = TREES * LABELS
#: Labels that neighbours share, and labels of a region where it is small and where it is large.
NEAR, SHALLOW, DEEP = 4, 3, 4
#: Classes of a small region; classes of a block of a large one; neighbours of a class that are compared first.
REGION, BLOCK, BEST = 64, 1024, 2
#: Standard deviations by which an estimate may be off.
SIGMAS = 4.5
#: Bits of a set's parity.
BITS = 1024
#: Links that one task may hold.
FEW_LINKS = 200_000
#: Bytes of texts whose sets a task keeps.
KEPT_BYTES = 16 << 20
FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1 for k in range(SIZE)], np.uint64)
MASKS = np.array([xxhash.xxh64_intdigest(b"%d" % k) for k in range(SIZE)], np.uint64)


def shingles(text: bytes, n: int = SHINGLE) -> set[bytes]:
    """Distinct shingles; a text of fewer words is its own, one without words has none. Only A-Z are lower-cased."""
    words = text.lower().split()
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of each of the hash functions, 32 bits."""
    least = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[k : k + 1024, None] ^ MASKS) * FACTORS).min(0), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def parity(hashes: np.ndarray) -> bytes:
    """Bits that are set if an odd number of the hashes fall on them.

    Two sets' bits differ in at most as many places as the sets do in elements, so
    bits that differ too often tell for certain that sets aren't similar enough.
    """
    return np.packbits(np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).tobytes()


def signed(documents: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``id, n, node, labels, sketch, parity, t1, t2`` of each row: the set's size, digest and signature, a byte of each label, bits that its hashes flip, and two hashes of the text; no digest without words."""
    small_batches(documents.sparkSession)
    text = F.col(text_col).cast("string")
    rows = documents.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sizes, nodes, labels, sketches, parities = [], [], [], [], []
                for t in as_bytes(b.column("text")):
                    held = shingles(t or b"", n)
                    hashes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, held), np.uint64, len(held)))
                    sizes.append(len(held))
                    nodes.append(xxhash.xxh128_digest(hashes.tobytes()) if held else None)
                    labels.append(signature(hashes).tobytes() if held else None)
                    sketches.append(labels[-1][3::4] if held else None)
                    parities.append(parity(hashes) if held else None)
                more = [pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (nodes, labels, sketches, parities))]
                yield pa.RecordBatch.from_arrays([b.column("id"), *more, b.column("t1"), b.column("t2")], names=["id", "n", "node", "labels", "sketch", "parity", "t1", "t2"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, node binary, labels binary, sketch binary, parity binary, t1 long, t2 long")


def branches(classes: DataFrame, *columns: str) -> DataFrame:
    """``tree, key`` and the columns: a row for each class and tree, ``key`` the labels in the tree's order."""
    keys = F.array(*(F.substring("labels", 1 + 4 * LABELS * t, 4 * LABELS) for t in range(TREES)))
    return classes.select(*columns, F.posexplode(keys).alias("tree", "key"))


def neighbours(classes: DataFrame) -> DataFrame:
    """``(a, b)``: classes side by side in a tree's order that share ``NEAR`` labels or more."""
    ordered = branches(classes, "node").repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, bytes, bytes] | None = None  # neighbours that two tasks share are found by the regions
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("tree", "key", "node")), strict=True))
            pairs = []
            for x in rows:
                if before is not None and x[0] == before[0] and x[1][: 4 * NEAR] == before[1][: 4 * NEAR]:
                    pairs.append((min(x[2], before[2]), max(x[2], before[2])))
                before = x
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return ordered.mapInArrow(run, "a binary, b binary").where("a < b").distinct()


def least_equal(percent: int) -> int:
    """Labels that two signatures have in common at least if their sets are as similar as that."""
    s = percent / 100
    return int(np.floor(SIZE * s - SIGMAS * np.sqrt(SIZE * s * (1 - s))))


def best(pairs: DataFrame, classes: DataFrame, percent: int, most: int = BEST) -> DataFrame:
    """Of the pairs that may be similar enough, those that are among the best of either end, by equal labels."""
    ends = classes.select("node", "labels")
    joined = pairs.join(ends.withColumnsRenamed({"node": "a", "labels": "la"}), "a").join(ends.withColumnsRenamed({"node": "b", "labels": "lb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            one, two = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint32).reshape(-1, SIZE) for c in ("la", "lb"))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array((one == two).sum(1), pa.int32())], names=["a", "b", "same"])

    # counted in numpy: as expressions these are a hundred comparisons to compile for each job
    near = joined.select("a", "b", "la", "lb").mapInArrow(run, "a binary, b binary, same int").where(F.col("same") >= least_equal(percent))
    both = near.select(F.explode(F.array(F.struct("a", "b", "same"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "same"))).alias("x")).select("x.*")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("same"), "b"))  # as many rows as trees, twice, at most
    return both.withColumn("rank", rank).where(F.col("rank") <= most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed(pairs: DataFrame, classes: DataFrame, documents: DataFrame, id_col: str, text_col: str, percent: int, n: int) -> DataFrame:
    """The pairs whose sets of shingles are similar enough; one text stands for each class."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "id", "t1", "t2"), "node")
    text = F.col(text_col).cast("string")
    rows = documents.select(F.col(id_col).alias("__id"), text.alias("text"), F.xxhash64(text).alias("u1"), F.xxhash64(F.lit(1), text).alias("u2"))
    found = wanted.join(rows, F.col("id").eqNullSafe(F.col("__id")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")))
    texts = stored(found.select("node", "text").dropDuplicates(["node"]), "texts")
    each = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "one"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "two"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, set[bytes]] = {}
        held = 0
        for b in batches:
            kept = []
            for x, y, one, two in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), as_bytes(b.column("one")), as_bytes(b.column("two")), strict=True):
                for node, t in ((x, one), (y, two)):
                    if node not in sets:
                        if held > KEPT_BYTES:
                            sets, held = {k: v for k, v in sets.items() if k in (x, y)}, 0
                        sets[node] = shingles(t, n)
                        held += len(t)
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    kept.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in kept], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return each.select("a", "b", "one", "two").mapInArrow(run, "a binary, b binary")


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class Sketches:
    """What is known of some classes: a byte of each label, parity bits and sizes of their sets, and their components."""

    def __init__(self, sketch: list[bytes], parity: list[bytes], n: np.ndarray, root: list[bytes], percent: int) -> None:
        self.bytes = np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, SIZE)
        self.bits = np.frombuffer(b"".join(parity), np.uint64).reshape(-1, BITS // 64)
        self.n, self.least, self.percent = n, least_equal(percent), percent
        self.owner = np.unique(np.array(root, f"S{len(root[0])}"), return_inverse=True)[1]

    def may(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the parity bits of pairs allow the similarity: of two sets of n and m elements (n + m)(100 - p)/(100 + p) differ at most."""
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), 100_000):
            a, b = i[k : k + 100_000], j[k : k + 100_000]
            differ = np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(1, dtype=np.int64)
            out[k : k + 100_000] = differ * (100 + self.percent) <= (self.n[a] + self.n[b]) * (100 - self.percent)
        return out


def similar(of: Sketches, left: np.ndarray, right: np.ndarray) -> Found:
    """Places, of rows ``left`` and ``right``, of the pairs of different components that may be similar enough, and their equal bytes."""
    found: list[Found] = []
    sketch, root, least = of.bytes, of.owner, of.least
    step = max(1, (4 << 20) // max(1, len(right) * SIZE))
    for k in range(0, len(left), step):
        some = left[k : k + step]
        same = (sketch[some][:, None, :] == sketch[right][None]).sum(2, dtype=np.uint8 if SIZE < 256 else np.int32)
        i, j = np.nonzero((same >= least) & (root[some][:, None] != root[right][None]))
        good = of.may(some[i], right[j])
        i, j = i[good], j[good]
        found.append((some[i], right[j], same[i, j].astype(np.int64)))
    return together(found)


def together(found: list[Found]) -> Found:
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in range(3))


def forest(pairs: Found, owner: np.ndarray, group: np.ndarray) -> Found:
    """Of the pairs those of a spanning forest over the components within each group, by the most equal bytes."""
    i, j, same = pairs
    root: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for k in np.argsort(-same, kind="stable").tolist():
        a, b = find((group[i[k]], owner[i[k]])), find((group[j[k]], owner[j[k]]))
        if a != b:
            root[a] = b
            kept.append(k)
    return i[kept], j[kept], same[kept]


def blocks(large: DataFrame, block: int) -> DataFrame:
    """``g, side, node``: of large regions the classes outside the largest component, side 0, against all, side 1, block by block."""
    shares = large.groupBy("r", "root").agg(F.count("*").alias("c")).groupBy("r").agg(F.max_by("root", "c").alias("main"), (F.sum("c") - F.max("c")).alias("outside"))
    cut = large.join(shares, "r").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("outer", F.ceil(F.col("outside") / block).cast("int"))
    at = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    others = cut.where("root <> main").select("r", "node", at("outer").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), F.lit(0).alias("side"))
    all_of = cut.select("r", "node", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("x"), at("blocks").alias("y"), F.lit(1).alias("side"))
    return others.unionByName(all_of).select(F.xxhash64("r", "x", "y").alias("g"), "side", "node")


def across(classes: DataFrame, roots: DataFrame, percent: int, thin: bool = False, among: DataFrame | None = None, region: int = REGION, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: pairs of classes of different components that share a region and may be similar enough.

    ``thin`` leaves of each region or block a spanning forest of the likeliest pairs, at most a pair for each class.
    ``among`` has the components, by ``root``, that are still to be compared to each other.
    """
    named = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "labels", "sketch", "parity", "n")
    named = stored(named if among is None else named.join(among, "root", "left_semi"), "rooted")
    prefix = lambda d: F.xxhash64("tree", F.substring("key", 1, 4 * d))
    rows = branches(named, "node", "root").select("node", "root", prefix(SHALLOW).alias("r1"), prefix(DEEP).alias("r2"))

    def sizes(rows: DataFrame, key: str) -> DataFrame:
        """Regions of several components, and their classes."""
        mixed = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
        return mixed.where("x <> y").select(key, "n")

    shallow = sizes(rows, "r1")
    joined = rows.join(shallow, "r1")
    small = joined.where(F.col("n") <= region).select("node", "root", F.col("r1").alias("r"), "n")
    larger = rows.join(shallow.where(F.col("n") > region).select("r1"), "r1", "left_semi").select("node", "root", "r2")
    deep = larger.join(sizes(larger, "r2"), "r2").select("node", "root", F.col("r2").alias("r"), "n")
    placed = stored(small.unionByName(deep), "regions")
    whole = placed.where(F.col("n") <= block).select(F.xxhash64("r").alias("g"), F.lit(2).alias("side"), "node")
    full = whole
    if (placed.agg(F.max("n")).first()[0] or 0) > block:
        full = whole.unionByName(blocks(placed.where(F.col("n") > block), block))
    # a byte is equal by chance once in 256, which only adds to what is equal
    columns = ["node", "root", "sketch", "parity", "n"]
    full = full.join(named.select(*columns), "node").select("g", "side", *columns)

    def compare(node: list[bytes], of: Sketches, side: np.ndarray, starts: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        owner = of.owner
        lengths = np.diff(np.append(starts, len(node)))
        group = np.repeat(np.arange(len(starts)), lengths)
        little = np.repeat((lengths <= region) & (side[starts] == 2), lengths)
        pairs: list[Found] = []
        for k in range(1, int(lengths[little[starts]].max(initial=1))):  # all little groups at once, by how far apart two rows are
            i = np.nonzero(little[:-k] & (group[:-k] == group[k:]) & (owner[:-k] != owner[k:]))[0]
            for s in range(0, len(i), 20_000):
                some = i[s : s + 20_000]
                same = (of.bytes[some] == of.bytes[some + k]).sum(1)
                good = (same >= of.least) & of.may(some, some + k)
                pairs.append((some[good], some[good] + k, same[good]))
        for s, m in zip(starts.tolist(), lengths.tolist(), strict=True):
            if not little[s]:
                sides, at = side[s : s + m], np.arange(s, s + m)
                pairs.append(similar(of, at[sides != 1], at[sides != 0]))
        every = together(pairs)
        i, j, _ = forest(every, owner, group) if thin else every
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            yield min(node[x], node[y]), max(node[x], node[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            g = table.column("g").to_numpy()
            starts = np.concatenate([[0], np.nonzero(g[1:] != g[:-1])[0] + 1]) if len(g) else np.zeros(0, np.int64)
            found: set[tuple[bytes, bytes]] = set()
            if len(g):
                node, root, sketch, bits = (table.column(c).to_pylist() for c in ("node", "root", "sketch", "parity"))
                found = set(compare(node, Sketches(sketch, bits, table.column("n").to_numpy(), root, percent), table.column("side").to_numpy(), starts))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([*rest, b])
            last = table.column("g")[-1].as_py()
            stop = int(np.searchsorted(table.column("g").to_numpy(), last))  # the last group may go on
            yield done(table.slice(0, stop))
            rest = table.slice(stop).combine_chunks().to_batches()
        if rest:
            yield done(pa.Table.from_batches(rest))

    return full.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a binary, b binary").distinct()


def rooted(links: DataFrame) -> DataFrame:
    """``node, root`` of the components of links ``(a, b)``; of a bounded number of links in one task, else by rounds."""
    if links.count() > FEW_LINKS:
        return components(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([find(x) for x in nodes], pa.binary())], names=["node", "root"])

    return links.repartition(1).mapInArrow(run, "node binary, root binary")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``documents``.

    Rows link if their sets of shingles have an intersection of ``percent`` in 100 of
    their union. ``component_id`` is the least id that links reach, the row's own
    included; ``kept`` says that it is the row's own. Null ids count as greater than
    all others. A text of fewer words than a shingle has is one shingle; one without
    words, or null, has none and links with nothing, not even its like. Repeated rows
    are returned each. An empty table gives an empty result; other columns don't matter.
    """
    each = stored(signed(documents, id_col, text_col, shingle), "signed")
    first = F.min_by(F.struct("id", "t1", "t2", "labels", "sketch", "parity", "n"), F.struct(F.col("id").isNull(), "id", "t1", "t2")).alias("x")
    classes = stored(each.where("node is not null").groupBy("node").agg(first).select("node", "x.*"), "classes")
    check = (classes, documents, id_col, text_col, percent, shingle)
    beside = stored(best(neighbours(classes), classes, percent), "beside")
    links = stored(confirmed(beside, *check), "links")
    # first the likeliest pairs of each region; a pair that was left out is still in two components only if such pairs of both failed
    likely = stored(across(classes, rooted(links), percent, thin=True).join(beside, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(stored(confirmed(likely, *check), "links"))
    roots = rooted(links)
    failed = beside.unionByName(likely).join(links, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    open_ones = failed.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct()
    rest = across(classes, roots, percent, among=open_ones).join(beside.unionByName(likely), ["a", "b"], "left_anti")
    links = links.unionByName(stored(confirmed(stored(rest, "pairs"), *check), "links"))
    roots = rooted(links)
    of = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "id")
    least = of.groupBy("root").agg(F.min("id").alias("least"))
    named = of.join(least, "root").select("node", "least")
    out = each.select("id", "n", "node").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
